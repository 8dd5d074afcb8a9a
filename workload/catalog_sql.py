"""SQL of the derived catalog extracts and of what the queries compute from them.

Every relation is a named query ``<p><name>``; ``p`` is a prefix, so that two states of one
catalog can stand in one statement.
"""

from __future__ import annotations


def extracts_sql(p: str = "x_", side: str = "current") -> dict[str, str]:
    """Named queries of the extracts, in order of dependence."""
    cur = side == "current"
    absent = 1 if cur else 0
    new_rel = "CASE WHEN p_partkey % 20 = 3 THEN '_new' ELSE '' END" if cur else "''"
    owner_shift = "CASE WHEN p_partkey % 20 = 2 THEN 1 ELSE 0 END" if cur else "0"
    new_col = "CASE WHEN first_order % 20 = 3 THEN '_new' ELSE '' END" if cur else "''"
    wider = "CASE WHEN first_order % 20 = 2 THEN 5 ELSE 0 END" if cur else "0"
    nsp = (
        "CASE n_nationkey WHEN 24 THEN 'pg_catalog' WHEN 23 THEN 'information_schema' ELSE n_name END"
    )
    kind = "CASE p_partkey % 10 WHEN 7 THEN 'v' WHEN 8 THEN 'm' WHEN 9 THEN 'S' ELSE 'r' END"
    contype = (
        "CASE WHEN o_orderkey % 4 = 0 THEN 'p' WHEN o_orderkey % 4 = 1 THEN 'u' "
        "WHEN o_orderkey % 4 = 2 THEN 'f' WHEN o_orderkey % 8 = 3 THEN 'c' ELSE 'x' END"
    )
    q = {
        "n": "SELECT count(*) AS n FROM part",
        "nd": "SELECT count(*) AS nd FROM documents",
        "namespace": f"SELECT n_nationkey::BIGINT AS oid, {nsp} AS nspname FROM nation",
        "class": f"""
            SELECT p_partkey AS oid, p_partkey % 25 AS relnamespace,
                   't_' || p_partkey || {new_rel} AS relname, {kind} AS relkind,
                   0::BIGINT AS relam, 0::BIGINT AS reltablespace,
                   CASE WHEN p_partkey % 3 = 0 THEN '{{' || p_brand || '=r/admin}}' END AS relacl,
                   'owner_' || ((p_size + {owner_shift}) % 5) AS relowner,
                   p_size % 2 = 0 AS relispopulated,
                   CASE WHEN p_partkey % 10 IN (7, 8)
                        THEN ' SELECT  ' || p_name || chr(10) || '   FROM ' || p_type || ';' END AS viewdef
            FROM part WHERE p_partkey % 20 <> {absent}
            UNION ALL
            SELECT 1000000000 + c_custkey, (c_custkey % n) % 25, 'ix_' || c_custkey, 'i',
                   c_nationkey % 5, c_custkey % 7, NULL, 'admin', TRUE, NULL
            FROM customer, {p}n""",
        "attribute": f"""
            SELECT l_partkey AS attrelid, l_linenumber AS attnum,
                   'c_' || first_order || '_' || l_linenumber || {new_col} AS attname,
                   (first_order + l_linenumber) % 6 AS atttypid,
                   CASE (first_order + l_linenumber) % 6
                        WHEN 0 THEN 4 + 10 * l_linenumber + {wider}
                        WHEN 3 THEN 655366 + {wider} ELSE -1 END AS atttypmod,
                   flag = 'R' AS attnotnull, first_order % 37 = 0 AS attisdropped
            FROM (SELECT l_partkey, l_linenumber, min(l_orderkey) AS first_order,
                         max(l_returnflag) AS flag
                  FROM lineitem GROUP BY l_partkey, l_linenumber)""",
        "type": """
            SELECT * FROM (VALUES (0, 'varchar'), (1, 'int4'), (2, 'int8'), (3, 'numeric'),
                                  (4, 'timestamptz'), (5, 'text')) AS t(oid, typname)""",
        "attrdef": """
            SELECT DISTINCT l_partkey AS adrelid, l_linenumber AS adnum,
                   CASE WHEN l_linenumber = 2 THEN 'nextval(''s_' || l_partkey || ''')'
                        ELSE 'val_' || ((l_partkey * l_linenumber) % 11) END AS default_expr
            FROM lineitem WHERE l_linenumber = 2 OR (l_partkey + l_linenumber) % 3 = 0""",
        "constraint": f"""
            SELECT o_orderkey AS oid, 'con_' || o_orderkey AS conname, o_orderkey % n AS conrelid,
                   {contype} AS contype,
                   CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 < 3
                        THEN [1, 2 + o_orderkey % 3] ELSE [1] END AS conkey,
                   CASE WHEN o_orderkey % 4 = 2 THEN (o_orderkey * 7 + 3) % n ELSE 0 END AS confrelid,
                   CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 5 = 0 THEN [2, 1]
                        WHEN o_orderkey % 4 = 2 THEN [2] END AS confkey,
                   'CHECK  (price' || chr(10) || ' > ' || o_orderkey || ')' AS definition
            FROM orders, {p}n""",
        "proc": """
            SELECT doc_id AS oid, doc_id % 25 AS pronamespace, 'f_' || doc_id AS proname,
                   doc_id % 3 AS prolang,
                   substr('isvx', (doc_id % 4 + 1)::INT, 1) AS provolatile,
                   substr('rsux', (doc_id % 4 + 1)::INT, 1) AS proparallel,
                   'owner_' || lang AS owner,
                   CASE WHEN doc_id % 3 = 0 THEN '{' || source || '=X}' END AS proacl,
                   doc_id % 2 = 0 AS prosecdef,
                   CASE WHEN doc_id % 5 = 0 THEN ['work_mem=1', 'lang=' || lang] END AS config,
                   'a integer, b ' || lang AS args, 'integer, ' || lang AS identity_args,
                   'void' AS return_type, '  ' || text || '  ' AS prosrc,
                   'CREATE FUNCTION f()' || chr(10) || ' AS $function$ DECLARE x int; BEGIN ' || text
                     || ';' || chr(10) || ' RETURN  x; END;' || chr(10) || ' $function$' AS functiondef
            FROM documents""",
        "language": """
            SELECT r_regionkey AS oid,
                   CASE r_regionkey WHEN 0 THEN 'sql' WHEN 1 THEN 'plpgsql'
                        ELSE 'lang_' || r_regionkey END AS lanname
            FROM region""",
        "depend": f"""
            SELECT 1255 AS classid, o_orderkey % nd AS objid,
                   CASE WHEN o_orderkey % 3 = 0 THEN 1259 ELSE 1247 END AS refclassid,
                   o_orderkey AS refobjid, o_orderkey % 4 AS refobjsubid,
                   't_' || o_orderkey AS ref_name, 'n' AS deptype
            FROM orders, {p}nd
            UNION ALL
            SELECT 2618, 2000000000 + l_orderkey % n, 1259, (l_orderkey * 7 + l_linenumber * 13) % n,
                   l_linenumber, NULL, 'n'
            FROM lineitem, {p}n WHERE (l_orderkey % n) % 10 IN (7, 8)
            UNION ALL
            SELECT 1259, l_orderkey % n, 1259, (l_orderkey * 3 + l_linenumber) % n, l_linenumber - 1,
                   NULL, CASE l_linenumber % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'a' ELSE 'n' END
            FROM lineitem, {p}n WHERE (l_orderkey % n) % 20 = 9""",
        "rewrite": """
            SELECT 2000000000 + p_partkey AS oid, p_partkey AS ev_class
            FROM part WHERE p_partkey % 10 IN (7, 8)""",
        "index": f"""
            SELECT 1000000000 + c_custkey AS indexrelid, c_custkey % n AS indrelid,
                   [4 + c_custkey % 2, c_custkey % 3] AS indkey, c_custkey % 2 = 0 AS indisunique,
                   c_custkey % 5 = 0 AS indisprimary,
                   'CREATE INDEX  ix_' || c_custkey || ' ON' || chr(10) || ' t ( a,  b )' AS indexdef,
                   CASE WHEN c_custkey % 4 = 0 THEN '(a  >  ' || c_custkey || ')' END AS predicate
            FROM customer, {p}n""",
        "am": "SELECT r_regionkey AS oid, 'am_' || r_regionkey AS amname FROM region",
        "tablespace": "SELECT r_regionkey AS oid, 'ts_' || r_regionkey AS spcname FROM region",
        "sequence": """
            SELECT p_partkey AS seqrelid, 1 AS seqstart, 1 AS seqmin, p_size * 1000 AS seqmax,
                   1 + p_size % 3 AS seqincrement, 1 AS seqcache, p_size % 2 = 0 AS seqcycle,
                   lower(p_type) AS type_name
            FROM part WHERE p_partkey % 10 = 9""",
        "trigger": f"""
            SELECT event_id AS oid, event_id % n AS tgrelid, 'trg_' || event_id AS tgname,
                   (event_id * 3) % 128 AS tgtype,
                   CASE WHEN event_type = 'error' THEN 'D' ELSE 'O' END AS tgenabled,
                   event_id % 11 = 0 AS tgisinternal,
                   'CREATE  TRIGGER trg_' || event_id || chr(10) || ' ON ' || event_type AS triggerdef,
                   'fn_' || (user_id % 10) AS function_name, '' AS function_args,
                   'CREATE  FUNCTION' || chr(10) || ' ' || props AS functiondef
            FROM events, {p}n""",
    }
    return {f"{p}{name}": sql for name, sql in q.items()}


def user(col: str) -> str:
    return f"{col} NOT IN ('pg_catalog', 'information_schema')"


_WS = r"'\s+', ' ', 'g'"


def fetch_sql(p: str = "x_", **scope: str) -> dict[str, str]:
    """Named queries of the assembled objects; ``scope`` replaces a kind's default predicate over
    ``s`` (schema), ``r`` (relation) and ``k`` (relkind)."""

    def where(kind: str, default: str) -> str:
        return scope.get(kind, default)

    cls = f"""SELECT c.*, ns.nspname AS s, c.relname AS r, c.relkind AS k
              FROM {p}class c JOIN {p}namespace ns ON ns.oid = c.relnamespace"""
    base = """
            SELECT w.ev_class AS oid, string_agg(DISTINCT t.s || '.' || t.r, ', ' ORDER BY t.s || '.' || t.r) AS names
            FROM {p}depend d JOIN {p}rewrite w ON w.oid = d.objid
            JOIN {p}class v ON v.oid = w.ev_class AND v.relkind IN {owners}
            JOIN {p}cls t ON t.oid = d.refobjid AND t.k IN {read} AND t.oid <> v.oid
            GROUP BY w.ev_class"""
    q = {
        "cls": cls,
        "connames": f"""
            SELECT rel, num, string_agg(DISTINCT conname, ',' ORDER BY conname) AS names
            FROM (SELECT conrelid AS rel, unnest(conkey) AS num, conname FROM {p}constraint)
            GROUP BY rel, num""",
        "f_columns": f"""
            SELECT s AS schema_name,
                   CASE k WHEN 'r' THEN 'Table' WHEN 'v' THEN 'View' ELSE 'Materialized View' END AS object_type,
                   r AS object_type_name, attname AS column_name,
                   CASE typname WHEN 'varchar' THEN 'character varying' WHEN 'int4' THEN 'integer'
                        WHEN 'int8' THEN 'bigint' WHEN 'timestamptz' THEN 'timestamp with time zone'
                        ELSE typname END AS data_type,
                   CASE WHEN typname = 'varchar' THEN atttypmod - 4 END AS character_maximum_length,
                   CASE typname WHEN 'numeric' THEN ((atttypmod - 4) >> 16) & 65535
                        WHEN 'int4' THEN 32 WHEN 'int8' THEN 64 END AS numeric_precision,
                   CASE WHEN typname = 'numeric' THEN (atttypmod - 4) & 65535
                        WHEN typname IN ('int4', 'int8') THEN 0 END AS numeric_scale,
                   CASE WHEN attnotnull THEN 'NO' ELSE 'YES' END AS is_nullable,
                   default_expr AS column_default, 'NO' AS is_identity, 'NEVER' AS is_generated,
                   NULL::VARCHAR AS generation_expression, cn.names AS constraint_name,
                   attnum AS ordinal_position
            FROM {p}attribute a JOIN {p}cls c ON c.oid = a.attrelid JOIN {p}type t ON t.oid = a.atttypid
            LEFT JOIN {p}attrdef ad ON ad.adrelid = a.attrelid AND ad.adnum = a.attnum
            LEFT JOIN {p}connames cn ON cn.rel = a.attrelid AND cn.num = a.attnum
            WHERE k IN ('r', 'v', 'm') AND attnum > 0 AND NOT attisdropped
              AND ({where("columns", user("s"))})""",
        "f_constraints": f"""
            SELECT s AS schema_name, 'Table' AS object_type, r AS object_type_name,
                   conname AS constraint_name,
                   CASE contype WHEN 'p' THEN 'PRIMARY KEY' WHEN 'u' THEN 'UNIQUE' WHEN 'c' THEN 'CHECK'
                        WHEN 'f' THEN 'FOREIGN KEY' ELSE contype END AS constraint_type,
                   cols.names AS column_name, definition
            FROM {p}constraint x JOIN {p}cls c ON c.oid = x.conrelid
            LEFT JOIN (
                SELECT u.oid, string_agg(attname, ',' ORDER BY attnum) AS names
                FROM (SELECT oid, conrelid, unnest(conkey) AS num FROM {p}constraint
                      WHERE contype IN ('p', 'u', 'f')) u
                JOIN {p}attribute a ON a.attrelid = u.conrelid AND a.attnum = u.num
                GROUP BY u.oid) cols ON cols.oid = x.oid
            WHERE {where("constraints", "k = 'r' AND " + user("s"))}""",
        "fdeps": f"""
            SELECT objid, string_agg(ref_name, ',' ORDER BY refclassid, refobjid, refobjsubid) AS dependencies
            FROM {p}depend WHERE classid = 1255 GROUP BY objid""",
        "f_functions": f"""
            SELECT nspname AS schema_name, proname || '(' || identity_args || ')' AS function_name,
                   args AS argument_types, identity_args AS argument_modes, return_type,
                   lanname AS language,
                   CASE provolatile WHEN 'i' THEN 'IMMUTABLE' WHEN 's' THEN 'STABLE' WHEN 'v' THEN 'VOLATILE' END
                     AS volatility,
                   CASE proparallel WHEN 's' THEN 'SAFE' WHEN 'r' THEN 'RESTRICTED' WHEN 'u' THEN 'UNSAFE' END
                     AS parallel_safe,
                   owner AS owner_role, proacl AS privileges, dependencies,
                   prosecdef AS is_security_definer, array_to_string(config, ', ') AS config_settings_text,
                   CASE lanname
                     WHEN 'sql' THEN regexp_replace(trim(prosrc), {_WS})
                     WHEN 'plpgsql' THEN regexp_replace(regexp_replace(regexp_replace(functiondef,
                          '(?si).*?(DECLARE|BEGIN)(.*?)END;?\\s*\\$[^$]*\\$.*\\z', '\\1\\2'),
                          '(?si)\\s*RETURN\\s+[^;]+;?\\s*\\z', ''), {_WS})
                     ELSE trim(prosrc) END AS function_body
            FROM {p}proc f JOIN {p}namespace ns ON ns.oid = f.pronamespace
            JOIN {p}language l ON l.oid = f.prolang LEFT JOIN {p}fdeps d ON d.objid = f.oid
            WHERE {where("functions", user("nspname"))}""",
        "f_indexes": f"""
            SELECT t.s AS schema_name,
                   CASE t.k WHEN 'r' THEN 'Table' WHEN 'm' THEN 'Materialized View' END AS object_type,
                   t.r AS object_type_name, i.relname AS index_name, spcname AS tablespace,
                   regexp_replace(regexp_replace(regexp_replace(indexdef, {_WS}), '\\(\\s+', '(', 'g'),
                                  '\\s+\\)', ')', 'g') AS indexdef,
                   indisunique AS is_unique, indisprimary AS is_primary, cols.names AS index_columns,
                   regexp_replace(coalesce(predicate, ''), {_WS}) AS index_predicate,
                   amname AS access_method
            FROM {p}index x JOIN (SELECT * FROM {p}cls WHERE {where("indexes", "k IN ('r', 'm') AND " + user("s"))}) t
              ON t.oid = x.indrelid
            JOIN {p}class i ON i.oid = x.indexrelid JOIN {p}am am ON am.oid = i.relam
            LEFT JOIN {p}tablespace ts ON ts.oid = i.reltablespace
            LEFT JOIN (
                SELECT indexrelid, string_agg(attname, ',' ORDER BY ord) AS names
                FROM (SELECT indexrelid, indrelid, unnest(indkey) AS num,
                             generate_subscripts(indkey, 1) AS ord FROM {p}index) u
                JOIN {p}attribute a ON a.attrelid = u.indrelid AND a.attnum = u.num
                GROUP BY indexrelid) cols ON cols.indexrelid = x.indexrelid""",
        "base_m": base.format(p=p, owners="('m')", read="('r')"),
        "base_v": base.format(p=p, owners="('v')", read="('r')"),
        "related": base.format(p=p, owners="('v', 'm')", read="('v', 'm')"),
        "view_ix": f"""
            SELECT v.oid, string_agg(i.relname, ', ' ORDER BY i.relname) AS names
            FROM {p}index x JOIN {p}class v ON v.oid = x.indrelid AND v.relkind = 'm'
            JOIN {p}class i ON i.oid = x.indexrelid GROUP BY v.oid""",
        "instead": f"""
            SELECT v.oid, string_agg(tgname, ', ' ORDER BY tgname) AS names
            FROM {p}trigger t JOIN {p}class v ON v.oid = t.tgrelid AND v.relkind = 'v'
            WHERE (tgtype & 64) <> 0 GROUP BY v.oid""",
        "f_matviews": f"""
            SELECT s AS schema_name, r AS view_name, 'MATERIALIZED VIEW' AS view_type,
                   regexp_replace(viewdef, {_WS}) AS view_definition,
                   coalesce(b.names, '') AS base_tables, relispopulated AS is_populated,
                   relowner AS view_owner,
                   trim(concat_ws(', ', 'Dependent views: ' || d.names, 'Indexes: ' || i.names), ', ')
                     AS dependent_objects
            FROM {p}cls c LEFT JOIN {p}base_m b ON b.oid = c.oid LEFT JOIN {p}related d ON d.oid = c.oid
            LEFT JOIN {p}view_ix i ON i.oid = c.oid
            WHERE k = 'm' AND {where("matviews", user("s"))}""",
        "f_views": f"""
            SELECT s AS schema_name, r AS view_name, 'VIEW' AS view_type, viewdef AS view_definition,
                   coalesce(b.names, '') AS base_tables, relowner AS view_owner,
                   trim(concat_ws(', ', 'Dependent views: ' || d.names,
                                  'INSTEAD OF triggers: ' || i.names), ', ') AS dependent_objects
            FROM {p}cls c LEFT JOIN {p}base_v b ON b.oid = c.oid LEFT JOIN {p}related d ON d.oid = c.oid
            LEFT JOIN {p}instead i ON i.oid = c.oid
            WHERE k = 'v' AND {where("views", user("s"))}""",
        "fk": f"""
            SELECT sc.s, sc.r, sc.k, sa.attname AS source_column, tc.s AS target_schema,
                   tc.r AS target_table, ta.attname AS target_column, conname
            FROM (SELECT conname, conrelid, confrelid, unnest(conkey) AS a, unnest(confkey) AS b
                  FROM {p}constraint WHERE contype = 'f') x
            JOIN {p}cls sc ON sc.oid = x.conrelid JOIN {p}cls tc ON tc.oid = x.confrelid
            JOIN {p}attribute sa ON sa.attrelid = x.conrelid AND sa.attnum = x.a
            JOIN {p}attribute ta ON ta.attrelid = x.confrelid AND ta.attnum = x.b""",
        "f_references": f"""
            SELECT s AS schema_name, r AS table_name, source_column, target_schema, target_table,
                   target_column, conname AS constraint_name
            FROM {p}fk WHERE {where("references", "k = 'r' AND " + user("s"))}""",
        "owners": f"""
            SELECT * FROM (
                SELECT d.objid, c.s AS table_schema, c.r AS table_name, a.attname AS column_name, deptype,
                       row_number() OVER (PARTITION BY d.objid
                           ORDER BY a.attname IS NULL, a.attname, c.s, c.r, deptype) AS rn
                FROM {p}depend d JOIN {p}cls c ON c.oid = d.refobjid
                LEFT JOIN {p}attribute a ON a.attrelid = d.refobjid AND a.attnum = d.refobjsubid
                WHERE d.classid = 1259 AND d.refclassid = 1259) WHERE rn = 1""",
        "f_sequences": f"""
            SELECT s AS schema_name, 'Sequence' AS object_type, r AS object_type_name, table_name,
                   CASE WHEN table_name IS NOT NULL AND column_name IS NOT NULL THEN
                        (CASE WHEN regexp_full_match(table_schema, '[a-z_][a-z0-9_]*') THEN table_schema
                              ELSE '"' || table_schema || '"' END) || '.' || table_name || '.' || column_name
                   END AS owned_by,
                   CASE deptype WHEN 'i' THEN 'IDENTITY' WHEN 'a' THEN 'SERIAL' ELSE 'MANUAL' END AS sequence_type,
                   relacl AS privileges, type_name AS data_type, seqstart AS start_value,
                   seqmin AS minimum_value, seqmax AS maximum_value, seqincrement AS increment_by,
                   CASE WHEN seqcycle THEN 'YES' ELSE 'NO' END AS cycle_option, seqcache AS cache_size
            FROM {p}sequence q JOIN {p}cls c ON c.oid = q.seqrelid LEFT JOIN {p}owners o ON o.objid = q.seqrelid
            WHERE k = 'S' AND ({where("sequences", user("s"))})""",
        "f_triggers": f"""
            SELECT s AS schema_name, CASE WHEN k = 'v' THEN 'View' ELSE 'Table' END AS object_type,
                   r AS object_type_name, tgname AS trigger_name,
                   regexp_replace(triggerdef, {_WS}) AS trigger_definition,
                   CASE WHEN tgtype & 2 = 2 THEN 'INSERT' WHEN tgtype & 4 = 4 THEN 'DELETE'
                        WHEN tgtype & 8 = 8 THEN 'UPDATE' ELSE 'UNKNOWN' END AS trigger_event,
                   CASE WHEN tgtype & 4 = 4 THEN 'BEFORE' WHEN tgtype & 8 = 8 THEN 'AFTER'
                        WHEN tgtype & 16 = 16 THEN 'INSTEAD OF' END AS trigger_timing,
                   CASE WHEN tgtype & 1 = 1 THEN 'ROW' ELSE 'STATEMENT' END AS trigger_level,
                   tgenabled = 'O' AS trigger_enabled, function_name AS trigger_function_name,
                   function_args AS trigger_function_arguments,
                   regexp_replace(functiondef, {_WS}) AS trigger_function_definition
            FROM {p}trigger t JOIN {p}cls c ON c.oid = t.tgrelid
            WHERE NOT tgisinternal AND ({where("triggers", "TRUE")})""",
    }
    return {f"{p}{name}": sql for name, sql in q.items()}


def _kv(name: str, value: str | None = None) -> str:
    return f"'{name}:' || coalesce(({value or name})::VARCHAR, '')"


def _kvs(*names: str) -> list[str]:
    return [_kv(n) for n in names]


def fingerprint_sql(p: str = "x_") -> dict[str, str]:
    """Named queries of the nine fingerprints."""

    def row(kind: str, keys: list[str], details: str, hashed: str, source: str | None = None) -> str:
        names = (
            "schema_name",
            "object_type",
            "object_type_name",
            "object_subtype",
            "object_subtype_name",
        )
        cols = ", ".join(f"{k} AS {n}" for k, n in zip(keys, names, strict=True))
        src = source or f"{p}f_{kind}"
        return f"SELECT {cols}, {details} AS object_subtype_details, md5({hashed}) AS object_md5 FROM {src}"

    def cat(parts: list[str], sep: str) -> str:
        return f"concat_ws('{sep}', {', '.join(parts)})"

    null = "NULL::VARCHAR"
    column_parts = [
        _kv("data_type"), _kv("max_length", "character_maximum_length"), *_kvs("numeric_precision", "numeric_scale"),
        _kv("nullable", "is_nullable"), _kv("default_value", "column_default"),
        *_kvs("is_identity", "is_generated", "generation_expression", "constraint_name", "ordinal_position"),
    ]
    con = f"regexp_replace({cat(_kvs('constraint_type', 'column_name', 'definition'), ',')}, {_WS})"
    fun = cat(
        _kvs("argument_types", "argument_modes", "return_type", "language", "volatility", "parallel_safe",
             "owner_role", "privileges", "dependencies", "function_body"), ",",
    )
    ix = _kvs("tablespace", "indexdef", "is_unique", "is_primary", "index_columns", "index_predicate", "access_method")
    mv = ["view_type", "view_definition", "base_tables", "is_populated::VARCHAR", "view_owner", "dependent_objects"]
    mv_named = [f"'{m.split(':')[0]}:' || {m}" for m in mv]
    vw = _kvs("view_type", "view_definition", "base_tables", "view_owner", "dependent_objects")
    sq = ["owned_by", "sequence_type", "privileges", "data_type", "start_value", "minimum_value", "maximum_value",
          "increment_by", "cycle_option", "cache_size"]
    tr = (
        "regexp_replace("
        + cat(
            _kvs("trigger_definition", "trigger_event", "trigger_timing", "trigger_level", "trigger_enabled",
                 "trigger_function_name", "trigger_function_arguments", "trigger_function_definition"), ",",
        )
        + f", {_WS})"
    )
    fk = f"""(SELECT s AS schema_name, r AS table_name, target_table, target_schema, conname,
                 string_agg(source_column, ',' ORDER BY source_column) AS src,
                 string_agg(target_column, ',' ORDER BY target_column) AS tgt
          FROM {p}fk GROUP BY conname, s, r, target_table, target_schema)"""
    q = {
        "columns": row(
            "columns", ["schema_name", "object_type", "object_type_name", "'Column'", "column_name"],
            cat(column_parts, ","), cat(column_parts, ","),
        ),
        "constraints": row(
            "constraints", ["schema_name", "object_type", "object_type_name", "'Constraint'", "constraint_name"],
            con,
            f"concat_ws(':', 'schema:' || schema_name, 'table:' || object_type_name, "
            f"'constraint:' || constraint_name, {con})",
        ),
        "functions": row("functions", ["schema_name", "'Function'", "function_name", null, null], fun, fun),
        "indexes": row(
            "indexes", ["schema_name", "object_type", "object_type_name", "'Index'", "index_name"],
            cat(ix, ","), cat(ix, ":"),
        ),
        "matviews": row(
            "matviews", ["schema_name", "'Materialized View'", "view_name", null, null],
            cat(mv_named, ","), cat(mv, ":"),
        ),
        "references": row(
            "references", ["schema_name", "'Table'", "table_name", "'Reference'", "conname"],
            "'source_columns:{' || src || '},target_schema:' || target_schema || ',target_table:' || target_table "
            "|| ',target_columns:{' || tgt || '},constraint_name:' || conname",
            "'src:' || src || ' tgt:' || tgt || ' tbl:' || table_name || ' ref:' || target_table "
            "|| ' cons:' || conname",
            fk,
        ),
        "sequences": row(
            "sequences",
            ["schema_name", "CASE WHEN table_name IS NULL THEN 'Sequence' ELSE 'Table' END",
             "coalesce(table_name, object_type_name)", "CASE WHEN table_name IS NOT NULL THEN 'Sequence' END",
             "CASE WHEN table_name IS NOT NULL THEN object_type_name END"],
            cat(_kvs(*sq), ","), cat([f"coalesce({c}::VARCHAR, '')" for c in sq], ":"),
        ),
        "triggers": row(
            "triggers", ["schema_name", "object_type", "object_type_name", "'Trigger'", "trigger_name"],
            tr, f"concat_ws('||', schema_name, object_type, object_type_name, 'Trigger', trigger_name, {tr})",
        ),
        "views": row("views", ["schema_name", "'View'", "view_name", null, null], cat(vw, ","), cat(vw, ":")),
    }
    children = ("columns", "constraints", "indexes", "references", "triggers")
    entities = ("functions", "views", "matviews")

    def union(kinds: tuple[str, ...], sequences: str) -> str:
        parts = [f"SELECT DISTINCT * FROM {p}fp_{k}" for k in kinds]
        return " UNION ALL ".join([*parts, f"SELECT DISTINCT * FROM {p}fp_sequences WHERE {sequences}"])

    out = {f"{p}fp_{kind}": sql for kind, sql in q.items()}
    out[f"{p}child"] = union(children, "object_type = 'Table'")
    out[f"{p}entity"] = union(entities, "object_type = 'Sequence'")
    out[f"{p}everything"] = union((*children, *entities), "TRUE")
    return out


def catalog_sql(p: str = "x_", side: str = "current", **scope: str) -> dict[str, str]:
    """All named queries of one catalog state."""
    return {**extracts_sql(p, side), **fetch_sql(p, **scope), **fingerprint_sql(p)}


def extract_digests_sql(p: str, schemas: dict) -> str:
    """Rows and digest of every extract relation."""
    fixed = {
        "schemata": f"(SELECT nspname AS schema_name FROM {p}namespace)",
        "am": "(SELECT r_regionkey AS oid, 'am_' || r_regionkey AS amname FROM region)",
        "tablespace": "(SELECT r_regionkey AS oid, 'ts_' || r_regionkey AS spcname FROM region)",
    }

    def text(field) -> str:
        plain = f"array_to_string({field.name}, ',')" if field.dataType.typeName() == "array" else f"{field.name}::VARCHAR"
        return f"coalesce({plain}, '-')"

    return " UNION ALL ".join(
        f"SELECT 'replica' AS source_db, '{name}' AS relation, count(*) AS n_rows, "
        f"sum(('0x' || substr(md5({' || chr(124) || '.join(map(text, schema.fields))}), 1, 8))::BIGINT)::BIGINT AS digest "
        f"FROM {fixed.get(name, p + name)}"
        for name, schema in schemas.items()
    )


def statement(named: dict[str, str], last: str) -> str:
    """One SQL statement from named queries. Only those that ``last`` needs are kept."""
    needed: set[str] = set()
    body = last
    for name in reversed(list(named)):
        if name in _identifiers(body):
            needed.add(name)
            body += " " + named[name]
    parts = [f"{name} AS ({named[name]})" for name in named if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + last


def _identifiers(sql: str) -> set[str]:
    import re

    return set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
