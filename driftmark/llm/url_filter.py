"""URL filter whose block decisions reach every alias of a blocked address."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import ASCII_LOWER, ASCII_UPPER, Scratch, components
from driftmark.operators.joins import skew_join

# (verdict, host, path)
Rule = tuple[str, str, str]
MAX_RULES = 500
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of one address share: host, path and query, without scheme and fragment.
    Null for a text that is no absolute address."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits a host or a parent domain of it, and the
    start of the path; null where none does. Of two equally long ones an allow comes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: they are meant to be a short policy list")
    text = verdict = F.lit(None).cast("string")
    for decision, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        text = F.when(fits, F.lit(domain + start)).otherwise(text)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


# Character references that addresses are written with; the ampersand comes last, so that none is
# decoded twice.
_REFERENCES = [
    (r"&#0*47;|&#[xX]0*2[fF];|&sol;", "/"),
    (r"&#0*63;|&#[xX]0*3[fF];|&quest;", "?"),
    (r"&#0*61;|&#[xX]0*3[dD];|&equals;", "="),
    (r"&#0*58;|&#[xX]0*3[aA];|&colon;", ":"),
    (r"&#0*35;|&#[xX]0*23;|&num;", "#"),
    (r"&#0*46;|&#[xX]0*2[eE];|&period;", "."),
    (r"&#0*34;|&#[xX]0*22;|&quot;", '"'),
    (r"&#0*39;|&#[xX]0*27;|&apos;", "'"),
    (r"&#0*60;|&#[xX]0*3[cC];|&lt;", "<"),
    (r"&#0*62;|&#[xX]0*3[eE];|&gt;", ">"),
    (r"&#0*38;|&#[xX]0*26;|&amp;", "&"),
]
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def _decoded(text: Column) -> Column:
    for reference, char in _REFERENCES:
        text = F.regexp_replace(text, reference, char)
    return text


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as a list of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path without the segments . and .., as a fold over its segments."""

    def step(kept: Column, part: Column) -> Column:
        above = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", above).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def folded(parts: Column) -> Column:
        # What stands before the first slash is empty.
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        kept = F.aggregate(rest, F.array().cast("array<string>"), step)
        # A path that ends in a dot segment names a folder.
        last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))

    return F.when(path.rlike(r"/\.\.?(/|$)"), _once(F.split(path, "/", -1), folded)).otherwise(path)


def resolve(target: Column, url: Column) -> Column:
    """The address a target names on a page or base address, without dot segments."""
    base, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    whole = (
        F.when(target.rlike(_SCHEME), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, path, target))
        .when(target.startswith("#"), F.concat(base, path, query, target))
        .when(target == "", F.concat(base, path, query))
        .otherwise(F.concat(base, folder, target))
    )

    def plain(u: Column) -> Column:
        tail = F.regexp_extract(u, r"(?s)^[^?#]*([?#].*)$", 1)
        return F.concat(F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1), _once(path_of(u), _without_dots), tail)

    return _once(whole, plain)


def alias_links(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``(a, b)`` between the nodes of a page and of the address it redirects to (meta
    refresh) or names as canonical. Links in comments and scripts don't count; relative addresses
    are resolved against the page's first base address, or its own. A comment or script that never
    ends goes to the end of the page; so does a tag, which names nothing then."""
    found = pages.select("url", "html").where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    html = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", "")
    # Possessive, so that the length of a tag costs no stack; one that never closes takes the rest.
    tag = r"(?is)(<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\z))"
    tags = F.filter(F.regexp_extract_all(html, F.lit(tag), 1), lambda t: t.endswith(">"))
    tags = found.select("url", tags.alias("tags"))
    bases = F.filter("tags", lambda t: t.rlike(r"(?is)^<base\b.*\shref\s*="))
    tags = tags.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode("tags").alias("tag"))
    found = scratch.settle("tags", tags)
    value = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def attribute(name: str, tag: str = "tag") -> Column:
        groups = [F.regexp_extract(tag, rf"(?is)\s{name}{value}", i) for i in (1, 2, 3)]
        return F.concat(*groups)

    canonical = F.col("tag").rlike("(?i)^<link") & F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(attribute("http-equiv"))) == "refresh")
    target = F.when(canonical, attribute("href")).when(
        refresh, F.regexp_extract(attribute("content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
    )
    own = F.coalesce(F.trim(_decoded(attribute("href", "base"))), F.lit(""))
    found = found.select("url", own.alias("base"), target.alias("target")).where("target is not null")
    found = found.withColumn("target", F.trim(_decoded(F.col("target"))))
    found = scratch.settle("targets", found.where("target <> ''"))
    found = scratch.settle("bases", found.select("url", "target", resolve(F.col("base"), F.col("url")).alias("base")))
    found = scratch.settle("resolved", found.select("url", resolve(F.col("target"), F.col("base")).alias("target")))
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row for each row of ``pages (page_id, url, html)``: page_id, host, path, rule, verdict,
    and ``component``, the smallest address of the alias group (null without an alias).

    A page's own rule decides. A page without one is blocked when any address of its group, whether
    it was crawled or not, has a block as its own rule; an explicit allow shields only the addresses
    that it fits. All else is allowed. Null or relative urls have empty host and path and no
    aliases; null html has no links; repeated rows are judged each; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    groups = components(alias_links(pages.select("url", "html"), scratch), scratch)
    _, verdict = rule_of(
        F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1), rules
    )
    # The groups only hold addresses with an alias.
    groups = groups.withColumn("blocked", F.coalesce(verdict == "block", F.lit(False)))
    tainted = groups.groupBy("component").agg(F.max("blocked").alias("tainted"))
    groups = scratch.settle("groups", skew_join(groups, tainted, ["component"]).select("node", "component", "tainted"))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "own": verdict})
    rows = skew_join(rows, groups, ["node"], "left")
    own_or_groups = F.coalesce("own", F.when(F.col("tainted"), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", own_or_groups.alias("verdict"), "component")
