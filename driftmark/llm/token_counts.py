"""Token counts by dynamic programming over a trie of the distinct pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from driftmark.llm.pieces import PRETOKEN, Pieces, escaped

# Counts of pre-tokens that a task remembers; then it starts anew.
REMEMBERED = 1_000_000
_PRETOKEN = re.compile(PRETOKEN)


class PrefixTrie:
    """Best scores and token counts of prefixes, computed once for each node of the trie.

    Pre-tokens are inserted in sorted order, which is the order of a walk through their trie, so the
    path of the current node is all that has to be kept: what a pre-token shares with the one before
    is not computed again, and a node's forward score is final when it is reached.
    """

    def __init__(self, pieces: Pieces):
        self.scores, self.unknown = pieces.scores, pieces.unknown
        # Lengths of pieces with a given end, the longest first: others needn't be looked up.
        lengths: dict[str, set[int]] = {}
        for piece in pieces.scores:
            lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in lengths.items()}

    def counts(self, pretokens: Iterable[str]) -> dict[str, int]:
        """Number of tokens on the best path of each pre-token. Of equally good paths the one whose
        last token is longest is taken."""
        out: dict[str, int] = {}
        best, tokens, path = [0], [0], ""
        scores, tails, unknown = self.scores, self.tails, self.unknown
        for word in sorted(set(pretokens)):
            shared, limit = 0, min(len(path), len(word))
            while shared < limit and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                score, count = None, 0
                for size in tails.get(word[end - 2 : end], ()) if end > 1 else ():
                    if size <= end and (own := scores.get(word[end - size : end])) is not None:
                        reached = best[end - size] + own
                        if score is None or reached > score:
                            score, count = reached, tokens[end - size] + 1
                last = word[end - 1]
                own = scores.get(last)
                reached = best[end - 1] + (unknown if own is None else own)
                if score is None or reached > score:
                    score, count = reached, tokens[end - 1] + (len(last.encode()) if own is None else 1)
                best.append(score)
                tokens.append(count)
            path = word
            out[word] = tokens[-1]
        return out


def token_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows ``(doc_id, n_pretokens, n_tokens)`` for each row of ``docs (doc_id, text)``.

    Each task keeps the counts of the pre-tokens it has met and puts a batch's new ones through the
    trie, so nothing is shuffled. Null and empty texts have no tokens; null ids and repeated rows are
    answered each; an empty table gives no rows; other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = PrefixTrie(pieces), {}
        for batch in batches:
            split = [_PRETOKEN.findall(escaped(t.as_py())) for t in batch.column(1)]
            if len(known) > REMEMBERED:
                known = {}
            fresh = set().union(*split).difference(known)
            known |= trie.counts(fresh)
            sums = [sum(map(known.__getitem__, words)) for words in split]
            columns = [batch.column(0), pa.array(map(len, split), pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_pretokens long, n_tokens long")
