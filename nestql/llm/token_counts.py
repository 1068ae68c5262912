"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut at added tokens (one token each, as the library treats them by
default), then into words that no match of the pattern crosses. Words that a
worker hasn't met are split by the pattern, and the distinct pieces of a batch
are merged together (``bpe.Merges``); the symbols that survive are counted.

Defined cases: a null or empty text has no bytes and no tokens; any length of
text is counted whole, a window of words at a time; repeated rows give a row
each; no documents give no rows; input columns named like an output are
replaced, all others are kept.
"""

from __future__ import annotations

from itertools import accumulate

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql.llm import bpe
from nestql.llm.common import map_texts, table, tidy, utf8

LIMIT = 1024
TOKENIZER = "byte_bpe_50k.json"


class Counter:
    def __init__(self, path: str):
        self.merges, self.added = bpe.from_json(path)
        #: Tokens of words: those met lately, and before them.
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if self.known and len(self.known) + len(new) > bpe.MEMORY:
            self.old, self.known, new = self.known, {}, words
        self.known |= {w: self.old[w] for w in new & self.old.keys()}
        order, strings, counts = bpe.pieces(new - self.known.keys(), bpe.other_in_tokenizers)
        distinct = [*dict.fromkeys(strings)]
        size = dict(zip(distinct, self.merges.ragged(distinct)[1].tolist(), strict=True))
        ends = list(accumulate(counts))
        total = [0, *accumulate(map(size.__getitem__, strings))]
        self.known |= {w: total[end] - total[end - n] for w, n, end in zip(order, counts, ends, strict=True)}

    def parts(self, text: str) -> tuple[list[str], int]:
        found, out = 0, [text]
        for token in self.added:
            if token in text:
                out = [p for x in out for p in x.split(token)]
        found = len(out) - 1
        return out, found

    def __call__(self, texts: list[str | None]) -> list[int]:
        split, totals = [], []
        for text in texts:
            parts, n = self.parts(text or "")
            if len(text or "") > bpe.WINDOW:
                for part in parts:
                    for window in bpe.windows(part):
                        words = bpe.WORD.findall(window)
                        self.learn(set(words))
                        n += sum(map(self.known.__getitem__, words))
                words = []
            else:
                words = bpe.WORD.findall(parts[0]) if len(parts) == 1 else [w for p in parts for w in bpe.WORD.findall(p)]
            split.append(words)
            totals.append(n)
        self.learn(set().union(*split))
        known = self.known.__getitem__
        return [n + sum(map(known, words)) for n, words in zip(totals, split, strict=True)]


def count_tokens(docs: DataFrame, *, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    path = path or public_tokenizers.path(TOKENIZER)

    def start():
        counter = Counter(path)

        def run(texts):
            counts = counter(texts)
            return [[len(utf8(t)) for t in texts], counts, [n > limit for n in counts]]

        return run

    return map_texts(tidy(docs, "text"), start, "n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tidy(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = count_tokens(docs.select("doc_id", F.col("text")))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
