"""Byte-level BPE encoding by overlapping chunks, and decoding.

Every text is cut into chunks that overlap. Each chunk is pre-tokenised from its
own start, whatever it starts in the middle of: into words, whose edges no match
of the pattern crosses. Neighbouring chunks are stitched at the first edge in
their overlap that both have, from which they agree: the words of one hold up to
it and those of the next from it. A chunk's last word may be cut short by the
chunk's end, so its end doesn't count. Where an overlap has no common edge, as a
word spans it, the text is split again from the last certain edge, over a length
that doubles until a word ends within it. The words are then encoded, each
distinct one of a batch once: by the pattern's matches, all merged together.

A text of more than ``SEGMENT`` characters is dealt out: its segments overlap as
chunks do, are split in tasks of their own, and are stitched by the edges in
their overlaps alone, which a window compares; the pieces between the stitches
are encoded in tasks of their own again, and their ids joined. Decoding
concatenates the bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts
of any length are encoded whole; repeated rows give a row each; no documents
give no rows; null ids decode to no bytes; input columns named like an output
are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestql.llm import bpe
from nestql.llm.common import OWN, give_back, map_texts, ship, small_batches, table, tidy, with_outputs, written

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 2048, 128
#: Characters of a text beyond which it is dealt out, in segments of so many.
SEGMENT = 32_768

_UID, _K, _START, _PART, _SIZES, _HEAD, _TAIL, _RUN, _CUT, _IDS, _N = (OWN + x for x in ("uid", "k", "start", "part", "sizes", "head", "tail", "run", "cut", "ids", "n"))


class Encoder:
    """Ids of words, with a memory of those that a worker has met lately."""

    def __init__(self, path: str):
        self.merges, self.ranks = bpe.from_ranks(path)
        self.single = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, strings: list[bytes]) -> list[bytes]:
        """Ids of each match, as little-endian 32-bit integers: its own where it is a token, else by merging."""
        out = [*map(self.single.get, strings)]
        rest = {s: b"" for s, x in zip(strings, out, strict=True) if x is None}
        flat, sizes = self.merges.ragged([*rest])
        ids, at = flat.astype("<u4").tobytes(), 0
        for s, n in zip(rest, (4 * sizes).tolist(), strict=True):
            rest[s] = ids[at : at + n]
            at += n
        return [rest[s] if x is None else x for s, x in zip(strings, out, strict=True)]

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if self.known and len(self.known) + len(new) > bpe.MEMORY:
            self.old, self.known, new = self.known, {}, words
        self.known |= {w: self.old[w] for w in new & self.old.keys()}
        order, strings, counts = bpe.pieces(new - self.known.keys(), bpe.other_in_tiktoken)
        ids, at = self.pieces(strings), 0
        for w, n in zip(order, counts, strict=True):
            self.known[w] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n

    def encode(self, split: list[list[str]]) -> list[bytes]:
        """Ids of each list of words as little-endian 32-bit integers."""
        self.learn(set().union(*split))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def texts(self, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[bytes]:
        """Ids of whole texts."""
        return self.encode([words_of(t, chunk, overlap) if t else [] for t in texts])


def decoded(ids: bytes | None, words: list[bytes]) -> bytes:
    """The bytes of ids, joined."""
    return b"".join([words[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Start and characters of each chunk; the last ends with the text."""
    at = 0
    while True:
        yield at, text[at : at + size + overlap]
        at += size
        if at + overlap >= len(text):
            return


def edges_after(words: list[str], end: int, least: int) -> dict[int, int]:
    """Edges beyond ``least`` of a chunk that ends at ``end``, but that end: place -> number of words before it."""
    out = {}
    for i in range(len(words) - 1, 0, -1):
        end -= len(words[i])
        if end <= least:
            break
        out[end] = i
    return out


def first_edge(words: list[str], start: int, of: dict[int, int]) -> tuple[int, int] | None:
    """The first edge of a chunk that ``of`` has too: its place and the number of words before it."""
    last = max(of, default=start)
    for j, w in enumerate(words, 1):
        start += len(w)
        if start > last:
            return None
        if start in of:
            return start, j
    return None


def words_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The words of a text, by chunks."""
    parts = list(chunks(text, chunk, overlap))
    split = [bpe.WORD.findall(p) for _, p in parts]
    out, words, skip = [], split[0], 0
    end = len(parts[0][1])
    for (start, part), nxt in zip(parts[1:], split[1:], strict=True):
        if start + len(part) <= end:  # within what was split again
            continue
        of = edges_after(words, end, start)
        met = first_edge(nxt, start, of)
        if met:
            out += words[skip : of[met[0]]]
            words, skip, end = nxt, met[1], start + len(part)
            continue
        # a word spans the overlap: on from the last certain edge
        out += words[skip:-1]
        at, least = end - len(words[-1]), start + len(part)
        if len(words) - 1 < skip:
            raise AssertionError("a chunk's words are used up")
        size = least - at
        while True:
            words, skip = bpe.WORD.findall(text[at : at + size]), 0
            end = min(at + size, len(text))
            if len(words) > 1 or end == len(text):
                break
            size *= 2
    return out + words[skip:]


def encode(docs: DataFrame, *, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (binary: little-endian 32-bit integers)."""
    path = path or public_tokenizers.path(RANKS)
    spark = docs.sparkSession
    added = "n_tokens long, ids binary"
    docs = tidy(docs, "text")

    def start():
        own = Encoder(path)

        def run(texts):
            ids = own.texts(texts, chunk, overlap)
            return [[len(x) // 4 for x in ids], ids]

        return run

    is_long = F.coalesce(F.length("text"), F.lit(0)) > segment
    short = map_texts(docs.filter(~is_long), start, added)
    long = written(docs.filter(is_long).withColumn(_UID, F.monotonically_increasing_id()), "long")
    if long.isEmpty():
        return short
    made = dealt(long.select(_UID, "text"), path, chunk, overlap, segment)
    return short.unionByName(long.join(made, _UID).select(*with_outputs(docs, ("n_tokens", "ids")), made["n_tokens"], made["ids"]))


def dealt(long: DataFrame, path: str, chunk: int, overlap: int, segment: int) -> DataFrame:
    """``n_tokens`` and ``ids`` of each ``_UID``, by tasks that each hold a segment at a time."""
    spark = long.sparkSession
    ship(spark)
    small_batches(spark)

    def cut(batches):
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (at, part) in enumerate(chunks(text.as_py(), segment, overlap)):
                    yield pa.RecordBatch.from_pydict({_UID: [uid], _K: pa.array([k], pa.int32()), _START: [at], _PART: [part]})

    def split(batches):
        for batch in batches:
            for uid, k, at, part in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                words = words_of(part, chunk, overlap)
                sizes = list(map(len, words))
                ends = (at + np.cumsum(sizes)).tolist()
                head = [e for e in ends[:-1] if e <= at + 2 * overlap]
                tail = [e for e in ends[:-1] if e > at + segment]
                yield pa.RecordBatch.from_pydict({_UID: [uid], _K: pa.array([k], pa.int32()), _START: [at], _PART: [part], _SIZES: pa.array([sizes], pa.list_(pa.int32())), _HEAD: pa.array([head], pa.list_(pa.int64())), _TAIL: pa.array([tail], pa.list_(pa.int64()))})

    schema = f"{_UID} long, {_K} int, {_START} long, {_PART} string"
    parts = long.mapInArrow(cut, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _UID, _K)
    parts = written(parts.mapInArrow(split, f"{schema}, {_SIZES} array<int>, {_HEAD} array<long>, {_TAIL} array<long>"), "split")

    # stitches: the first edge that a segment and the one before it have in their overlap; a run of segments without one stays together
    along = Window.partitionBy(_UID).orderBy(_K)
    met = F.when(F.col(_K) == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag(_TAIL).over(along), F.col(_HEAD))))
    marks = parts.select(_UID, _K, _HEAD, _TAIL).withColumn(_CUT, met).withColumn(_RUN, F.count(_CUT).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marks.groupBy(_UID, _RUN).agg(F.max(_CUT).alias(_CUT), F.count("*").alias(_N))
    runs = runs.withColumn(OWN + "end", F.lead(_CUT).over(Window.partitionBy(_UID).orderBy(_RUN)))
    of = marks.select(_UID, _K, _RUN).join(runs, [_UID, _RUN])
    pieces = parts.join(of, [_UID, _K]).select(_UID, _RUN, _CUT, OWN + "end", _N, _K, _START, _PART, _SIZES)

    def ids_of(encoder: Encoder, words: list[str], at: int, cut: int, end: int | None) -> bytes:
        ends = at + np.cumsum(list(map(len, words)))
        first = int(np.searchsorted(ends, cut, side="right"))
        last = len(words) if end is None else int(np.searchsorted(ends, end, side="right"))
        return encoder.encode([words[first:last]])[0]

    def single(batches):
        encoder = Encoder(path)
        yield from each(encoder, batches)
        del encoder
        give_back()

    def each(encoder, batches):
        for batch in batches:
            for uid, run, cut, end, _, _, at, part, sizes in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                places = np.cumsum([0, *sizes]).tolist()
                words = [part[a:b] for a, b in zip(places, places[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({_UID: [uid], _RUN: [run], _IDS: [ids_of(encoder, words, at, cut, end)]})

    def several(key, frame):
        import pandas as pd

        frame = frame.sort_values(_K)
        text = "".join([p[:segment] for p in frame[_PART][:-1]]) + frame[_PART].iloc[-1]
        end = frame[OWN + "end"].iloc[0]
        ids = ids_of(Encoder(path), words_of(text, chunk, overlap), int(frame[_START].iloc[0]), int(frame[_CUT].iloc[0]), None if pd.isna(end) else int(end))
        return pd.DataFrame({_UID: [key[0]], _RUN: [key[1]], _IDS: [ids]})

    out = f"{_UID} long, {_RUN} long, {_IDS} binary"
    found = pieces.filter(F.col(_N) == 1).mapInArrow(single, out)
    found = found.unionByName(pieces.filter(F.col(_N) > 1).groupBy(_UID, _RUN).applyInPandas(several, out))
    joined = F.expr(f"listagg({_IDS}) WITHIN GROUP (ORDER BY {_RUN})")
    return found.groupBy(_UID).agg(joined.alias("ids")).select(_UID, (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(df: DataFrame, *, path: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of ``ids``."""
    path = path or public_tokenizers.path(RANKS)

    def start():
        words = bpe.words_of(path)
        return lambda ids: [[decoded(x, words) for x in ids]]

    return map_texts(tidy(df, "ids"), start, "decoded binary", text="ids")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tidy(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text")
    out = decode(encode(docs).select("doc_id", "n_tokens", "ids"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
