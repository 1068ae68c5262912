"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits, one for each bit position that is set in over half
of the XXH64 values of a text's word shingles. Two fingerprints link at
``max_bits`` or fewer differing bits. The search over all distinct fingerprints:

1. statistics over all of them: how often each bit is set and each pair of
   bits agrees, and how many pairs collide on each part of each layout;
2. layouts of m parts, a part holding bits that correlate; dynamic programming
   deals unequal thresholds t to the parts, sum(t + 1) = max_bits + 1, so that
   any linked pair is within t on some part; the layout and thresholds with the
   lowest estimated cost of probes and candidates win;
3. probes: for a part of threshold t, the part's bits with each choice of t of
   them masked out, so a pair within t shares a probe; equal probes meet in one
   run of a sorted partition, where pairs are verified on all 64 bits. A run
   gives the edges of a spanning forest, not its pairs. Runs beyond ``tile``
   fingerprints are cut into blocks, and each pair of blocks is a run;
4. components by large-star and small-star rounds over those edges, written to
   the shared folder between rounds.

Exact copies share a fingerprint and are one node with their smallest
``doc_id``, however many they are.

Defined cases: a text without words (null, empty, blanks) has fingerprint zero,
which links like any other; fewer words than a shingle make one shingle of
them; a null ``doc_id`` has a fingerprint but no component (null); repeated rows
give a row each; no documents give no rows; extra columns aren't returned by
``fingerprints`` and ``components`` and are kept by ``drop_near_duplicates``;
texts of any length are fingerprinted whole, their hashes counted 65,536 at a
time.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from nestql.llm.common import OWN, map_texts, ship, table, tidy, utf8, written, written_at
from nestql.sources.scratch import removed

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of a run that one tile compares with each other.
TILE = 2048
#: Estimated microseconds for a probe row (made, dealt, sorted) and for a pair compared.
ROW_US, PAIR_US = 2.0, 0.02
#: Numbers of parts that are tried.
LAYOUTS = (3, 4, 5)

_FP, _ID, _V, _P, _A, _B = (OWN + x for x in ("fp", "id", "v", "part", "a", "b"))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    words = utf8(text).lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *ends[: n - shingle].tolist()]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long, a row for each document."""
    docs = tidy(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def start():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, start, f"{_FP} long", keep=["doc_id"])


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        n, gram = 0, np.zeros((64, 64))
        for batch in batches:
            v = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(v), 65536):
                bits = np.unpackbits(v[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                gram += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_pydict({"k": np.arange(4097), "x": np.append(gram.ravel().astype(np.int64), n)})

    out = StructType([StructField("k", LongType()), StructField("x", LongType())])
    rows = nodes.select(_FP).mapInArrow(run, out).groupBy("k").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r.k] = r.x
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def layout(gram: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal width, each grown from its most correlated bits."""
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, out))) // (parts - k)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(part) < width:
            rest = sorted(left - set(part))
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        left -= set(part)
        out.append(sorted(part))
    return out


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def collisions(nodes: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs of fingerprints that agree on a part, for each part of each layout, counted over all fingerprints."""
    keys = [(m, i) for m, parts in layouts.items() for i in range(len(parts))]
    cells = F.array(*[F.struct(F.lit(k).alias("p"), F.col(_FP).bitwiseAND(F.lit(signed(mask_of(layouts[m][i])))).alias("v")) for k, (m, i) in enumerate(keys)])
    counts = nodes.select(F.explode(cells).alias("c")).groupBy("c.p", "c.v").count()
    rows = counts.groupBy("p").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("e")).collect()
    return {keys[r.p]: r.e for r in rows}


def within(e0: float, bits: list[int], p: np.ndarray, t: int) -> float:
    """Estimated pairs within t on a part of which e0 pairs agree: bits are taken as independent."""
    same = np.clip(p[bits] ** 2 + (1 - p[bits]) ** 2, 1e-6, 1)
    poly = np.zeros(t + 1)
    poly[0] = 1
    for x in (1 - same) / same:
        poly[1:] += poly[:-1] * x
    return e0 * poly.sum()


def thresholds(parts: list[list[int]], e0: list[float], n: int, p: np.ndarray, max_bits: int) -> tuple[float, list[int]]:
    """Cost and thresholds (-1: the part is left out) of the cheapest deal with sum(t + 1) = max_bits + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, e in zip(parts, e0, strict=True):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, min(max_bits - used, 2, len(bits) - 1) + 1):
                more = 0.0 if t < 0 else n * comb(len(bits), t) * ROW_US + within(e, bits, p, t) * PAIR_US
                if used + t + 1 not in nxt or cost + more < nxt[used + t + 1][0]:
                    nxt[used + t + 1] = (cost + more, [*ts, t])
        best = nxt
    return best[max_bits + 1]


def plan(nodes: DataFrame, max_bits: int) -> list[int]:
    """The masks whose equal values are the probes."""
    n, gram = bit_statistics(nodes)
    p = np.diag(gram) / max(n, 1)
    layouts = {m: layout(gram, n, m) for m in sorted({*LAYOUTS, max_bits + 1})}
    e0 = collisions(nodes, layouts)
    deals = {m: thresholds(parts, [e0.get((m, i), 0.0) for i in range(m)], n, p, max_bits) for m, parts in layouts.items() if 3 * m >= max_bits + 1}
    m = min(deals, key=lambda k: deals[k][0])
    return [mask_of(set(bits) - set(out)) for bits, t in zip(layouts[m], deals[m][1], strict=True) if t >= 0 for out in combinations(bits, t)]


def forest(fps: np.ndarray, ids: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (smaller id, larger id) of a spanning forest of the links in one run."""
    n, out = len(fps), []
    left = np.ones(n, bool)
    while left.any():
        seed = int(left.argmax())
        left[seed] = False
        todo = [seed]
        while todo and left.any():
            i = todo.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[i]) <= max_bits))
            left[near] = False
            todo += near.tolist()
            out += [(int(ids[i]), int(ids[j])) for j in near]
    return [(min(e), max(e)) for e in out]


def links(nodes: DataFrame, *, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Edges between nodes (``_FP`` distinct, ``_ID``) that connect what links, a < b."""
    spark = nodes.sparkSession
    ship(spark)
    masks = plan(nodes, max_bits)
    probes = F.array(*[F.struct(F.lit(i).alias(_P), F.col(_FP).bitwiseAND(F.lit(signed(m))).alias(_V)) for i, m in enumerate(masks)])
    probes = nodes.select(_FP, _ID, F.explode(probes).alias("c")).select(f"c.{_P}", f"c.{_V}", _FP, _ID)
    blocks = (F.col("count") / tile).cast("int") + 1
    large = written(probes.groupBy(_P, _V).count().filter(F.col("count") > tile).select(_P, _V, blocks.alias(OWN + "n")), "large")
    at = OWN + "tile"
    if large.limit(1).count():
        n, own = F.col(OWN + "n"), F.pmod(F.xxhash64(F.lit(7), F.col(_FP)), F.coalesce(F.col(OWN + "n"), F.lit(1)))
        pair = F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1), lambda j: F.least(j, own) * 1_000_000 + F.greatest(j, own))
        probes = probes.join(large, [_P, _V], "left").withColumn(at, F.explode(pair)).select(_P, _V, at, _FP, _ID)
    else:
        probes = probes.select(_P, _V, F.lit(0).cast("long").alias(at), _FP, _ID)
    dealt = probes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _P, _V, at).sortWithinPartitions(_P, _V, at)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def edges(cols, last: bool):
            p, v, t, fps, ids = cols
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (v[1:] != v[:-1]) | (t[1:] != t[:-1])) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(p))
            rest = None
            if not last:
                rest = tuple(c[starts[-1] :] for c in cols)
                starts, ends = starts[:-1], ends[:-1]
            two = np.flatnonzero(ends - starts == 2)
            a, b = starts[two], starts[two] + 1
            near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            lo, hi = np.minimum(ids[a], ids[b])[near], np.maximum(ids[a], ids[b])[near]
            out = list(zip(lo.tolist(), hi.tolist(), strict=True))
            for k in np.flatnonzero(ends - starts > 2):
                s, e = starts[k], ends[k]
                out += forest(fps[s:e], ids[s:e], max_bits)
            return out, rest

        def batch_of(out):
            return pa.RecordBatch.from_pydict({_A: pa.array([x for x, _ in out], pa.int64()), _B: pa.array([y for _, y in out], pa.int64())})

        rest = None
        for batch in batches:
            cols = tuple(np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            cols = cols[:3] + (cols[3].view(np.uint64), cols[4])
            held = [rest] if rest is not None else []
            cols = tuple(np.concatenate(x) for x in zip(*held, cols, strict=True)) if held else cols
            if len(cols[0]):
                out, rest = edges(cols, False)
                yield batch_of(out)
        if rest is not None and len(rest[0]):
            yield batch_of(edges(rest, True)[0])

    schema = StructType([StructField(_A, LongType()), StructField(_B, LongType())])
    return dealt.mapInArrow(run, schema).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """For each id in ``edges`` but the smallest of its component, that smallest id: (``_B``, ``_A``).

    Rounds of large-star and small-star; the minima are a written table, so a
    join with a hub's edges is one that Spark can split.
    """
    spark, made = edges.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        out, path = written_at(df, what)
        made.append(path)
        return out

    edges = kept(edges.filter(F.col(_A) != F.col(_B)), "edges")
    least = OWN + "least"

    def minima(pairs: DataFrame) -> DataFrame:
        return kept(pairs.groupBy(_A).agg(F.least(F.min(_B), F.col(_A)).alias(least)), "minima")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(_A, _B).cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        done, made = made, []
        both = edges.unionByName(edges.select(F.col(_B).alias(_A), F.col(_A).alias(_B)))
        # large star: every larger neighbour of a node goes to the node's minimum
        star = both.filter(F.col(_B) > F.col(_A)).join(minima(both), _A).select(F.col(least).alias(_A), _B)
        star = kept(star.filter(F.col(_A) != F.col(_B)).distinct(), "star")
        # small star: a node and its smaller neighbours go to their minimum
        down = star.select(F.col(_B).alias(_A), F.col(_A).alias(_B))
        low = minima(down)
        small = down.join(low, _A).select(F.col(least).alias(_A), F.explode(F.array(_A, _B)).alias(_B))
        edges = kept(small.filter(F.col(_A) != F.col(_B)).distinct(), "edges")
        after = mark(edges)
        for path in done:  # of the round before
            removed(spark, path)
        if after == before:
            break
        before = after
    for path in made[:-1]:
        removed(spark, path)
    return edges


def components(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (signed long) and ``component_id`` of every document."""
    prints = written(fingerprints(docs, shingle=shingle), "prints")
    nodes = prints.filter(F.col("doc_id").isNotNull()).groupBy(_FP).agg(F.min("doc_id").alias(_ID))
    nodes = written(nodes, "nodes")
    labels = component_labels(links(nodes, max_bits=max_bits, tile=tile))
    label = labels.select(F.col(_B).alias(_ID), F.col(_A).alias(OWN + "to"))
    of_fp = nodes.join(label, _ID, "left").select(_FP, F.coalesce(OWN + "to", _ID).alias("component_id"))
    out = prints.join(of_fp, _FP, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col(_FP).alias("fingerprint"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays: the smallest ``doc_id``, and one row of it; rows with a null ``doc_id`` stay."""
    docs = tidy(docs, "doc_id", "text")
    found = written(components(docs, shingle=shingle, max_bits=max_bits), "components")
    stay = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count()
    again = stay.filter(F.col("count") > 1).limit(1).count() > 0
    kept = docs.join(stay.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if again:
        kept = kept.dropDuplicates(["doc_id"])
    if found.filter(F.col("doc_id").isNull()).limit(1).count():
        kept = kept.unionByName(docs.filter(F.col("doc_id").isNull()))
    return kept


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
