"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

A block of candidate vectors is indexed once by quantised impact: a magnitude is
the sum of its impacts, powers of two, and the posting segment of an impact and
a dimension lists the candidates whose component there has that impact, with
their sign. Queries process the impacts in descending order, for each the
segments of the dimensions they use, and add to the candidates' sums. Where a
quarter and more of a block's components share an impact, its segments are laid
out side by side as a matrix of signs, and queries process them by a product.

What a candidate may still gain or lose is bounded by Cauchy-Schwarz: the norm
of its impacts that aren't processed times the norm of the query, plus what
floating-point sums can be off: each adds at most 4096 * 64 products, so by less
than 2^-34 of the product of norms. Processing stops for a query only when
these bounds prove that few candidates can be members of its top k, or at the
end; the exact scores of those that may be members then decide.

Queries in blocks meet candidates in blocks; a pair of blocks is one group,
whose size the parameters bound, and yields at most k rows a query. The k best
of these over all blocks are the result, by a window that keeps k rows a query
before its shuffle.

Components are floor(1024 * x) as integers. Sums are exact in 64 bits: vectors
whose components would overflow it are multiplied as Python integers, and a
score beyond 64 bits is held at the limit.

Defined cases: vectors that are null or hold null or non-finite components take
no part; an empty vector, and components that a shorter vector lacks, count as
zero; a vector much longer than its block's others stays out of the index and is
scored with every query by itself, so it lengthens none of them; ids that are
null take no part; a repeated id counts once for each row, and a query's own id,
in whatever rows, is no candidate of its; ties go to the smaller id; no vectors
give no rows; extra columns aren't read.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestql.llm.common import OWN, ship, table, tidy

K = 10
EVERY = 100
SCALE = 1024
#: Queries and candidates of one pair of blocks.
QUERY_BLOCK, BLOCK = 4096, 4096
#: Candidates that may be members when processing stops, as a multiple of k.
RESCORE = 8
#: Levels that are processed before the first look at the bounds.
UNSEEN = 5
#: Queries that process a segment at once.
TOGETHER = 256
#: Of a block's components, the part that shares an impact from which its segments are a matrix: one in so many.
DENSE = 4
#: What sums of floating-point products may be off, relative to the product of norms: at most 2^18 roundings of 2^-53 each.
OFF = 2.0**-34
#: Longest vector of an index, and the padding that an index may need as a multiple of what vectors hold.
WIDEST, PADDING = 4096, 8
#: Magnitude of components up to which a product sum of 64-bit integers can't overflow in 4096 dimensions.
SAFE = 1 << 25
_MOST = (1 << 63) - 1

_QB, _CB, _ROLE, _X, _N = (OWN + x for x in ("qb", "cb", "role", "x", "n"))


class Index:
    """Posting segments of a block of integer vectors (rows), by impact level and dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        if x.dtype == object:
            return
        magnitude, sign = np.abs(x), np.sign(x).astype(np.int8)
        self.levels = int(magnitude.max(initial=0)).bit_length()
        #: For each level: signs as a matrix, or (ends of the dimensions' lists, candidates, signs).
        self.segments: list[np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: For each level: the norm of what the levels below it hold of each candidate.
        self.rests = []
        for level in range(self.levels):
            held = ((magnitude >> level) & 1).astype(bool)
            if np.count_nonzero(held) * DENSE >= held.size:
                self.segments.append(np.where(held, sign, np.int8(0)))
            else:
                dims, rows = np.nonzero(held.T)
                self.segments.append((np.cumsum(np.bincount(dims, minlength=x.shape[1])), rows.astype(np.int32), sign[rows, dims]))
            self.rests.append(norms(magnitude & ((1 << level) - 1)))
        self.size = norms(magnitude)

    def process(self, sums: np.ndarray, weight: np.ndarray, level: int) -> None:
        """Add to the sums (query x candidate) what the segments of a level hold."""
        segment, impact = self.segments[level], float(1 << level)
        if isinstance(segment, np.ndarray):
            used = weight.any(axis=0)
            if used.all():
                sums += (weight * impact) @ segment.T.astype(np.float64)
            elif used.any():
                sums += (weight[:, used] * impact) @ segment[:, used].T.astype(np.float64)
            return
        ends, rows, signs = segment
        start = 0
        for d, end in enumerate(ends.tolist()):
            if end > start:
                asks = np.flatnonzero(weight[:, d])
                if len(asks):  # a list holds a candidate once
                    sums[np.ix_(asks, rows[start:end])] += np.outer(weight[asks, d] * impact, signs[start:end])
            start = end

    def members(self, q: np.ndarray, k: int, own: list[np.ndarray]) -> list[np.ndarray]:
        """For each query (row of q) the rows that may be among its k best; ``own`` rows are not candidates."""
        n, few = len(self.x), RESCORE * k
        out: list[np.ndarray] = [np.delete(np.arange(n), own[i]) for i in range(len(q))]
        if self.x.dtype == object or q.dtype == object or n <= few:
            return out
        asked = np.array([i for i in range(len(q)) if len(out[i]) > few], np.int64)
        weight = q.astype(np.float64)
        norm = norms(q)
        sums = np.zeros((len(asked), n))
        for i, a in enumerate(asked):
            sums[i, own[a]] = -np.inf
        for level in range(self.levels - 1, -1, -1):
            self.process(sums, weight[asked], level)
            if level and self.levels - level < UNSEEN:
                continue  # no bound can prove much yet
            bound = norm[asked][:, None] * (self.rests[level] + OFF * self.size)[None, :] * (1 + OFF)
            need = np.partition(sums - bound, n - k, axis=1)[:, n - k]
            may = sums + bound >= np.maximum(need, -1e300)[:, None]
            ended = (may.sum(axis=1) <= few) | (level == 0)
            for i in np.flatnonzero(ended):
                out[asked[i]] = np.flatnonzero(may[i])
            asked, sums = asked[~ended], sums[~ended]
            if not len(asked):
                break
        return out

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        part = self.x[rows]
        if self.x.dtype == object or q.dtype == object:
            return np.array([held(sum(int(a) * int(b) for a, b in zip(r, q, strict=True))) for r in part], np.int64)
        return part @ q

    def best(self, q: np.ndarray, k: int, rows: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
        """(score, id) of the k best of some rows, ties to smaller ids."""
        scores = self.exact(q, rows)
        order = np.lexsort((ids[rows], -scores.astype(np.float64) if scores.dtype == object else ~scores))[:k]
        return [(int(scores[i]), int(ids[rows[i]])) for i in order]


def norms(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", y, y))


def width_of(lengths: np.ndarray) -> int:
    """The longest vector that an index takes in: padding others to it must not make the index much larger than its vectors."""
    ordered = np.sort(lengths[lengths <= WIDEST])
    fits = np.flatnonzero(ordered * np.arange(1, len(ordered) + 1) <= PADDING * np.cumsum(ordered))
    return int(ordered[fits[-1]]) if len(fits) else 0


def scaled(vector) -> list[int]:
    """The quantised components of one vector as Python integers."""
    return [int(v) for v in np.floor(np.asarray(vector, np.float64) * SCALE).tolist()]


def held(score: int) -> int:
    return min(max(score, -_MOST - 1), _MOST)


def matrix(values, width: int) -> np.ndarray:
    """Quantised vectors as rows; Python integers where 64-bit sums could overflow."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : min(len(v), width)] = v[:width]
    out = np.floor(out * SCALE)
    if np.abs(out).max(initial=0.0) <= SAFE and width <= 4096:
        return out.astype(np.int64)
    whole = np.empty(out.shape, object)
    for i, row in enumerate(out.tolist()):
        whole[i] = [int(v) for v in row]
    return whole


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k best candidates of each query: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    ship(spark)

    def clean(df: DataFrame) -> DataFrame:
        df = tidy(df, id_column, vector_column)
        x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
        df = df.select(F.col(id_column).cast("long").alias(_N), x.alias(_X))
        sound = F.forall(_X, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.filter(F.col(_N).isNotNull() & F.col(_X).isNotNull() & sound)

    vectors, queries = clean(vectors), clean(queries)
    sizes = vectors.agg(F.count("*").alias("n")).first()
    asked = queries.count()
    n_blocks, n_query = max(1, -(-sizes.n // block)), max(1, -(-asked // query_block))
    # ids are dealt by hash, so each block holds about as many; a pair of blocks is a group
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col(_N)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(every(n_query).alias(_QB), deal(n_blocks, 3).alias(_CB), F.lit(0).alias(_ROLE), _N, _X)
    right = queries.select(deal(n_query, 5).alias(_QB), every(n_blocks).alias(_CB), F.lit(1).alias(_ROLE), _N, _X)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        role = frame[_ROLE].to_numpy()
        ids, values = frame[_N].to_numpy(), frame[_X].to_numpy()
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        cand, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        rows = []
        width = width_of(lengths[cand])
        long = cand[lengths[cand] > width]
        cand = cand[lengths[cand] <= width]
        cand = cand[np.argsort(ids[cand], kind="stable")]
        index, own_ids = Index(matrix(values[cand], width)), ids[cand]
        for at in range(0, len(asks) if len(cand) else 0, TOGETHER):
            some = asks[at : at + TOGETHER]
            q = matrix(values[some], width)
            if q.dtype != index.x.dtype:
                q = q.astype(object)
            own = [np.arange(*np.searchsorted(own_ids, [ids[a], ids[a] + 1])) for a in some]
            for i, members in enumerate(index.members(q, k, own)):
                rows += [(int(ids[some[i]]), v, s) for s, v in index.best(q[i], k, members, own_ids)]
        for c in long:  # few, or few rows fit in their block
            x = scaled(values[c])
            rows += [(int(ids[a]), int(ids[c]), held(sum(map(mul, x, scaled(values[a][: len(x)]))))) for a in asks if ids[a] != ids[c]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    pairs = left.unionByName(right).groupBy(_QB, _CB)
    found = pairs.applyInPandas(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = {
    "op1_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
