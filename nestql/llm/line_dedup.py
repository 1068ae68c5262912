"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

Documents are taken in batches of ascending ``doc_id``. A batch's line keys are
hashed to 128 bits and reduced to their first holder, which deals them out as
runs are; keys that an earlier run holds leave by a merge anti-join, the rest
become a new run: a table bucketed and sorted by hash, a file a bucket, so that
joins read runs as they lie, without an exchange or a sort. Runs of one level are compacted into one of the next when
``fanout`` of them have gathered. As batches ascend, a key sits in exactly one
run, with the smallest ``doc_id`` that holds it. A line goes if its
(hash, document) isn't in the runs; this anti-join is keyed by document too, so
a line shared by a third of all documents is dealt over all tasks.

Defined cases: a null or empty text is one empty line; rows with a null
``doc_id`` count as one document after all others; rows repeated with one
``doc_id`` count as one document, so its rows keep their lines; no documents
give no rows; extra columns are kept, those named like an output or like this
package's own columns are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql.llm.common import BLANKS, LOWER, OWN, UPPER, table, tidy, with_outputs, written
from nestql.sources.scratch import removed, scratch_path

MIN_CHARS = 10
#: Batches at least, and documents of a batch at most.
BATCHES, BATCH_DOCS = 4, 200_000_000
FANOUT = 2

_H1, _H2, _DOC, _TEXT, _POS, _BATCH = (OWN + x for x in ("h1", "h2", "doc", "of", "pos", "batch"))
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The key of a line whose letters A-Z have been lower-cased."""
    return F.trim(line, F.lit(BLANKS))


@contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile take the order of a bucket's one file as given."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Runs:
    """Levelled sorted runs: (hash, first holder), each key in one run."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"nestql_run_{uuid.uuid4().hex[:12]}"
        self.paths[name] = scratch_path(self.spark, "run")
        dealt = df.repartition(self.buckets, _H1, _H2)
        dealt.write.bucketBy(self.buckets, _H1, _H2).sortBy(_H1, _H2).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, self.paths.pop(name))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch's keys (one row each), but for those that a run holds."""
        for name in self.names():
            keys = keys.join(self.spark.table(name), [_H1, _H2], "left_anti")
        self.levels = self.levels or [[]]
        self.levels[0].append(self._write(keys))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged, self.levels[at] = self.levels[at], []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(self.rows(merged)))
            for name in merged:
                self._drop(name)
            at += 1

    def rows(self, names: list[str] | None = None) -> DataFrame:
        frames = [self.spark.table(n) for n in (names or self.names())]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def drop(self) -> None:
        for name in [*self.paths]:
            self._drop(name)
        self.levels = []


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    docs = tidy(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(_DOC), F.xxhash64(text).alias(_TEXT)]

    seen = docs.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [i / 1000 for i in range(1, 1000)], 10_000).alias("q")).first()
    n = max(batches, -(-seen.n // BATCH_DOCS)) if batches > 1 else 1
    bounds = sorted({int(seen.q[min(998, 1000 * i // n - 1)]) for i in range(1, n)} if seen.q else set())
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col(_DOC) > b).cast("int")
    lines = docs.select(*own, F.posexplode(F.split(F.translate(text, UPPER, LOWER), "\n", -1)).alias(_POS, "line"))
    lines = lines.select(_DOC, _TEXT, _POS, line_key(F.col("line")).alias("k")).filter(F.length("k") >= min_chars)
    lines = lines.select(_DOC, _TEXT, _POS, F.xxhash64("k").alias(_H1), F.xxhash64(F.lit(1), F.col("k")).alias(_H2), batch.alias(_BATCH))
    path = scratch_path(spark, "lines")
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    try:
        lines.write.partitionBy(_BATCH).parquet(path)
        lines = spark.read.schema(lines.schema).parquet(path)
        with ordered_buckets(spark):
            for i in range(len(bounds) + 1):
                of_batch = lines.filter(F.col(_BATCH) == i)
                runs.add(of_batch.groupBy(_H1, _H2).agg(F.min(_DOC).alias(_DOC)))
            gone = lines.join(runs.rows(), [_H1, _H2, _DOC], "left_anti")
            gone = written(gone.groupBy(_DOC, _TEXT).agg(F.collect_set(_POS).alias(OWN + "gone")), "gone")
    finally:
        runs.drop()
        removed(spark, path)

    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(OWN + "gone"))
    joined = docs.withColumns({_DOC: own[0], _TEXT: own[1]}).join(gone, [_DOC, _TEXT], "left")
    joined = joined.withColumn(OWN + "parts", parts)
    none = F.col(OWN + "gone").isNull()
    return joined.select(
        *with_outputs(docs, ("kept_text", "n_lines", "n_dropped")),
        F.when(none, text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(OWN + "parts"), i)), "\n")).alias("kept_text"),
        F.size(OWN + "parts").cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size(OWN + "gone")).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k
), flagged AS (
  SELECT keyed.*, coalesce(first_id <> doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
}
