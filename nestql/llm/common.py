"""Helpers shared by the operators: tidy inputs, scratch tables, Arrow mapping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql.sources.scratch import scratch_path

#: Prefix of the columns that operators add for their own use.
OWN = "__nq_"
#: Rows of an Arrow batch that Python code holds as objects at one time.
SLICE_ROWS = 256
#: Characters of text that Python code holds as objects at one time (one text may exceed it alone).
SLICE_CHARS = 4_000_000
#: Bytes of an Arrow batch on its way between Spark and Python.
BATCH_BYTES = 4 << 20
#: White space of the contracts: blank and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with unambiguous names.

    Of columns whose names differ in case at most, an exact match of a needed
    name stays, else the first; columns under this package's own prefix go. A
    needed column that is missing is added as null.
    """
    wanted = {n.lower(): n for n in needed}
    chosen: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        low = name.lower()
        if low.startswith(OWN):
            continue
        exact = wanted.get(low) == name
        if low not in chosen or (exact and df.columns[chosen[low]] != name):
            chosen[low] = i
    flat = df.toDF(*[f"{OWN}{i}" for i in range(len(df.columns))])
    kept = [F.col(f"{OWN}{i}").alias(wanted.get(low, df.columns[i])) for low, i in chosen.items()]
    types = {"doc_id": "long", "page_id": "long", "vec_id": "long", "embedding": "array<float>"}
    kept += [F.lit(None).cast(types.get(n, "string")).alias(n) for low, n in wanted.items() if low not in chosen]
    return flat.select(*kept)


def with_outputs(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns of ``df`` that outputs named ``names`` don't replace."""
    low = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    return written_at(df, what)[0]


def written_at(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """As ``written``, and the path, for tables that are removed before the driver ends."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Give executors this package, whether or not it is on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="nestql-code-"), "nestql_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def slices(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are small enough to be held as Python objects."""
    if text is None:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= SLICE_ROWS or total + n > SLICE_CHARS):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others that need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, func: Callable, added: str, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns computed from a text column, whole texts, a bounded slice at a time.

    ``func()`` is called once a task and returns ``f(texts) -> list of columns``
    in the order of ``added`` (a DDL string); ``texts`` holds None for null.
    ``keep`` lists the columns carried along (default: all).
    """
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    carried = [c for c in (keep if keep is not None else df.columns) if c.lower() not in {f.name.lower() for f in new}]
    frame = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias(f"{OWN}text"))
    out = StructType([frame.schema[c] for c in carried] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, f = to_arrow_schema(out), None
        try:
            for whole in batches:
                for batch in slices(whole, f"{OWN}text"):
                    f = f or func()
                    columns = f(batch.column(f"{OWN}text").to_pylist())
                    arrays = [batch.column(c) for c in carried]
                    arrays = [a.cast(field.type) if a.type != field.type else a for a, field in zip(arrays, schema, strict=False)]
                    arrays += [pa.array(v, type=field.type) for v, field in zip(columns, list(schema)[len(carried) :], strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            f = None
            give_back()

    return frame.mapInArrow(run, out)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
