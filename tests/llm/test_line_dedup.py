import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from nestql.llm import line_dedup as L
from nestql.sources.scratch import scratch_path

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least=10):
    """doc_id, text -> lines before, lines dropped, text kept; None counts as the last document."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(BLANK)
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), float("inf")), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 9)])
def test_cases(spark, batches, fanout):
    rows = [(i, f"shared line of all\nown line number {i}\nshort\n  SHARED Line of All \r") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (60, "ÉTÉ à la plage\nété à la plage"), (61, "été à la plage\tx"), (62, "ÉTÉ à la plage"), (63, "tie tie tie tie"), (63, "tie tie tie tie"), (64, "tie tie tie tie\nétés à la plage")]
    rows += [(None, "shared line of all\nonly without an id"), (None, "only without an id\nx"), (70, "long line of text\n" * 3000 + "own own own own"), (71, "a" * 200_000), (72, "a" * 200_000 + "\n\n")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, N_lines string, __nq_pos string")
    out = L.dedup_lines(df, batches=batches, fanout=fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str) == brute(rows)
    assert L.dedup_lines(df.limit(0), batches=batches).collect() == []


def test_runs_hold_each_key_once(spark):
    runs = L.Runs(spark, 2, 2)
    for at, keys in enumerate([[1, 2], [2, 3], [], [3, 4], [1, 5]]):
        runs.add(spark.createDataFrame([(k, k, at) for k in keys], f"{L._H1} long, {L._H2} long, {L._DOC} long"))
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted((r[L._H1], r[L._DOC]) for r in runs.rows().collect()) == [(1, 0), (2, 0), (3, 1), (4, 3), (5, 4)]
    runs.drop()


def test_runs_are_read_as_they_lie(spark):
    """A merge anti-join neither deals a run out again nor sorts it."""
    runs = L.Runs(spark, 4, 9)
    keys = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias(L._H1), F.xxhash64(F.lit(1), "id").alias(L._H2), F.col("id").alias(L._DOC))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with L.ordered_buckets(spark):
            runs.add(keys(0, 500))
            runs.add(keys(300, 900).groupBy(L._H1, L._H2).agg(F.min(L._DOC).alias(L._DOC)))
            more = keys(700, 1200).groupBy(L._H1, L._H2).agg(F.min(L._DOC).alias(L._DOC))
            for name in runs.names():
                more = more.join(spark.table(name), [L._H1, L._H2], "left_anti")
            plan = more._jdf.queryExecution().executedPlan().toString()
            got = more.count()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan
        assert got == 300 and runs.rows().count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        runs.drop()


def test_failures_leave_no_tables(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    df = spark.range(40).selectExpr("id as doc_id", "concat('a line of some length ', id) as text")
    root = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    held = set(os.listdir(root))
    real, calls = L.Runs.add, []

    def failing(self, keys):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(self, keys)

    L.Runs.add = failing
    try:
        with pytest.raises(RuntimeError):
            L.dedup_lines(df)
    finally:
        L.Runs.add = real
    assert {t.name for t in spark.catalog.listTables()} == before and set(os.listdir(root)) == held
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_batches_hold_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(L, "BATCH_DOCS", 7)
    rows = [(i, f"shared line of all\nline of {i // 3} and others\nown line number {i}") for i in range(100)]
    met, real = [], L.Runs.add
    monkeypatch.setattr(L.Runs, "add", lambda self, keys: met.append(1) or real(self, keys))
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(met) == 15
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str) == brute(rows)


def test_main_path_is_native(spark, sf_dir):
    plan = L.op3_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark, sf_dir):
    out = L.op3_line_dedup(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(L.SQL["op3_line_dedup"]).df()
    assert sorted(map(tuple, out[sorted(out)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, _, _, t in brute(list(texts.items()))} == set(zip(out.doc_id, out.kept_sha256))
