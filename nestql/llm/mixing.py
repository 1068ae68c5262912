"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token sums
are raked: scaled in turn so that the sums by source, by language and by topic
meet their targets, for ``ROUNDS`` rounds. A cell's raked sum over its own one is
its weight; one factor turns weights into probabilities, at most 1, whose
expected tokens are the share ``KEEP`` of all. A document is kept if a number
drawn from its id by a hash is below its cell's probability, so a draw repeats.

Targets are shares for each margin; where none are given, they are the corpus's
own shares to the power ``TEMPER``, normalised, which lifts the small ones.

The cut at 1 leaves cells that should rise by more than 1 / ``KEEP`` short of the
raked sums, and the mix nearer to the corpus than the targets are. ``calibrated``
rakes under that bound: a cell's sum is the smaller of its bound and its own sum
times the factors of its source, language and topic, which are set in rounds
until the sums by margin meet the targets to ``TOLERANCE``. ``reach`` lowers the
kept share to what the targets allow: a value of a margin can fill its target
only if the kept share is at most its own share over its target's, and
``FILL`` of the least of these leaves the cells some room. So that a rare value
doesn't make all others rare, targets that aren't given are then held to ``LIFT``
times a value's own share, and the rest shares what these leave; the kept share
is thus ``FILL`` / ``LIFT`` at least. The registered query
and the pipeline set both; ``shares`` reports targets and what became of them. Without
``reach``, a value whose documents can't fill its target is kept whole, and the
rest of its margin shares what it leaves by their targets.

Topics are given: by a column of the documents, or by marks that texts hold. The
default marks are few and tell forms of text apart rather than subjects.

Cells of up to ``MAX_CELLS`` are raked on the driver (rows of sums, not of
documents) and broadcast; more of them are raked by joins in the shared folder.

Defined cases: a null source or language counts as the empty string; a text
that is null or has no word has no tokens and takes its cell's probability,
the kept share if its cell has no tokens at all; texts of any length are counted
whole; values without a target get none of
the mix; a null ``doc_id`` draws the same number always; repeated rows share one
decision; no documents give no rows; input columns named like an output are
replaced, all others are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestql.llm.common import OWN, table, tidy, with_outputs, written

KEEP = 0.8
TEMPER = 0.7
ROUNDS = 12
MAX_CELLS = 100_000
#: Difference of a margin's sums from their targets, as shares, at which calibration ends; and its rounds at most.
TOLERANCE, MOST_ROUNDS = 1e-10, 60
#: Of the largest kept share at which each value alone could fill its target, the part that is used.
FILL = 0.95
#: Of targets that aren't given, the largest as a multiple of the value's own share, where targets are to be reached.
LIFT = 1.5
#: In calibration, the least part of its bound that a cell's sum may fall to, and the inverse of the most that it may exceed it by.
LEAST = 1e-9
MARGINS = ("source", "lang", "topic")
#: A text's topic is the first of these whose marks it holds, else ``OTHER``.
TOPICS: dict[str, tuple[str, ...]] = {
    "licence": ("Licensed under", "All rights reserved", "SPDX-License"),
    "secrets": ("password=", "token =", "AKIA"),
    "contact": ("@", "+1 ("),
    "table": (" | ",),
    "markup": ("###", "%%%", "&&&", "$$$"),
    "shouting": ("!! ",),
}
OTHER = "prose"

Targets = dict[str, dict[str, float]]


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] | None = None) -> Column:
    out = F.lit(OTHER)
    for name, marks in reversed(list((topics or TOPICS).items())):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks]), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")


def drawn(doc_id: Column) -> Column:
    """A number from 0 to 1 for each id."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(values: list[np.ndarray], sums: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell sums scaled to target shares. values: for each margin the number of each cell's value."""
    x = sums / max(sums.sum(), 1e-300)
    for _ in range(rounds):
        for v, t in zip(values, targets, strict=True):
            have = np.bincount(v, weights=x, minlength=len(t))
            x = x * np.divide(t, have, out=np.zeros(len(t)), where=have > 0)[v]
    return x


def reachable(bound: np.ndarray, target: np.ndarray) -> np.ndarray:
    """min(bound, c * target) for each value of a margin, with c such that they sum to 1 if they can."""
    out, open_ = np.zeros(len(target)), target > 0
    while open_.any():
        c = max(1 - out[~open_].sum(), 0.0) / target[open_].sum()
        over = open_ & (c * target > bound)
        if not over.any():
            out[open_] = c * target[open_]
            break
        out[over], open_ = bound[over], open_ & ~over
    return out


def rake_bounded(values: list[np.ndarray], sums: np.ndarray, targets: list[np.ndarray], keep: float, rounds: int = ROUNDS) -> np.ndarray:
    """As ``rake`` for shares of the kept tokens, none of a cell above what it has; cells at their bound may be returned above it."""
    x = sums / max(sums.sum(), 1e-300)
    bound = x / keep
    goals = [reachable(np.bincount(v, weights=bound, minlength=len(t)), t) for v, t in zip(values, targets, strict=True)]
    for _ in range(rounds):
        missed = 0.0
        for v, t in zip(values, goals, strict=True):
            full = x >= bound
            have = np.bincount(v, weights=np.minimum(x, bound), minlength=len(t))
            missed = max(missed, float(np.abs(have - t).max(initial=0.0)))
            held, free = (np.bincount(v, weights=np.where(w, y, 0.0), minlength=len(t)) for w, y in ((full, bound), (~full, x)))
            factor = np.divide(t, have, out=np.zeros(len(t)), where=have > 0)
            factor = np.divide(t - held, free, out=factor, where=(free > 0) & (t > held))
            x = np.where(t[v] > 0, np.clip(x * factor[v], bound * LEAST, bound / LEAST), 0.0)
        if missed < TOLERANCE:
            break
    return x


def most_kept(sums: np.ndarray, values: list[np.ndarray], targets: list[np.ndarray]) -> float:
    """The largest share of tokens at which each value of each margin could fill its target."""
    own = sums / max(sums.sum(), 1e-300)
    have = [np.bincount(v, weights=own, minlength=len(t)) for v, t in zip(values, targets, strict=True)]
    return min([1.0, *[float((h[(t > 0) & (h > 0)] / t[(t > 0) & (h > 0)]).min(initial=1.0)) for h, t in zip(have, targets, strict=True)]])


def probabilities(sums: np.ndarray, raked: np.ndarray, keep: float) -> np.ndarray:
    """min(1, c * weight) with c such that the expected sum is ``keep`` of all; ``keep`` where a cell has no tokens."""
    weight = np.divide(raked, sums, out=np.zeros(len(sums)), where=sums > 0)
    budget = keep * sums.sum()
    order = np.argsort(-weight, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(sums[order])])[:-1]
    open_ = np.cumsum((sums * weight)[order][::-1])[::-1]
    c = 0.0
    for k in range(len(order)):
        if open_[k] <= 0:
            break
        c = max((budget - full[k]) / open_[k], 0.0)
        if c * weight[order[k]] <= 1:
            break
    p = np.minimum(1.0, c * weight)
    return np.where(sums > 0, p, keep)


def _shares(have: dict[str, float], given: dict[str, float] | None, temper: float) -> dict[str, float]:
    raw = {v: float(given.get(v, 0.0)) for v in have} if given is not None else {v: x**temper if x > 0 else 0.0 for v, x in have.items()}
    total = sum(raw.values())
    return {v: x / total if total > 0 else 0.0 for v, x in raw.items()}


def _raked_here(rows: list, targets: Targets | None, keep: float, temper: float, rounds: int, calibrated: bool, reach: bool) -> list[tuple]:
    rows = sorted(rows, key=lambda r: (r.source, r.lang, r.topic))
    sums = np.array([float(r.tokens) for r in rows])
    values, shares = [], []
    for m in MARGINS:
        names = sorted({r[m] for r in rows})
        number = {v: i for i, v in enumerate(names)}
        at = np.array([number[r[m]] for r in rows], np.int64)
        have = np.bincount(at, weights=sums, minlength=len(names))
        share = _shares(dict(zip(names, have.tolist(), strict=True)), (targets or {}).get(m), temper)
        values.append(at)
        goal = np.array([share[v] for v in names])
        held = reach and (targets or {}).get(m) is None
        shares.append(reachable(LIFT * have / max(have.sum(), 1e-300), goal) if held else goal)
    if reach:
        keep = min(keep, FILL * most_kept(sums, values, shares))
    raked = rake_bounded(values, sums, shares, keep, rounds) if calibrated else rake(values, sums, shares, rounds)
    p = probabilities(sums, raked, keep)
    return [(r.source, r.lang, r.topic, float(x), *[float(t[v[i]]) for v, t in zip(values, shares, strict=True)]) for i, (r, x) in enumerate(zip(rows, p, strict=True))]


def _reachable_there(goals: DataFrame) -> DataFrame:
    """``goals`` (goal, have as share of the kept tokens) as ``reachable`` has them."""
    # the factor of its goal that a value's documents fill; values of smaller ones are kept whole
    goals = goals.withColumn("most", F.when(F.col("goal") > 0, F.col("have") / F.col("goal")).otherwise(float("inf")))
    limit, c = -1.0, 1.0
    while True:
        full = F.col("most") <= limit
        r = goals.agg(F.sum(F.when(full, F.col("have")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("goal"))).alias("open")).first()
        if not r.open or r.open <= 0:
            break
        c = max(1 - r.full, 0.0) / r.open
        more = goals.filter((F.col("most") > limit) & (F.col("most") < c)).agg(F.max("most")).first()[0]
        if more is None:
            break
        limit = more
    return goals.withColumn("goal", F.when(F.col("most") <= limit, F.col("have")).otherwise(F.col("goal") * c)).drop("most")


def _raked_there(cells: DataFrame, targets: Targets | None, keep: float, temper: float, rounds: int, calibrated: bool, reach: bool) -> DataFrame:
    """As ``_raked_here``, by joins; for cells without a bound."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals, wanted = {}, {}
    for m in MARGINS:
        have = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"))
        given = (targets or {}).get(m)
        if given is not None:
            want = have.join(spark.createDataFrame(list(given.items()), f"{m} string, raw double"), m, "left").select(m, "have", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            want = have.select(m, "have", F.when(F.col("have") > 0, F.pow("have", F.lit(temper))).otherwise(0.0).alias("raw"))
        want = written(want, "goal")
        wanted[m] = want.withColumn("goal", F.col("raw") / F.lit(want.agg(F.sum("raw")).first()[0] or 1.0))
        if reach and given is None:
            lifted = wanted[m].withColumns({"own": F.col("have"), "have": F.col("have") * F.lit(LIFT / max(total, 1))})
            wanted[m] = written(_reachable_there(lifted).withColumn("have", F.col("own")).drop("own"), "goal")
        if reach:
            least = wanted[m].filter((F.col("goal") > 0) & (F.col("have") > 0)).agg(F.min(F.col("have") / F.col("goal"))).first()[0]
            keep = min(keep, FILL * min(1.0, (least or float(max(total, 1))) / max(total, 1)))
    for m, want in wanted.items():
        if calibrated:
            want = _reachable_there(written(want.withColumn("have", F.col("have") / F.lit(keep * max(total, 1))), "goal"))
        goals[m] = written(want.select(m, "goal"), "goal")
    x = cells.withColumn("x", F.col("tokens") / F.lit(float(max(total, 1))))
    bound = F.col("tokens") / F.lit(float(max(total, 1))) / F.lit(keep)
    full = F.col("x") >= bound
    for _ in range(rounds):
        missed = 0.0 if calibrated else 1.0
        for m in MARGINS:
            if calibrated:
                off = x.groupBy(m).agg(F.sum(F.least("x", bound)).alias("have")).join(goals[m], m).agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0]
                missed = max(missed, off or 0.0)
                by = x.groupBy(m).agg(F.sum(F.when(full, bound).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("x"))).alias("free")).join(goals[m], m)
                have = F.col("held") + F.col("free")
                step = F.when((F.col("free") > 0) & (F.col("goal") > F.col("held")), (F.col("goal") - F.col("held")) / F.col("free")).when(have > 0, F.col("goal") / have).otherwise(0.0)
                factor = written(by.select(m, step.alias("factor"), "goal"), "factor")
                x = x.join(factor, m).withColumn("x", F.when(F.col("goal") > 0, F.least(F.greatest(F.col("x") * F.col("factor"), bound * LEAST), bound / LEAST)).otherwise(0.0)).drop("factor", "goal")
                continue
            factor = written(x.groupBy(m).agg(F.sum("x").alias("have")).join(goals[m], m).select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("factor")), "factor")
            x = x.join(factor, m).withColumn("x", F.col("x") * F.col("factor")).drop("factor")
        x = written(x, "raked")
        if missed < TOLERANCE:
            break
    weight = F.when(F.col("tokens") > 0, F.col("x") / F.col("tokens")).otherwise(0.0)
    x = written(x.withColumn("weight", weight), "weights")
    limit, c = float("inf"), 0.0
    while True:  # cells over the limit are full; each pass adds some until none is
        r = x.agg(F.sum(F.when(F.col("weight") >= limit, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(F.col("weight") < limit, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not r.open or r.open <= 0:
            break
        c = max((keep * total - r.full) / r.open, 0.0)
        over = x.filter((F.col("weight") < limit) & (F.col("weight") * c > 1)).agg(F.min("weight")).first()[0]
        if over is None:
            break
        limit = over
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * c)).otherwise(F.lit(keep))
    out = x.select(*MARGINS, p.alias("prob"))
    for m in MARGINS:
        out = out.join(wanted[m].select(m, F.col("goal").alias(f"target_{m}")), m, "left")
    return out.select(*MARGINS, "prob", *[f"target_{m}" for m in MARGINS])


def mix(
    docs: DataFrame,
    *,
    targets: Targets | None = None,
    keep: float = KEEP,
    temper: float = TEMPER,
    rounds: int = ROUNDS,
    topics: dict[str, tuple[str, ...]] | None = None,
    topic_column: str | None = None,
    max_cells: int = MAX_CELLS,
    calibrated: bool = False,
    reach: bool = False,
) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``prob``, ``kept`` and the target shares of the row's source, language and topic."""
    spark = docs.sparkSession
    docs = tidy(docs, "doc_id", "text", "source", "lang", *([topic_column] if topic_column else []))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {m: F.coalesce(F.col(m), F.lit("")) for m in ("source", "lang")}
    own["topic"] = F.coalesce(F.col(f"`{topic_column}`").cast("string"), F.lit(OTHER)) if topic_column else topic_of(text, topics)
    keyed = docs.select(*[c.alias(m) for m, c in own.items()], tokens_of(text).alias("n"))
    cells = written(keyed.groupBy(*MARGINS).agg(F.sum("n").alias("tokens")), "cells")
    key = [F.col(OWN + m) for m in MARGINS]
    goals = [f"target_{m}" for m in MARGINS]
    few = cells.limit(max_cells + 1).collect()
    if len(few) <= max_cells:
        schema = "source string, lang string, topic string, prob double, " + ", ".join(f"{g} double" for g in goals)
        made = spark.createDataFrame(_raked_here(few, targets, keep, temper, rounds, calibrated, reach), schema)
        made = F.broadcast(made)  # bounded by max_cells
    else:
        made = _raked_there(cells, targets, keep, temper, rounds, calibrated, reach)
    made = made.select(*[F.col(m).alias(OWN + m) for m in MARGINS], F.col("prob").alias(OWN + "prob"), *[F.col(g).alias(OWN + g) for g in goals])
    wide = docs.select("*", own["topic"].alias(OWN + "t"), tokens_of(text).alias(OWN + "n"))
    match = (key[0] == own["source"]) & (key[1] == own["lang"]) & (key[2] == F.col(OWN + "t"))
    out = wide.join(made, match, "left")
    return out.select(
        *with_outputs(docs, ("topic", "n_tokens", "prob", "kept", *goals)),
        F.col(OWN + "t").alias("topic"),
        F.col(OWN + "n").alias("n_tokens"),
        F.col(OWN + "prob").alias("prob"),
        (drawn(F.col("doc_id")) < F.col(OWN + "prob")).alias("kept"),
        *[F.col(OWN + g).alias(g) for g in goals],
    )


def shares(mixed: DataFrame) -> DataFrame:
    """Of the output of ``mix``, a row for each value of each margin: its shares of all tokens, of the target, of the expected and of the kept tokens."""
    n, parts = F.col("n_tokens"), None
    for m in MARGINS:
        sums = [F.sum(n).alias("own"), F.first(f"target_{m}").alias("target"), F.sum(n * F.col("prob")).alias("expected"), F.sum(F.when(F.col("kept"), n).otherwise(0)).alias("achieved")]
        part = mixed.groupBy(F.lit(m).alias("margin"), F.coalesce(F.col(m), F.lit("")).alias("value")).agg(*sums)
        parts = part if parts is None else parts.unionByName(part)
    of = Window.partitionBy("margin")
    return parts.select("margin", "value", "target", *[(F.col(c) / F.sum(c).over(of)).alias(c) for c in ("own", "expected", "achieved")])


def to_targets(docs: DataFrame, **more) -> DataFrame:
    """As ``mix``, with the largest kept share up to ``KEEP`` at which the targets are met."""
    return mix(docs, calibrated=True, reach=True, rounds=MOST_ROUNDS, **more)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to_targets(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("prob", *[f"target_{m}" for m in MARGINS])]
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", *rounded, "kept")


def _sql() -> str:
    topic = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS.items()) + f" ELSE '{OTHER}' END"
    steps, last = [], "c0"
    cells = "source, lang, topic, w, b, " + ", ".join(f"t_{m}" for m in MARGINS)
    for i in range(MOST_ROUNDS):
        for m in MARGINS:
            of = f"OVER (PARTITION BY {m})"
            have, held, free = f"sum(least(x, b)) {of}", f"sum(CASE WHEN x >= b THEN b ELSE 0 END) {of}", f"sum(CASE WHEN x < b THEN x ELSE 0 END) {of}"
            step = f"CASE WHEN f > 0 AND t_{m} > d THEN (t_{m} - d) / f WHEN h > 0 THEN t_{m} / h ELSE 0 END"
            name = f"c{i}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT {cells}, CASE WHEN t_{m} > 0 THEN least(greatest(x * {step}, b * {LEAST}), b / {LEAST}) ELSE 0 END AS x FROM (SELECT *, {have} AS h, {held} AS d, {free} AS f FROM {last}))")
            last = name
    goals = ", ".join(
        f"""r_{m} AS (SELECT {m}, r / sum(r) OVER () AS r, w / sum(w) OVER () AS o, {LIFT} * w / sum(w) OVER () AS most
            FROM (SELECT {m}, sum(w) AS w, CASE WHEN sum(w) > 0 THEN pow(sum(w), {TEMPER}) ELSE 0 END AS r FROM cells GROUP BY {m})),
g_{m} AS MATERIALIZED (SELECT {m}, o AS o_{m}, CASE WHEN r > 0 THEN least(most, r * max(CASE WHEN r > 0 THEN (1 - filled) / rest END) OVER ()) ELSE 0 END AS t_{m} FROM (
    SELECT *, coalesce(sum(most) OVER (ORDER BY most / nullif(r, 0), {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
           sum(r) OVER (ORDER BY most / nullif(r, 0), {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r_{m}))"""
        for m in MARGINS
    )
    least = " UNION ALL ".join(f"SELECT min(o_{m} / t_{m}) AS r FROM g_{m} WHERE t_{m} > 0" for m in MARGINS)
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
k AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, {topic} AS topic,
             len(regexp_extract_all(text, '[^ \t-\r]+'))::BIGINT AS n_tokens FROM d),
cells AS MATERIALIZED (SELECT s AS source, l AS lang, topic, sum(n_tokens)::DOUBLE AS w FROM k GROUP BY ALL),
{goals},
share AS MATERIALIZED (SELECT least({KEEP}, {FILL} * least(1.0, min(r))) AS keep FROM ({least})),
c0 AS MATERIALIZED (SELECT cells.*, w / sum(w) OVER () / keep AS b, {", ".join("t_" + m for m in MARGINS)}, w / sum(w) OVER () AS x
       FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic), share),
{", ".join(steps)},
f AS MATERIALIZED (SELECT source, lang, topic, w, {", ".join("t_" + m for m in MARGINS)}, CASE WHEN w > 0 THEN x / w ELSE 0 END AS f FROM {last}),
ranked AS (SELECT *, coalesce(sum(w) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                  sum(w * f) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
                  sum(w) OVER () AS total FROM f),
factor AS (SELECT max_by(c, f) AS c FROM (SELECT f, greatest((keep * total - filled) / rest, 0) AS c FROM ranked, share WHERE rest > 0) WHERE c * f <= 1),
p AS (SELECT f.*, CASE WHEN w > 0 THEN least(1.0, c * f.f) ELSE keep END AS prob FROM f, factor, share)
SELECT doc_id, k.source, k.lang, k.topic, n_tokens, round(prob, 6) AS prob, {", ".join(f"round(t_{m}, 6) AS target_{m}" for m in MARGINS)},
       (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 8))::BIGINT / 4294967296.0) < prob AS kept
FROM k JOIN p ON k.s = p.source AND k.l = p.lang AND k.topic = p.topic
"""


SQL = {"op7_mixing": _sql()}
