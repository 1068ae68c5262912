"""Language identification by interpolated Kneser-Ney character models.

A text is its words: runs of letters, lower-cased, each scored by itself as
``^word$``. For each language an n-gram model of order ``ORDER`` is fitted:
counts at the highest order, numbers of distinct preceding characters below it,
one absolute discount an order. N-grams of all languages are kept as sorted
arrays of 64-bit hashes with a column a language that holds the interpolated
log-probability; contexts likewise, with the log of the mass they pass down. A
character is scored by its longest stored n-gram. The language with the lowest
cross-entropy per character wins.

Calibration, on documents of the sample that no count has seen: a logistic
curve from the margin to the second language gives ``score``; the highest
cross-entropy that is usual for a language gives its limit of rejection.

The classifier is fitted on a bounded sample: of each language about
``SAMPLE_DOCS`` different documents, whole texts, chosen by a hash of their id, and
of these as many as hold ``LANGUAGE_CHARS`` characters together, those of at most
``SAMPLE_CHARS`` first. Only a language all of whose texts are longer than
``LANGUAGE_CHARS`` isn't learned. More than ``MAX_LANGUAGES`` languages are an
error. Predictions use whole texts of any length.

Defined cases: ``und`` with score 0 for a text that is null or has no letter,
and for every text if there is nothing to learn from; a null ``doc_id`` is not
held out and not learned from; languages tie to the smaller name; repeated rows
give a row each; no documents give no rows; input columns named like an output
are replaced, all others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from nestql.llm.common import OWN, map_texts, table, tidy, with_outputs

ORDER = 5
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
#: Characters of the sample in one language, at most.
LANGUAGE_CHARS = 4_000_000
#: Languages beyond which training is refused: models have a column for each.
MAX_LANGUAGES = 500
#: Of the sample, one document in so many calibrates.
CALIBRATE = 5
#: A text is rejected beyond this factor of the highest cross-entropy in calibration.
SLACK = 1.5
#: Words in either half of a worker's memory of scored words: the older half goes when the newer is full.
MEMORY = 100_000
UNKNOWN = "und"

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _word.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    # superscripts, fractions and the like are neither digits to the pattern nor letters
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split(" ")) if p]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place of a flat symbol array, from place n - 1 on."""
    h = np.full(max(len(symbols) - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = (h ^ symbols[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` for each word, joined, and each one's length."""
    joined = "".join([f"\x02{w}\x03" for w in words])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, words), np.int64, len(words)) + 2


def place_in_word(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Model:
    languages: list[str]
    #: For each order 1..n: sorted hashes, and rows of log-probabilities (a column a language).
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: For each order 2..n: sorted hashes of contexts, and rows of log masks passed down.
    contexts: list[tuple[np.ndarray, np.ndarray]]
    #: Log-probability of an unseen character.
    floor: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    limits: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The negative log-probability of each word in each language."""
        symbols, sizes = flat(words)
        place = place_in_word(sizes)
        logp = np.broadcast_to(self.floor, (len(symbols), len(self.languages))).copy()
        for n, (keys, values) in enumerate(self.grams, 1):
            ends = np.arange(n - 1, len(symbols))
            ok = place[ends] >= n - 1
            if n > 1:
                ends = ends[ok & (place[ends] > 0)]
                ctx_keys, passed = self.contexts[n - 2]
                at, found = search(ctx_keys, hashes(symbols, n - 1)[ends - n + 1])
                logp[ends[found]] += passed[at[found]]
            else:
                ends = ends[ok]
            at, found = search(keys, hashes(symbols, n)[ends - n + 1])
            logp[ends[found]] = values[at[found]]
        logp[place == 0] = 0  # the start is given
        starts = np.cumsum(sizes) - sizes
        return -np.add.reduceat(logp, starts, axis=0)


def search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def fit_counts(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """Models of word counts by language."""
    languages = sorted(counts)
    per: list[list[dict]] = []
    for lang in languages:
        words = list(counts[lang])
        times = np.fromiter((counts[lang][w] for w in words), np.float64, len(words))
        symbols, sizes = flat(words)
        place, weight = place_in_word(sizes), np.repeat(times, sizes)
        levels: list[dict] = []
        for n in range(1, order + 1):
            ends = np.arange(n - 1, len(symbols))
            ends = ends[(place[ends] >= n - 1) & (place[ends] > 0)]
            key, first, inverse = np.unique(hashes(symbols, n)[ends - n + 1], return_index=True, return_inverse=True)
            last = ends[first]
            levels.append({"key": key, "last": last, "raw": np.bincount(inverse, weights=weight[ends], minlength=len(key)), "start": place[last] == n - 1, "symbols": symbols})
        per.append(levels)
    model = Model(languages, [], [], np.zeros(len(languages)))
    lower: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([lv[n - 1]["key"] for lv in per]))
        values = np.zeros((len(keys), len(languages)))
        # one place in some language's symbols for each key: its shorter n-grams
        suffix, ctx_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for lv in per:
            x = lv[n - 1]
            at = np.searchsorted(keys, x["key"])
            if n > 1:
                suffix[at] = hashes(x["symbols"], n - 1)[x["last"] - n + 2]
                ctx_of[at] = hashes(x["symbols"], n - 1)[x["last"] - n + 1]
        ctx_keys = np.unique(ctx_of) if n > 1 else np.zeros(1, np.uint64)
        passed = np.zeros((len(ctx_keys), len(languages)))
        for k, lv in enumerate(per):
            x = lv[n - 1]
            c = x["raw"].copy()
            if n < order:  # distinct characters before; a gram from a word's start has none and keeps its count
                nxt = lv[n]
                before = np.bincount(np.searchsorted(x["key"], hashes(nxt["symbols"], n)[nxt["last"] - n + 1]), minlength=len(c))[: len(c)]
                c = np.where(before > 0, before, np.where(x["start"], c, 0)).astype(float)
                if n > 1:
                    c = np.where(x["start"], x["raw"], c)
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(keys, x["key"])
            ctx = np.searchsorted(ctx_keys, ctx_of[at]) if n > 1 else np.zeros(len(at), np.int64)
            total = np.bincount(ctx, weights=c, minlength=len(ctx_keys))
            kinds = np.bincount(ctx, weights=c > 0, minlength=len(ctx_keys))
            rest = np.divide(d * kinds, total, out=np.ones_like(total), where=total > 0)
            passed[:, k] = np.log(np.maximum(rest, 1e-9))
            own = np.zeros(len(keys))
            own[at] = np.maximum(c - d, 0) / np.maximum(total[ctx], 1e-12)
            if n == 1:
                low = np.full(len(keys), 1.0 / (len(keys) + 1))
                model.floor[k] = passed[0, k] - math.log(len(keys) + 1)
            else:
                low_at, ok = search(lower[-1][0], suffix)
                low = np.where(ok, np.exp(lower[-1][1][low_at, k]), math.exp(model.floor[k]))
            of = np.searchsorted(ctx_keys, ctx_of) if n > 1 else np.zeros(len(keys), np.int64)
            values[:, k] = np.log(np.maximum(own + rest[of] * low, 1e-12))
        lower.append((keys, values))
        model.grams.append((keys, values.astype(np.float32)))
        if n > 1:
            model.contexts.append((ctx_keys, passed.astype(np.float32)))
    return model


class Scorer:
    """Cross-entropies of texts, with a memory of the words that a worker has met lately."""

    def __init__(self, model: Model):
        self.model = model
        #: Newer and older words: their rows, each half with the scores of its own.
        self.at: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.rows = self.old_rows = np.zeros((0, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = list(words - self.at.keys())
        if self.at and len(self.at) + len(new) > MEMORY:
            self.old, self.old_rows = self.at, self.rows
            self.at, self.rows, new = {}, self.rows[:0], list(words)
        again = [w for w in new if w in self.old]
        unmet = [w for w in new if w not in self.old]
        parts = [self.rows, self.old_rows[[self.old[w] for w in again]]]
        parts += [self.model.word_scores(unmet[i : i + 20_000]) for i in range(0, len(unmet), 20_000)]
        self.at |= {w: i for i, w in enumerate(again + unmet, len(self.rows))}
        self.rows = np.concatenate(parts)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text: nats per character in each language; and the characters, 0 where there is no letter."""
        out, chars = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        split = [words_of(t) for t in texts]
        self.learn(set().union(*split))
        for i, words in enumerate(split):
            if words:
                own = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                chars[i] = sum(map(len, words)) + len(words)
                out[i] = self.rows[own].sum(axis=0) / chars[i]
        return out, chars


def margins(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each row, and how far the second is behind, relative to the best."""
    best = h.argmin(axis=1)
    low = h[np.arange(len(h)), best]
    other = h.copy()
    other[np.arange(len(h)), best] = np.inf
    second = other.min(axis=1) if h.shape[1] > 1 else low * 2
    return best, (second - low) / np.maximum(low, 1e-9)


def calibrate(model: Model, rows: list[tuple[str, str]]) -> None:
    """Fit the curve of ``score`` and the limits of rejection to texts that no count has seen."""
    model.limits = np.full(len(model.languages), np.inf)
    rows = [(text, lang) for text, lang in rows if lang in model.languages and words_of(text)]
    if not rows:
        return
    h, chars = Scorer(model).entropies([t for t, _ in rows])
    best, gap = margins(h)
    x = gap * np.sqrt(chars)
    y = np.array([model.languages[b] == lang for b, (_, lang) in zip(best, rows, strict=True)], float)
    y = np.concatenate([y, [1.0, 0.0]])  # one of either kind, so that the curve stays finite
    x = np.concatenate([x, [float(np.median(x)), 0.0]])
    scale = max(float(np.std(x)), 1e-6)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30)))
        w = p * (1 - p) + 1e-4
        g = np.array([((p - y) * x / scale).sum() + 1e-3 * a, (p - y).sum()])
        m = np.array([[(w * (x / scale) ** 2).sum() + 1e-3, (w * x / scale).sum()], [(w * x / scale).sum(), w.sum()]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.curve = (max(a, 0.0) / scale, b)
    for k, lang in enumerate(model.languages):
        own = [h[i, k] for i, (_, l) in enumerate(rows) if l == lang and best[i] == k]
        if own:
            model.limits[k] = SLACK * max(own)


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, language_chars: int = LANGUAGE_CHARS) -> list[Row]:
    """The labelled rows (doc_id, text, lang) that ``train`` learns from."""
    docs = tidy(docs, "doc_id", "text", "lang").select("doc_id", "text", "lang")
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.filter(F.length("text") <= language_chars)
    sizes = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages")
    if not sizes:
        return []
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_docs / r["count"])) for r in sizes], f"lang string, {OWN}share double")
    draw, long = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)), F.length("text") > sample_chars
    drawn = known.join(F.broadcast(shares), "lang").filter(draw / F.lit(float(1 << 30)) < F.col(OWN + "share"))
    # rows that repeat have one draw; what is left is bounded before it meets in a window
    drawn = drawn.select("doc_id", "text", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(long, draw, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    kept = drawn.withColumn(OWN + "chars", F.sum(F.length("text")).over(order)).filter(F.col(OWN + "chars") <= language_chars)
    return sorted(kept.select("doc_id", "text", "lang").collect(), key=lambda r: (r.doc_id, r.text, r.lang))


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, language_chars: int = LANGUAGE_CHARS, order: int = ORDER) -> Model | None:
    """Fit a model on a bounded hash sample of the documents that aren't held out."""
    counts: dict[str, Counter] = {}
    later: list[tuple[str, str]] = []
    for r in sample(docs, sample_docs, sample_chars, language_chars):
        if hash_of(r.doc_id) % CALIBRATE == 0:
            later.append((r.text, r.lang))
        else:
            counts.setdefault(r.lang, Counter()).update(words_of(r.text))
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return None
    model = fit_counts(counts, order)
    calibrate(model, later)
    return model


def hash_of(i: int) -> int:
    return ((i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 40


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``, from the text alone."""
    added = "lang_pred string, score double, cross_entropy double, rejected boolean"
    docs = tidy(docs, "text")
    if model is None:
        return docs.select(*with_outputs(docs, ("lang_pred", "score", "cross_entropy", "rejected")), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def start():
        scorer = Scorer(shared.value)
        m = scorer.model
        (a, b), limits = m.curve, m.limits

        def run(texts):
            h, chars = scorer.entropies(texts)
            best, gap = margins(h)
            score = 1 / (1 + np.exp(-np.clip(a * gap * np.sqrt(chars) + b, -30, 30)))
            low = h[np.arange(len(h)), best] if len(h) else np.zeros(0)
            some = chars > 0
            return [
                [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)],
                np.where(some, score, 0.0),
                [float(x) if ok else None for x, ok in zip(low, some, strict=True)],
                ~some | (low > limits[best]) if len(h) else np.zeros(0, bool),
            ]

        return run

    return map_texts(docs, start, added)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tidy(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
