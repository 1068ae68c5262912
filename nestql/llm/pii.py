"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans are found by the patterns of ``base_spans``: e-mail and IP addresses,
card numbers that pass Luhn's check, phone numbers. A random field then labels
the tokens of a text, one of ``LABELS`` or outside. It adds what patterns lose,
as two numbers that run into each other, and a kind that has no pattern:
secrets, such as passwords and access keys.

The field. All tokens, in order, are a chain. Tokens that hold nothing of what
personal data is made of (``CANDIDATE``, or the value after a word like
``password =``) are observed as outside; so the chain is exact with a node for
each other token, a link between such neighbours, and the chain potential with
"outside" for each observed neighbour. Tokens of a text that are equal, or of one
signature (letters and digits abstracted, equal at both ends), share a skip
potential, however distant, through a node of their own for each group, so a
group of n has n edges and not n * n. Loopy belief propagation passes messages
until they settle or ``ROUNDS`` are over. Tokens that base spans cover are observed
with their kind; another one that gets a kind with ``CONFIDENT`` probability
becomes a span, for phones together with its neighbours of that kind.

Fitting. Unary, chain and skip weights are fitted together by pseudo-likelihood:
each token's label given its neighbours' and, for each of its groups, the label
of most others. Labels are the base spans, and secrets by ``seeds``, the values
after such words; tokens equal to one of these in the text are secrets too. For
a third of the tokens the features of context are left out, as for tokens that
repeat elsewhere, so the skip weights have to tell. Numbers in runs that a pattern
matched and its checks refused don't count. The sample is bounded: about
``SAMPLE_DOCS`` different texts, by hash, of those with anything like personal
data, of ``SAMPLE_CHARS`` characters at most and ``TOTAL_CHARS`` together.

Base spans always stay. Where the field can't be fitted, as the sample has no
labels, only these remain.

Defined cases: a null or empty text has no spans; places are code points, ends
exclusive; texts of any length are searched whole; repeated rows give a row
each; no documents give no rows; input columns named like an output are
replaced, all others are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestql.llm.common import OWN, map_texts, table, tidy

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart, besides outside.
LABELS = (*KINDS, "secret")
SAMPLE_DOCS = 2000
#: Characters of a sampled text, and of all, at most.
SAMPLE_CHARS, TOTAL_CHARS = 50_000, 16_000_000
ROUNDS = 20
SETTLED = 1e-4
CONFIDENT = 0.9
#: How much likelier than others equal labels are on skip links, before any text is seen, and the weight of that.
AGREE, PRIOR = 9, 5.0
#: Of so many tokens one is fitted without features of its context.
DROP = 3

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[^0-9]+")
_several = re.compile(r"[0-9][).-]* [(]?[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, from each @ outwards: its local part can't hold an @, so it ends at one."""
    out, cur, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cur and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            cur = m.end()
        else:
            cur = max(cur, at)
        at = text.find("@", max(at + 1, cur))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def refused_runs(text: str) -> list[tuple[int, int]]:
    """Runs of several numbers that the patterns of cards and phones match and their checks refuse."""
    out = []
    for pattern, least, most in ((_card, 13, 19), (_phone, 9, 15)) if _several.search(text) else ():
        for m in pattern.finditer(text):
            if " " in m[0] and m.end() - m.start() >= least:
                digits = _digit.sub("", m[0])
                if not least <= len(digits) <= most or (pattern is _card and not luhn(digits)):
                    out.append(m.span())
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        a, b = m.span()
        if 13 <= b - a:
            digits = _digit.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", a, b))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_digit.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


#: What ends a token, besides blanks.
_ends = "\"'=<>|;,"
#: Tokens that may be personal data: an @ or a written-out one, three digits, or a digit after a plus.
CANDIDATE = re.compile(rf"(?<![^\s{_ends}])(?=[^\s{_ends}@]*@|(?:[^\s{_ends}0-9]*[0-9]){{3}}|\+[0-9]|[^\s{_ends}]*[\[({{]at[\])}}])[^\s{_ends}]++")
#: A word for secrets that is given a value: the token after it is a candidate too.
_given = re.compile(rf"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|credential|(?:api|access|private|auth)[_ -]?key)s?\b[\"']?\s{{0,3}}(?:=>?|:=?)\s{{0,3}}[\"']?([^\s{_ends}]++)")
#: Texts without a match have no candidates.
_some = re.compile(r"[0-9@]|[\[({]at[\])}]|(?i:pass|pwd|secret|token|credential|key)s?\b[\"']?\s{0,3}[=:]")
_sign = re.compile(r"[0-9]+|[^\W\d_]+", re.UNICODE)
_front, _back = ".,:!?[]{})-*#$%&/\\", ".,:!?()[]{}-*#$%&/\\"
_hex = re.compile(r"[0-9a-fA-F]+")

Place = tuple[int, int]


def tokens(text: str) -> tuple[list[Place], set[Place]]:
    """Places of the candidates, without the signs around them, and those that are given as secrets."""
    if not _some.search(text):
        return [], set()
    given = {m.span(1) for m in _given.finditer(text)}
    found = sorted({m.span() for m in CANDIDATE.finditer(text)} | given)
    out, told = [], set()
    for place in found:
        a, b = place
        word = text[a:b]
        a += len(word) - len(word.lstrip(_front))
        b -= len(word) - len(word.rstrip(_back))
        if a < b and (not out or a >= out[-1][1]):
            out.append((a, b))
            if place in given:
                told.add((a, b))
    return out, told


def seeds(text: str, found: list[Place], given: set[Place]) -> list[bool]:
    """Which candidates are secrets as far as context tells: values given to words for secrets, and tokens equal to these."""
    sure = {text[a:b] for a, b in given if b - a >= 8}
    return [text[a:b] in sure for a, b in found]


def signature(word: str) -> str:
    """A token with its inner letters and digits abstracted; similar ones agree on it."""
    shape = _sign.sub(lambda m: ("9" if m[0][0].isdigit() else "a") + str(min(len(m[0]), 9)), word)
    return f"{word[:2].lower()}|{shape}|{word[-2:].lower()}"


#: The last ones are of the context.
FEATURES, CONTEXT = 30, 4


def features(text: str, start: int, end: int, given: bool = False) -> list[float]:
    word = text[start:end]
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    n, dots, dashes = max(len(word), 1), word.count("."), word.count("-")
    at = word.find("@")
    before = text[max(0, start - 1) : start]
    return [
        1.0,
        float(at > 0),
        float(at > 0 and "." in word[at:]),
        float(at < 0),
        float("[at]" in word or "(at)" in word),
        digits / n,
        letters / n,
        float(word.startswith("+")),
        float(dots == 3 and digits + dots == len(word)),
        float(dots == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in word.split("."))),
        float(dots not in (0, 3)),
        float(digits == len(word)),
        float(digits == len(word) and 13 <= digits <= 19),
        float(digits > 19),
        float(digits < 9),
        float(9 <= digits <= 12),
        float(13 <= digits <= 19 and digits + dashes == len(word) and luhn(_digit.sub("", word))),
        float(":" in word or "/" in word),
        float(dashes > 0),
        float(digits == 3 and len(word) <= 5),
        float(digits == 7 and dashes == 1),
        float(letters > 0 and digits > 0 and at < 0),
        float(n >= 16),
        float(n >= 28),
        float(n >= 16 and letters > 0 and digits > 0 and _hex.fullmatch(word) is not None),
        float(n >= 16 and letters > 0 and digits > 2 and len(set(word)) > n / 4),
        float(given),
        float(given and n >= 8),
        float(before in ("\"", "'")),
        float(before == "("),
    ]


@dataclass
class Field:
    """Potentials as logarithms; label 0 is outside, the others are ``LABELS``."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def observed(found: list[Place], spans: list[Span]) -> list[int]:
    """For each candidate the label of the base span it overlaps, else 0."""
    ordered = sorted((a, b, LABELS.index(k) + 1) for k, a, b in spans)
    out, at = [], 0
    longest = 0
    ends = []
    for a, b, _ in ordered:
        longest = max(longest, b)
        ends.append(longest)
    for start, end in found:
        while at < len(ordered) and ends[at] <= start:
            at += 1
        out.append(next((k for a, b, k in ordered[at : at + 8] if a < end and b > start), 0))
    return out


def links(text: str, found: list[Place]) -> tuple[list[tuple[int, int]], list[list[int]], np.ndarray]:
    """Chain pairs of neighbouring candidates, groups of equal or similar ones, and how many neighbours of each are observed as outside, before and after it."""
    chain, sides = [], np.zeros((len(found), 2))
    for i, (a, b) in enumerate(found):
        left, right = found[i - 1][1] if i else 0, found[i + 1][0] if i + 1 < len(found) else len(text)
        if text[left:a].strip("()[]{}\"'.,:;!?-*#$%&=|<> \t\r\n") or (i and not re.search(rf"[\s{_ends}]", text[left:a])):
            sides[i, 0] = 1
        elif i:
            chain.append((i - 1, i))
        if text[b:right].strip("()[]{}\"'.,:;!?-*#$%&=|<> \t\r\n"):
            sides[i, 1] = 1
    groups: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(found):
        word = text[a:b]
        groups.setdefault("=" + word.lower(), []).append(i)
        groups.setdefault("~" + signature(word), []).append(i)
    return chain, [g for g in groups.values() if len(g) > 1], sides


def propagate(unary: np.ndarray, chain: list[tuple[int, int]], groups: list[list[int]], field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Marginal probabilities of each candidate's label by loopy belief propagation."""
    n, k = unary.shape
    edges = [(a, b, 0) for a, b in chain] + [(n + g, i, 1) for g, own in enumerate(groups) for i in own]
    local = np.concatenate([unary, np.zeros((len(groups), k))])
    if not edges:
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return (p / p.sum(axis=1, keepdims=True))[:n]
    e = np.array(edges)
    pair = np.stack([field.chain, field.skip])
    source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    factor = np.concatenate([pair[e[:, 2]], pair[e[:, 2]].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        total = local.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.logaddexp.reduce(out[:, :, None] + factor, axis=1)
        out -= out.max(axis=1, keepdims=True)
        change = float(np.abs(out - message).max())
        message = 0.5 * message + 0.5 * out
        if change < SETTLED:
            break
    total = local
    np.add.at(total, target, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return (p / p.sum(axis=1, keepdims=True))[:n]


def fit(texts: list[str]) -> Field | None:
    """All weights together, from texts whose labels are their base spans and seeds of secrets."""
    rows: list[list[float]] = []
    labels: list[int] = []
    counted: list[bool] = []
    prev: list[int] = []  # a neighbour's label; -1 where the text begins or ends
    after: list[int] = []
    skips: list[tuple[int, int]] = []  # (token, the label of most others in a group)
    for text in texts:
        found, given = tokens(text)
        if not found:
            continue
        base = base_spans(text)
        own = [k or (len(LABELS) if secret else 0) for k, secret in zip(observed(found, base), seeds(text, found, given), strict=True)]
        runs = refused_runs(text)
        chain, groups, sides = links(text, found)
        first = len(labels)
        left, right = [0 if x else -1 for x in sides[:, 0]], [0 if x else -1 for x in sides[:, 1]]
        for i, j in chain:
            right[i], left[j] = own[j], own[i]
        for g in groups:
            counts = np.bincount([own[i] for i in g], minlength=len(LABELS) + 1)
            for i in g:
                rest = counts.copy()
                rest[own[i]] -= 1
                skips.append((first + i, int(rest.argmax()) if rest.argmax() else int(rest[1:].argmax()) + 1 if rest[1:].any() and rest[1:].max() == rest[0] else 0))
        for i, (a, b) in enumerate(found):
            x = features(text, a, b, (a, b) in given)
            if len(rows) % DROP == 0 and own[i] == len(LABELS):
                x[-CONTEXT:] = [0.0] * CONTEXT
            rows.append(x)
            counted.append(own[i] > 0 or not any(s < b and e > a for s, e in runs))
        labels += own
        prev += left
        after += right
    if not any(labels):
        return None
    x, y, n, k = np.array(rows), np.array(labels), len(labels), len(LABELS) + 1
    hot, weight = np.eye(k)[y], np.array(counted, float)[:, None] / max(sum(counted), 1)
    left, right = np.array(prev), np.array(after)
    has_left, has_right = np.flatnonzero(left >= 0), np.flatnonzero(right >= 0)
    member, of = (np.array(v, np.int64) for v in zip(*skips, strict=True)) if skips else (np.zeros(0, np.int64),) * 2
    start = np.log((1 + AGREE * np.eye(k)) / (k + AGREE))
    unary, chain_w, skip_w = np.zeros((x.shape[1], k)), np.zeros((k, k)), start - start.mean()
    centre = skip_w.copy()
    speed = [np.zeros_like(v) for v in (unary, chain_w, skip_w)]
    for _ in range(600):
        z = x @ unary
        z[has_left] += chain_w[left[has_left]]
        z[has_right] += chain_w.T[right[has_right]]
        np.add.at(z, member, skip_w[of])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - hot) * weight
        d_chain, d_skip = np.zeros((k, k)), np.zeros((k, k))
        np.add.at(d_chain, left[has_left], off[has_left])
        back = np.zeros((k, k))
        np.add.at(back, right[has_right], off[has_right])
        np.add.at(d_skip, of, off[member])
        steps = (x.T @ off + 1e-4 * unary, d_chain + back.T + 1e-3 * chain_w, (d_skip + d_skip.T) / 2 + PRIOR / n * (skip_w - centre))
        for i, g in enumerate(steps):
            speed[i] = 0.9 * speed[i] - 0.5 * g
        unary, chain_w, skip_w = unary + speed[0], chain_w + speed[1], skip_w + speed[2]
    return Field(unary, chain_w, skip_w)


def added_spans(text: str, spans: list[Span], field: Field | None) -> list[Span]:
    """Spans that the field adds to the base ones."""
    if field is None:
        return []
    found, given = tokens(text)
    if not found:
        return []
    own = observed(found, spans)
    if all(own):
        return []
    chain, groups, sides = links(text, found)
    unary = np.array([features(text, a, b, (a, b) in given) for a, b in found]) @ field.unary
    unary += sides[:, :1] * field.chain[0] + sides[:, 1:] * field.chain[:, 0]
    seen = np.array(own)
    unary[seen > 0] -= 30.0
    unary[seen > 0, seen[seen > 0]] = 0.0
    p = propagate(unary, chain, groups, field)
    got = [0 if was or row.max() < CONFIDENT else int(row.argmax()) for was, row in zip(own, p, strict=True)]
    neighbours = set(chain)
    phone, out, last = LABELS.index("phone") + 1, [], -1
    for i, ((a, b), label) in enumerate(zip(found, got, strict=True)):
        if not label:
            continue
        if label == phone and out and last == i - 1 and got[last] == phone and (last, i) in neighbours:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((LABELS[label - 1], a, b))
        last = i
    return out


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> list[str]:
    """The texts that ``train`` learns from."""
    docs = tidy(docs, "doc_id", "text").select("doc_id", "text")
    likely = F.col("text").rlike(r"@|[0-9]{4}|[0-9]\.[0-9]|(?i:password|secret|token|key)\b.{0,3}[=:]") & (F.length("text") <= sample_chars)
    n = docs.filter(likely).count()
    draw = F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(1 << 30))
    drawn = docs.filter(likely & (draw < int(min(1.0, sample_docs / max(n, 1)) * (1 << 30))))
    # rows that repeat have one draw; what is left is bounded before it meets in windows
    drawn = drawn.groupBy("text").agg(F.min(draw).alias(OWN + "draw"))
    parts = 8
    order = Window.partitionBy(F.col(OWN + "draw") % parts).orderBy(OWN + "draw", "text").rowsBetween(Window.unboundedPreceding, 0)
    kept = drawn.withColumn(OWN + "sum", F.sum(F.length("text")).over(order)).filter(F.col(OWN + "sum") <= total_chars // parts)
    return [r.text for r in sorted(kept.collect(), key=lambda r: (r[OWN + "draw"], r.text))]


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> Field | None:
    """Fit the field on a bounded hash sample of texts with something like personal data."""
    return fit(sample(docs, sample_docs, sample_chars, total_chars))


COUNTS = (*(f"n_{k}" for k in KINDS), "n_secret", "n_added", "n_spans")


def find_spans(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with counts of the base spans, of secrets, of added and of all spans, ``base_spans`` and ``spans`` (kind:start:end, comma-joined)."""

    def start():
        def run(texts):
            rows = []
            for t in texts:
                base = base_spans(t or "")
                more = added_spans(t, base, field) if t else []
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                counts += [sum(s[0] == "secret" for s in more), len(more), len(base) + len(more)]
                rows.append((*counts, joined(base), joined(base + more)))
            return list(zip(*rows, strict=True)) if rows else [[]] * (len(COUNTS) + 2)

        return run

    return map_texts(tidy(docs, "text"), start, ", ".join(f"{c} long" for c in COUNTS) + ", base_spans string, spans string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tidy(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text")
    out = find_spans(docs, train(docs))
    return out.select("doc_id", *COUNTS[: len(KINDS)], F.sha2("base_spans", 256).alias("base_sha256"), "spans", *COUNTS[len(KINDS) :])
