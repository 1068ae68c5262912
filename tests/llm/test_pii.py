import hashlib
import random
import re
from itertools import product

import numpy as np

from nestql.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    parts = ["@", ".", "a", "b_", "%", "+", "-", "1", "22", "255", "256", "0", "4111111111111111", " ", "é", "(", ")", "٣", "\n", "a@b.co", "1.2.3.4", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "-" * 300_000, "a@" * 100_000, "1 " * 100_000):
        P.base_spans(text)


def test_propagation_is_exact_on_trees():
    rng = np.random.default_rng(2)
    k = len(P.KINDS) + 1
    field = P.Field(np.zeros((P.FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    unary = rng.normal(size=(4, k))
    chain, groups = [(0, 1), (1, 2)], [[2, 3]]
    got = P.propagate(unary, chain, groups, field, rounds=200)
    want = np.zeros((4, k))
    for labels in product(range(k), repeat=5):
        score = sum(unary[i, labels[i]] for i in range(4)) + sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[4], labels[i]] for i in groups[0])
        for i in range(4):
            want[i, labels[i]] += np.exp(score)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_skip_links_carry_labels():
    k = len(P.KINDS) + 1
    field = P.Field(np.zeros((P.FEATURES, k)), np.zeros((k, k)), 3 * np.eye(k))
    unary = np.zeros((3, k))
    unary[0, 3] = 5
    p = P.propagate(unary, [], [[0, 2]], field)
    assert p[2].argmax() == 3 and abs(p[2, 3] - 0.686) < 0.01 and np.allclose(p[1], 1 / k)


def test_field_adds_what_patterns_lose():
    rng = random.Random(3)

    def card():
        head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if P.luhn(head + c))

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    texts = [f"the word {card()} and\nthe {phone()} of it x{i}.{i:02d}@mail.example.com to 10.{i % 250}.3.4 in a9f3{i:04d}b2c4" for i in range(300)]
    field = P.fit(texts)
    number, line = card(), phone()
    text = f"call {line} {number} now"
    base = P.base_spans(text)
    assert base == []
    added = {(k, text[a:b]) for k, a, b in P.added_spans(text, base, field)}
    assert ("card", number) in added and added <= {("card", number), ("phone", line)}
    assert P.added_spans("the clean text of 1234 and token a9f30001b2c4", [], field) == []


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "é a.b@c.de 10.0.0.1", "c"), (3, "é a.b@c.de 10.0.0.1", "c"), (None, "x " * 50_000 + "a@b.c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Spans string")
    out = P.find_spans(df, P.train(df)).collect()
    assert sorted(r.base_spans for r in out) == sorted(["", "", "email:2:10,ip:11:19", "email:2:10,ip:11:19", "email:100000:100005"])
    assert all(set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(",")) for r in out)
    assert P.find_spans(df.limit(0), P.train(df.limit(0))).collect() == []


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    out = P.op8_pii(spark, sf_dir).toPandas().set_index("doc_id").loc[docs.index]
    for text, r in zip(docs.text, out.itertuples()):
        want = brute(text)
        assert r.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in P.KINDS)
        assert set(P.joined(want).split(",")) - {""} <= set(r.spans.split(","))


def planted(n, seed):
    rng = random.Random(seed)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("aeioustnr") for _ in range(rng.randrange(2, 8)))
    keys, texts = [], []
    for i in range(n):
        k, plain = key(), f"{word()} {rng.randrange(100)} {word()} v{rng.randrange(99)}.{rng.randrange(9)} {rng.randrange(1990, 2030)}"
        form = (f'token = "{k}"', f"password={k[:14]}", f"api_key: {k}", f"secret => '{k[:20]}'")[i % 4]
        keys.append(k if i % 4 in (0, 2) else k[:14] if i % 4 == 1 else k[:20])
        texts.append(f"{plain} {form} {plain}\n{word()} mail{i}@example.com {plain} 10.0.{i % 250}.7")
    return texts, keys


def test_secrets_are_found_by_their_context_and_where_they_repeat():
    texts, _ = planted(400, 1)
    field = P.fit(texts)
    more, keys = planted(200, 2)
    context = repeats = alone = 0
    for text, key in zip(more, keys):
        text = f"{key} comes first, {text} and once more {key}."
        found = {text[a:b] if k == "secret" else None for k, a, b in P.added_spans(text, P.base_spans(text), field)}
        places = [a for k, a, b in P.added_spans(text, P.base_spans(text), field) if k == "secret" and text[a:b] == key]
        context += key in found
        repeats += len(places) == 3
        alone += bool(P.added_spans(f"nothing {key[:9]} here 1234 v1.2 2021", [], field))
    assert context >= 0.95 * len(keys) and repeats >= 0.9 * len(keys) and alone == 0


def test_skip_links_carry_what_context_tells():
    """Without the skip potential, secrets that repeat without context are lost."""
    texts, _ = planted(400, 3)
    field = P.fit(texts)
    bare = P.Field(field.unary, field.chain, np.zeros_like(field.skip))
    more, keys = planted(100, 4)
    count = lambda f: sum(k == "secret" for text, key in zip(more, keys) for k, _, _ in P.added_spans(f"{key[:12]} x {text.replace(key, key[:12])} y {key[:12]}", [], f))
    assert count(field) > count(bare) + 100


def test_chain_knows_every_neighbour():
    text = 'call +1 (234) 555-7788 or a1b2c3 100 200\nx 300'
    found, _ = P.tokens(text)
    assert [text[a:b] for a, b in found] == ["+1", "(234", "555-7788", "a1b2c3", "100", "200", "300"]
    chain, groups, sides = P.links(text, found)
    assert chain == [(0, 1), (1, 2), (3, 4), (4, 5)] and groups == []
    assert sides.tolist() == [[1, 0], [0, 0], [0, 1], [1, 0], [0, 0], [0, 1], [1, 0]]


def test_samples_are_bounded(spark):
    rows = [(1, "a@b.co 1234")] * 500 + [(i, f"mail{i}@b.co 10.0.0.1 " * (1 + i % 40)) for i in range(2, 600)] + [(900, "9999 " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.sample(df, sample_docs=200, sample_chars=5000, total_chars=40_000)
    assert len(got) == len(set(got)) and 0 < sum(map(len, got)) <= 40_000 and max(map(len, got)) <= 5000


def test_query_finds_what_is_planted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    out = P.op8_pii(spark, sf_dir).toPandas().set_index("doc_id").loc[docs.index]
    forms = (r"\w@\w", r"\b\d+\.\d+\.\d+\.\d+\b", r"\+1 \(", r'token = "', r"password=", r"\bAKIA[A-Z0-9]{16}")
    want = [any(re.search(f, t) for f in forms) or any(P.luhn(x) for x in re.findall(r"\b[0-9]{16}\b", t)) for t in docs.text]
    hit = [n > 0 for n in out.n_spans]
    assert sum(want) >= 5 and sum(w and h for w, h in zip(want, hit)) >= 0.95 * sum(want)
    assert sum(h and not w for w, h in zip(want, hit)) <= 0.01 * len(want)
    secrets = {(i, m.start(1), m.end(1)) for i, t in docs.text.items() for m in re.finditer(r'token = "([0-9a-f]+)"', t)}
    found = {(i, *map(int, s.split(":")[1:])) for i, spans in out.spans.items() for s in spans.split(",") if s.startswith("secret")}
    assert len(secrets & found) >= 0.9 * len(secrets)
