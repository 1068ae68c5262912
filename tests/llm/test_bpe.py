import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from nestql.llm import bpe, byte_bpe, token_counts

ALPHABET = [" ", "  ", "\n", "\t", "'s", "'", "é", "ß", "a", "b", "the", "1", "22", "!", "\x85", "\xa0", "　", "\x1c", "<|endoftext|>", "日", "😀", "aaaa", "\u0c5c", "\U000323b0"]


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(600)]
    return out + ["", "a" * 9000, " " * 9000, "ab" * 5000, "1" * 5001 + "\n", "<|endoftext|>" * 3]


@pytest.fixture(scope="module")
def rank_encoder():
    encoder = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    return encoder, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_words_keep_the_patterns_matches():
    for t in texts():
        assert [p for w in bpe.WORD.findall(t) for p in bpe.PATTERN.findall(w)] == bpe.PATTERN.findall(t)
        for other in (bpe.other_in_tokenizers, bpe.other_in_tiktoken):
            assert [p for w in bpe.WORD.findall(t) for p in bpe.matches(w, other)] == bpe.matches(t, other)
        parts = list(bpe.windows(t, 10))
        assert "".join(parts) == t
        assert [p for x in parts for p in bpe.PATTERN.findall(x)] == bpe.PATTERN.findall(t)


def test_counts_match_the_library(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(x.ids) for x in library.encode_batch(texts(), add_special_tokens=False)]
    counter = token_counts.Counter(path)
    assert counter(texts()) == want
    assert counter([None]) == [0]
    monkeypatch.setattr(bpe, "WINDOW", 50)
    monkeypatch.setattr(bpe, "MEMORY", 20)
    assert token_counts.Counter(path)(texts()) == want


def test_ids_match_the_library(rank_encoder):
    encoder, library = rank_encoder
    for t, ids in zip(texts(), encoder.texts(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert byte_bpe.decoded(ids, bpe.words_of(P.path("byte_bpe_50k.tiktoken"))) == t.encode()


def test_rounds_match_single_merges(rank_encoder):
    merges = rank_encoder[0].merges
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"abcthe ") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [b"", b"aaaaaaa"]
    for s, got in zip(strings, merges.encode(strings)):
        assert got.tolist() == merges.one(s).tolist()


@pytest.mark.parametrize("size,overlap", [(7, 3), (5, 1), (16, 8), (40, 0)])
def test_chunks_stitch_to_the_whole_split(size, overlap):
    for t in texts()[:200] + ["a" * 100, "a b" * 40 + " " * 60 + "c", "a " * 30 + "b" * 90 + " c" * 30, "x" * 1000 + " y", " " * 50 + "x" * 50 + "\n" * 50]:
        if t:
            assert byte_bpe.words_of(t, size, overlap) == bpe.WORD.findall(t)


def test_words_are_split_together_as_alone():
    words = {w for t in texts() for w in bpe.WORD.findall(t)}
    for other in (bpe.other_in_tokenizers, bpe.other_in_tiktoken):
        order, strings, counts = bpe.pieces(words, other)
        assert sorted(order) == sorted(words) and sum(counts) == len(strings)
        at = 0
        for w, n in zip(order, counts):
            assert [s.decode() for s in strings[at : at + n]] == bpe.matches(w, other)
            at += n
    assert bpe.pieces(set(), bpe.other_in_tiktoken) == ([], [], [])


def test_long_words_take_linear_time():
    text = "x" * 3_000_000 + " y " * 100_000
    assert byte_bpe.words_of(text) == bpe.WORD.findall(text)


def test_memory_keeps_the_words_it_met_last(monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    want = byte_bpe.Encoder(path).texts(texts())
    monkeypatch.setattr(bpe, "MEMORY", 20)
    encoder = byte_bpe.Encoder(path)
    for t, ids in zip(texts(), want):
        assert encoder.texts([t]) == [ids]
        assert len(encoder.known) <= max(20, len(set(bpe.WORD.findall(t))))


SPANNING = "a " * 300 + "b" * 2500 + " c" * 10 + "d" * 900 + "\n\n  e" * 300


@pytest.mark.parametrize("chunk,overlap,segment", [(64, 16, 400), (100, 50, 1000), (64, 8, 10**6)])
def test_cases(spark, rank_encoder, chunk, overlap, segment):
    long = " ".join(f"word{i}'s" for i in range(2000)) + "x" * 500
    rows = [(1, None, "a"), (2, "", None), (3, "Hello's  world\n", "b"), (3, "Hello's  world\n", "b"), (None, long, "c"), (5, long, "c"), (6, SPANNING, "d"), (7, "y" * 5000, "d"), (8, " " * 3000 + "\n" * 2000, None), (9, "日本語 " * 900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Ids string").selectExpr("*", "text as TEXT", "1 as Decoded", "2 as N_TOKENS")
    out = byte_bpe.decode(byte_bpe.encode(df, chunk=chunk, overlap=overlap, segment=segment)).collect()
    assert len(out) == len(rows) and sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    for r in out:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == rank_encoder[1].encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.n_tokens == len(r.ids) // 4
    if segment == 400:
        counts = token_counts.count_tokens(df).collect()
        assert [(r.n_bytes, r.over_limit) for r in counts if r.doc_id in (1, 2)] == [(0, False)] * 2
        assert [r.over_limit for r in counts if r.text == long] == [True, True]
        assert byte_bpe.encode(df.limit(0)).collect() == [] and token_counts.count_tokens(df.limit(0)).collect() == []
        clash = spark.createDataFrame([(None, "x")], "ids binary, IDS string")
        assert [bytes(r.decoded) for r in byte_bpe.decode(clash).collect()] == [b""]


def test_query_deals_out_long_texts(spark, tmp_path, rank_encoder):
    words = [f"w{i * i % 997}'s {'zz' * (i % 9)}\n" for i in range(30_000)]
    rows = [(i, t) for i, t in enumerate(["".join(words), SPANNING * 30, "z" * 100_000, "".join(words[:700]), None, " \n" * 40_000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in byte_bpe.op10_byte_bpe(spark, str(tmp_path)).collect()}
    assert len(rows[0][1]) > 8 * byte_bpe.SEGMENT and len(out) == len(rows)
    for i, t in rows:
        ids = np.array(rank_encoder[1].encode_ordinary(t or ""), "<u4")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_queries_match_the_libraries(spark, sf_dir, rank_encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = token_counts.op6_token_counts(spark, sf_dir).toPandas().set_index("doc_id")
    assert counts.n_tokens[docs.index].tolist() == [len(x.ids) for x in library.encode_batch(docs.text.tolist(), add_special_tokens=False)]
    out = byte_bpe.op10_byte_bpe(spark, sf_dir).toPandas().set_index("doc_id").loc[docs.index]
    ids = [np.array(rank_encoder[1].encode_ordinary(t), "<u4") for t in docs.text]
    assert out.ids_sha256.tolist() == [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
    assert out.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in docs.text]
