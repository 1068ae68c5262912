import hashlib
import random
import zlib

import pytest

from nestql.llm import ogg as O


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", bytes(range(256)), b"OggS" * 31):
        assert O.checksum(data) == slow_checksum(data)


def test_streams_round_trip():
    rng = random.Random(4)
    for _ in range(60):
        streams = {}
        for serial in rng.sample(range(1000), rng.randrange(1, 4)):
            sizes = [rng.choice([0, 1, 254, 255, 256, 510, 65024, 65025, 65026, 70000, 200000]) for _ in range(rng.randrange(1, 12))]
            ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
            streams[serial] = [(rng.randbytes(n), e) for n, e in zip(sizes, ends)]
        data = O.mux(streams)
        got = O.demux(data)
        assert {k: s.packets for k, s in got.items()} == {k: [p for p, _ in v] for k, v in streams.items()}
        for k, s in got.items():
            assert all(g is None or g == e for g, (_, e) in zip(s.granules, streams[k])) and s.granules[-1] == streams[k][-1][1]


def test_damage_is_found():
    data = O.store(b"hello world" * 5000)
    rng = random.Random(5)
    for _ in range(50):
        at = rng.randrange(len(data))
        with pytest.raises(O.OggError):
            O.demux(data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :])
    with pytest.raises(O.OggError):
        O.demux(data[:-1])


def test_store_and_load():
    for n in (0, 1, 63, 64, 65, 8191, 8192, 8193, 300_000):
        raw = random.Random(n).randbytes(n)
        m = O.load(O.store(raw))
        assert m.payload == raw + bytes(max(64, -(-n // 64) * 64) - n) and m.n_bytes == n
        assert m.seconds == len(m.payload) / O.RATE
    x = O.load(O.store(b"\x00\xff" * 32))
    assert O.feature(x) == "seconds=0.008000;pages=4;mean=127.5000;rms=127.5000;crossings=63;peak=255"


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "é" * 40, "c"), (3, "é" * 40, "c"), (None, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Media string")
    out = O.decode(O.encode(df)).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert out[0].media_sha256 == out[1].media_sha256 and out[2].feature == out[3].feature
    assert O.decode(O.encode(df.limit(0))).collect() == []


TABLE = [slow_checksum(bytes([b])) for b in range(256)]


def parsed(data):
    """A plain reader: for each stream its packets, its pages' (flags, granule), and how many packets cross pages."""
    at, streams = 0, {}
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        flags = data[at + 5]
        granule, serial, number, crc = (int.from_bytes(data[at + i : at + j], "little") for i, j in ((6, 14), (14, 18), (18, 22), (22, 26)))
        lacing = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(lacing)
        page = bytearray(data[at : body + sum(lacing)])
        page[22:26] = bytes(4)
        got = 0
        for b in page:
            got = (got << 8 & 0xFFFFFFFF) ^ TABLE[got >> 24 ^ b]
        assert got == crc
        packets, pages, part, crossing = streams.setdefault(serial, ([], [], [], []))
        assert number == len(pages) and bool(flags & 1) == bool(part) and bool(flags & 2) == (number == 0)
        crossing += [1] * (flags & 1)
        pages.append((flags, granule))
        for n in lacing:
            part.append(data[body : body + n])
            body += n
            if n < 255:
                packets.append(b"".join(part))
                part.clear()
        at = body
    assert all(not part and pages[-1][0] & 4 for _, pages, part, _ in streams.values())
    return {k: (packets, pages, len(crossing)) for k, (packets, pages, _, crossing) in streams.items()}


def checked(raw, r):
    """What the columns of a stored text must be, from a plain reader and plain arithmetic."""
    media = O.store(raw)
    streams = parsed(media)
    samples = next(v for v in streams.values() if v[0][0].startswith(b"NqPCM8"))
    payload = b"".join(samples[0][1:])
    assert payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and samples[1][-1][1] == len(payload)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    told = dict(x.split("=") for x in r.feature.split(";"))
    total, n = sum(payload), len(payload)
    mean = total / n
    rms = (sum((b - mean) ** 2 for b in payload) / len(payload)) ** 0.5
    signs = [b * n >= total for b in payload]
    assert int(told["pages"]) == sum(len(v[1]) for v in streams.values()) and int(told["peak"]) == max(payload)
    assert int(told["crossings"]) == sum(a != b for a, b in zip(signs, signs[1:]))
    assert abs(float(told["mean"]) - mean) < 1e-3 and abs(float(told["rms"]) - rms) < 1e-3 and abs(float(told["seconds"]) - len(payload) / 8000) < 1e-5
    return samples[2]


def test_query_matches_a_plain_reader(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    out = O.op5_ogg_media(spark, sf_dir).toPandas().set_index("doc_id").loc[docs.index]
    for text, r in zip(docs.text, out.itertuples()):
        checked(text.encode(), r)


def test_packets_of_long_texts_cross_pages(spark, tmp_path):
    texts = ["x" * 70_000, "é" * 200_000, "short", "y" * 58_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in O.op5_ogg_media(spark, str(tmp_path)).collect()}
    assert [checked(t.encode(), out[i]) > 0 for i, t in enumerate(texts)] == [True, True, False, False]


def test_clashing_names(spark):
    df = O.encode(spark.createDataFrame([("abc", 1)], "text string, N_Bytes int")).selectExpr("media", "'x' as MEDIA", "N_Bytes")
    assert [r.n_bytes for r in O.decode(df).collect()] == [3]
