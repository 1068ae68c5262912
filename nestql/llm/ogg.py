"""Media columns in the Ogg container.

``mux`` writes logical streams as Ogg pages: packets cut into lacing values, which
fill pages and so go on across them, a checksum and a granule position a page, a
first page of each stream before all others. ``demux`` reads them back: it verifies page checksums and sequence
numbers, reassembles packets from the lacing values, also across pages, and
keeps the logical streams apart; times come from granule positions.

``encode`` stores a text's bytes, padded with zeros to a positive multiple of
64, as 8-bit samples in one stream of ``PACKET`` samples a packet, and the
number of bytes that aren't padding in a second stream. Serial numbers derive
from the content, so equal texts give equal files.

Defined cases: a null text counts as empty, and an empty one gives 64 zero
samples; texts of any length are stored whole; a null file gives null features;
a damaged file raises ``OggError``; repeated rows give a row each; no documents
give no rows; input columns named like an output are replaced, others kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nestql.llm.common import map_texts, table, tidy, utf8

ALIGN = 64
RATE = 8000
#: Samples of a packet.
PACKET = 8192
#: Lacing values of a page; the format's most is 255.
LACING = 255
SAMPLES, LENGTHS = b"NqPCM8\x00\x01", b"NqLEN\x00\x00\x01"
#: What the format says of a page on which no packet ends.
NO_GRANULE = (1 << 64) - 1
CONTINUED, FIRST, LAST = 1, 2, 4

_reverse = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_header = struct.Struct("<4sBBQIIIB")


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The page checksum: CRC-32 of polynomial 04C11DB7, unreflected, from zero, no final xor.

    zlib's CRC is the reflected one; bytes and result are reflected around it.
    """
    crc = zlib.crc32(page.translate(_reverse), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_reverse), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _header.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one stream. packets: (bytes, granule position at its end); the first has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal granule, continued
        flags = CONTINUED * continued | FIRST * (not out) | LAST * last
        out.append(_page(serial, len(out), flags, granule, bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, continued = NO_GRANULE, goes_on

    for k, (packet, end) in enumerate(packets):
        left, at = len(packet), 0
        while True:
            if len(lacing) == LACING:
                flush(False, at > 0)
            n = min(left, 255 * (LACING - len(lacing)))
            full = n // 255
            lacing += b"\xff" * full
            body += packet[at : at + full * 255]
            at += full * 255
            left -= full * 255
            if left < 255 and len(lacing) < LACING:
                lacing.append(left)
                body += packet[at:]
                break
        granule = end
        if k == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """A file of logical streams: first pages together, then the others in turn."""
    pages = [pages_of(serial, packets) for serial, packets in streams.items()]
    out = [p[0] for p in pages]
    for k in range(1, max(map(len, pages), default=0)):
        out += [p[k] for p in pages if k < len(p)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: For each packet the granule position at its end, where its page gives it (else None).
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _part: list[bytes] = field(default_factory=list)

    def seconds(self, rate: int) -> list[float | None]:
        return [None if g is None else g / rate for g in self.granules]


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams of a file, each page verified."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError(f"a page header is cut short at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = _header.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        size = sum(lacing)
        end = at + 27 + n + size
        if len(lacing) < n or end > len(data):
            raise OggError(f"a page is cut short at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or number != s.pages:
            raise OggError(f"stream {serial}: page {number} where {s.pages} is due")
        if bool(flags & CONTINUED) != bool(s._part):
            raise OggError(f"stream {serial}: a packet isn't continued")
        s.pages += 1
        body, first = at + 27 + n, 0
        before = len(s.packets)
        while first < n:
            last = first
            while last < n and lacing[last] == 255:
                last += 1
            whole = last < n
            length = 255 * (last - first) + (lacing[last] if whole else 0)
            piece = data[body : body + length]
            body += length
            s._part.append(piece)
            if whole:
                s.packets.append(b"".join(s._part) if len(s._part) > 1 else piece)
                s.granules.append(None)
                s._part.clear()
            first = last + 1
        if len(s.packets) > before and granule != NO_GRANULE:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s._part or not s.ended:
            raise OggError(f"stream {s.serial} doesn't end")
    return streams


def pad(raw: bytes) -> bytes:
    return raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def store(raw: bytes) -> bytes:
    """Bytes as an Ogg file of 8-bit samples."""
    payload = pad(raw)
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    samples = [(SAMPLES + struct.pack("<IB", RATE, 1), 0)]
    samples += [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    return mux({serial: samples, serial + 1: [(LENGTHS, 0), (struct.pack("<Q", len(raw)), len(payload))]})


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    rate: int
    seconds: float
    pages: int


def load(data: bytes) -> Media:
    """What ``store`` has stored, from the file's bytes alone."""
    streams = list(demux(data).values())
    kinds = {s.packets[0][:8]: s for s in streams if s.packets}
    if SAMPLES not in kinds or LENGTHS not in kinds:
        raise OggError("no stream of samples")
    s = kinds[SAMPLES]
    rate, _ = struct.unpack_from("<IB", s.packets[0], 8)
    payload = b"".join(s.packets[1:])
    if s.granules[-1] != len(payload):
        raise OggError("granule positions don't match the samples")
    (n,) = struct.unpack("<Q", kinds[LENGTHS].packets[1])
    return Media(payload, n, rate, s.seconds(rate)[-1] or 0.0, sum(x.pages for x in streams))


def feature(media: Media) -> str:
    """Seconds, pages, mean, root mean square around it, changes of sign around it, and peak of the samples."""
    x = np.frombuffer(media.payload, np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    high = x * n >= total
    crossings = int((high[1:] != high[:-1]).sum())
    mean = total / n
    rms = max(squares / n - mean * mean, 0.0) ** 0.5
    return f"seconds={media.seconds:.6f};pages={media.pages};mean={mean:.4f};rms={rms:.4f};crossings={crossings};peak={int(x.max())}"


def encode(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``media``, the Ogg file of each text's bytes."""
    return map_texts(tidy(docs, text), lambda: lambda texts: [[store(utf8(t)) for t in texts]], "media binary", text=text)


def decode(df: DataFrame) -> DataFrame:
    """``df`` with what its ``media`` column holds: payload digests, sizes and ``feature``."""

    def start():
        def run(files):
            rows = []
            for data in files:
                if data is None:
                    rows.append((None,) * 7)
                    continue
                m = load(data)
                rows.append((m.n_bytes, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(m)))
            return list(zip(*rows, strict=True)) if rows else [[]] * 7

        return run

    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    df = tidy(df, "media")
    return map_texts(df, start, added, text="media", keep=[c for c in df.columns if c != "media"])


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tidy(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "text")
    return decode(encode(docs).select("doc_id", "media"))
