"""Byte-pair merges over ragged arrays, shared by token counts and byte-level encoding.

``Merges.encode`` holds a batch of byte strings as one flat array of symbols
and applies, in each round, every string's lowest-rank pair at all its places
at once. Where a round's merge makes a pair of a lower rank than itself, which
the order of one merge after the other could use sooner, and for very long
strings, ``Merges.one`` merges one string by a heap instead.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import regex

NONE = np.iinfo(np.int32).max
#: Bytes beyond which a string is merged by itself.
LONG_BYTES = 4096
#: Entries of either half of a worker's memory of encoded words: the older half goes when the newer is full.
MEMORY = 100_000
#: Characters of a text that are split into words at one time.
WINDOW = 1 << 20

PATTERN = regex.compile(public_tokenizers.PATTERN)
_word_like = regex.compile(r"[\p{L}\p{N}]")
_blank = "".join(re.escape(chr(c)) for c in range(0x3001) if regex.match(r"\s", chr(c)))
#: A text's words, each with the blank before it, and its runs of blanks: the pattern's matches never cross their edges.
WORD = re.compile(f" ?[^{_blank}]+|[{_blank}]+(?![^{_blank}])|[{_blank}]")
_blanks = frozenset(["", *(chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c)))])
_edge = re.compile(f"(?<=[^{_blank}])[{_blank}]")


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Parts of a text, cut before a blank that follows another character: edges of words."""
    at = 0
    while len(text) - at > size:
        m = _edge.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Merges:
    def __init__(self, base: np.ndarray, pairs: np.ndarray):
        """base: the symbol of each byte. pairs: rows (left, right, rank, symbol)."""
        self.base = base.astype(np.int64)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        self.bits = max(8, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            put = left[first]
            self.keys[at[first]], self.rank[at[first]], self.made[at[first]] = keys[put], pairs[put, 2], pairs[put, 3]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; one with rank NONE where there is no such pair."""
        keys = left << 20 | right
        at = self._slot(keys)
        lost = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(lost):
            at[lost] = (at[lost] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[lost]]
            lost = lost[(got != keys[lost]) & (got != -1)]
        return at

    def ragged(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all strings, joined, and how many each has."""
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        own = np.flatnonzero((lens > 0) & (lens <= LONG_BYTES))
        alone = np.flatnonzero(lens > LONG_BYTES).tolist()
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # strings, their sizes, their symbols
        sizes = lens[own]
        flat = self.base[np.frombuffer(b"".join([strings[i] for i in own]), np.uint8)]
        last, several = np.full(len(own), -1, np.int64), np.zeros(len(own), bool)
        while len(own):
            starts = np.cumsum(sizes) - sizes
            slots = np.empty(len(flat), np.int64)
            slots[:-1] = self.find(flat[:-1], flat[1:])
            rank = np.full(len(flat), NONE, np.int64)
            rank[:-1] = self.rank[slots[:-1]]
            rank[starts + sizes - 1] = NONE
            best = np.minimum.reduceat(rank, starts)
            again = (best < last) & several
            ended = (best == NONE) | again
            if ended.any():
                alone += own[again].tolist()
                stay = np.repeat(~ended, sizes)
                out = ended & ~again
                done.append((own[out], sizes[out], flat[np.repeat(out, sizes)]))
                flat, rank, slots = flat[stay], rank[stay], slots[stay]
                own, sizes, best = own[~ended], sizes[~ended], best[~ended]
                if not len(own):
                    break
            which = np.repeat(np.arange(len(own)), sizes)
            hit = np.flatnonzero(rank == best[which])
            new = np.append(True, (np.diff(hit) != 1) | (which[hit[1:]] != which[hit[:-1]]))
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            merged = np.bincount(which[hit], minlength=len(own))
            flat[hit] = self.made[slots[hit]]
            stay = np.ones(len(flat), bool)
            stay[hit + 1] = False
            flat, sizes, last, several = flat[stay], sizes - merged, best, merged > 1
        for i in alone:
            one = self.one(strings[i])
            done.append((np.array([i]), np.array([len(one)]), one))
        counts = np.zeros(len(strings), np.int64)
        for of, n, _ in done:
            counts[of] = n
        starts, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
        for of, n, symbols in done:
            out[np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, counts

    def encode(self, strings: list[bytes]) -> list[np.ndarray]:
        """The symbols of each string."""
        flat, sizes = self.ragged(strings)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and symbol of each pair, for single lookups."""
        there = self.keys >= 0
        return dict(zip(self.keys[there].tolist(), zip(self.rank[there].tolist(), self.made[there].tolist(), strict=True), strict=True))

    def one(self, string: bytes) -> np.ndarray:
        """The symbols of one string, one merge after the other."""
        sym = self.base[np.frombuffer(string, np.uint8)].tolist()
        n, pairs = len(sym), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*pairs[k], i, k) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (k := a << 20 | b) in pairs]
        heap = [(rank, i, made, k) for rank, made, i, k in heap]
        heapq.heapify(heap)

        while heap:
            _, i, made, k = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] << 20 | sym[j] != k:
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := sym[x] << 20 | sym[y]) in pairs:
                    rank, made = pairs[k]
                    heapq.heappush(heap, (rank, x, made, k))
            if after[i] >= 0:
                before[after[i]] = i
        return np.array([s for s in sym if s >= 0], np.int64)


@lru_cache(maxsize=2)
def from_json(path: str) -> tuple[Merges, tuple[str, ...]]:
    """The merges of a tokenizer file, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    # byte-level alphabets write each byte as a visible character: its own where it has one, else the next from 256
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    letters = [chr(b) if b in visible else chr(next(rest)) for b in range(256)]
    pairs = np.array([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)], np.int64)
    return Merges(np.array([vocab[c] for c in letters]), pairs), tuple(t["content"] for t in spec.get("added_tokens", []))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def from_ranks(path: str) -> tuple[Merges, dict[bytes, int]]:
    """The merges of a rank file: any two tokens whose bytes joined are a token. Also ranks by bytes."""
    ranks = read_ranks(path)
    pairs = np.fromiter((x for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks for x in (ranks[t[:i]], ranks[t[i:]], r, r)), np.int64)
    return Merges(np.array([ranks[bytes([b])] for b in range(256)]), pairs.reshape(-1, 4)), ranks


@lru_cache(maxsize=2)
def words_of(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    ranks = read_ranks(path)
    words = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        words[r] = t
    return words


def matches(text: str, other: Callable[[str], bool]) -> list[str]:
    """The pattern's matches, which make up the text.

    Characters may be letters or numbers to the pattern engine here and not yet
    to a tokenizer library, whose tables are older; ``other(c)`` tells which.
    """
    if not text.isascii() and max(text) > "\u0530":
        new = {c for c in set(text) if c > "\u0530" and unicodedata.category(c) == "Cn" and _word_like.match(c) and other(c)}
        if new:
            shown = text.translate({ord(c): "\u2603" for c in new})  # a symbol, of the same length
            return [text[m.start() : m.end()] for m in PATTERN.finditer(shown)]
    return PATTERN.findall(text)


def pieces(words: Iterable[str], other: Callable[[str], bool]) -> tuple[list[str], list[bytes], list[int]]:
    """Words in another order, the pattern's matches of all of them as bytes, and how many each word has.

    Words after a blank are split joined together: no match crosses their edges.
    """
    led: list[str] = []
    rest: list[str] = []
    for w in words:
        (led if w[0] == " " and w[1:2] not in _blanks else rest).append(w)
    found = matches("".join(led), other)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    counts = np.diff(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, led), np.int64, len(led))), side="right"), prepend=0).tolist()
    for w in rest:
        own = matches(w, other)
        found += own
        counts.append(len(own))
    return led + rest, [p.encode("utf-8", "surrogatepass") for p in found], counts


@lru_cache(maxsize=4096)
def other_in_tokenizers(c: str) -> bool:
    """Whether the tokenizers library takes a character for neither letter nor number: it then joins an apostrophe."""
    from tokenizers import pre_tokenizers

    return len(pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(c + "'s")[0][0]) > len(c.encode())


@lru_cache(maxsize=4096)
def other_in_tiktoken(c: str) -> bool:
    return _probe().encode_ordinary(c + "'s")[-1] != 256


@lru_cache(maxsize=1)
def _probe():
    """An encoding of single bytes and the one token ``'s``, which shows where a split is."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"'s": 256}
    return tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
