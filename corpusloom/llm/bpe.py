"""Byte-level BPE over Arrow batches: a public rank file applied with numpy.

Pre-tokens of the usual byte-level pattern (contractions, letters, numbers,
other, white space) are found by comparing character classes, not by a regex.
Tier one is a minimal perfect hash over the vocabulary's pre-tokens of up to 16
bytes, whose two words are compared exactly; tier two, for misses, merges
linked bytes by a heap of ranks and remembers whole pre-tokens.

Null and empty texts have no ids. Nothing depends on special tokens: their
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space of the pattern's ``\s``; fixed values of the Unicode property White_Space.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WINDOW_BYTES = 1 << 19
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def class_table() -> np.ndarray:
    """Class of each code point."""
    t = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(p, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            t[a : b + 1] = kind
    t[0xD800:0xE000] = OTHER
    t[list(SPACES)] = SPACE
    return t


_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = class_table()
    return _CLASSES


def pretoken_starts(cp: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. cp: code points, cls: their classes, doc: True at the first of each text."""
    n = len(cp)
    start = np.ones(n, bool)
    if n < 2:
        return start
    space, before = cls == SPACE, np.roll(cls, 1)
    start[1:] = cls[1:] != before[1:]
    last = space.copy()  # last space of its run, with something other after it in its text
    last[:-1] &= ~space[1:] & ~doc[1:]
    last[-1] = False
    start |= last
    joins = np.zeros(n, bool)
    joins[1:] = (last & (cp == 32))[:-1]
    start &= ~joins
    start |= doc
    for i in np.flatnonzero(start & (cp == 39)):
        if i + 1 < n and not doc[i + 1]:
            one = cp[i + 1]
            size = 2 if one in (115, 116, 109, 100) else 0
            if not size and i + 2 < n and not doc[i + 2] and (one, cp[i + 2]) in ((114, 101), (118, 101), (108, 108)):
                size = 3
            if size:
                start[i + 1 : i + size] = False
                if i + size < n:
                    start[i + size] = True
    return start


class PerfectHash:
    """Minimal perfect hash by displacement over keys of two words, with the keys and a value at each slot."""

    def __init__(self, w0: np.ndarray, w1: np.ndarray, value: np.ndarray):
        n = self.n = len(value)
        self.buckets = max(1, n // 3)
        h = self.mix(w0, w1)
        b = self.bucket(h)
        self.shift = np.zeros(self.buckets, np.int64)
        slot_of, free = np.full(n, -1), np.ones(n, bool)
        order = np.argsort(b, kind="stable")
        edges = np.searchsorted(b[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        tries = np.arange(1, 65)
        for k in np.argsort(-sizes, kind="stable"):
            if sizes[k] < 2:
                break
            own, base = order[edges[k] : edges[k + 1]], 0
            while True:
                s = self.place(h[own][None, :], (tries + base)[:, None])
                ok = free[s].all(1)
                if len(own) > 1:
                    t = np.sort(s, 1)
                    ok &= (t[:, 1:] != t[:, :-1]).all(1)
                if ok.any():
                    i = int(np.argmax(ok))
                    self.shift[k], slot_of[own] = tries[i] + base, s[i]
                    free[s[i]] = False
                    break
                base += len(tries)
        rest = iter(np.flatnonzero(free))
        for k in np.flatnonzero(sizes == 1):
            i = order[edges[k]]
            s = next(rest)
            self.shift[k], slot_of[i] = -s - 1, s
        self.w0, self.w1, self.value = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.int32)
        self.w0[slot_of], self.w1[slot_of], self.value[slot_of] = w0, w1, value

    @staticmethod
    def mix(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        h = (w0 ^ (w0 >> np.uint64(29))) * _C[0] ^ (w1 ^ (w1 >> np.uint64(31))) * _C[1]
        h = (h ^ (h >> np.uint64(32))) * _C[2]
        return h ^ (h >> np.uint64(28))

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d.astype(np.uint64) * _C[0])) * _C[3]
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def get(self, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """Values of keys; -1 for those that are none."""
        h = self.mix(w0, w1)
        d = self.shift[self.bucket(h)]
        s = np.where(d < 0, -d - 1, self.place(h, np.maximum(d, 0)))
        return np.where((self.w0[s] == w0) & (self.w1[s] == w1), self.value[s], -1)


def words(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pre-tokens of at most 16 bytes as two words, the size in the free top of the second. data has 16 spare bytes."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    a, b = np.minimum(size, 8).astype(np.uint64), np.clip(size - 8, 0, 8).astype(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    cut = lambda w, k: np.where(k == 0, np.uint64(0), w & (full >> (np.uint64(64) - np.maximum(k, np.uint64(1)) * np.uint64(8))))
    return cut(view[at], a), cut(view[at + 8], b)


class ByteBpe:
    """Encoder of a rank file."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 200_000):
        self.ranks, self.keep, self.seen = ranks, keep, {}
        short = [(k, v) for k, v in ranks.items() if len(k) <= 16 and b"\0" not in k]  # zero bytes would pad alike
        data = np.frombuffer(b"".join(k for k, _ in short) + bytes(16), np.uint8)
        size = np.array([len(k) for k, _ in short])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.hash = PerfectHash(*words(data, at, size), np.array([v for _, v in short], np.int32))

    @classmethod
    def load(cls, path: str = DEFAULT_RANKS) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost of equals, is merged until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        part: list = [piece[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if part[i] is None or len(part[i]) != a or (j := after[i]) < 0 or len(part[j]) != b:
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]), len(part[k])))
            if (p := before[i]) >= 0 and (r := ranks.get(part[p] + part[i])) is not None:
                heapq.heappush(heap, (r, p, len(part[p]), len(part[i])))
        return [ranks[x] for x in part if x is not None]

    def _slow(self, piece: bytes) -> np.ndarray:
        got = self.seen.get(piece)
        if got is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            got = np.array(self.merge(piece), np.int32)
            if len(piece) <= 256:
                self.seen[piece] = got
        return got

    def encode(self, raw: bytes, ends: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of texts joined to *raw*, whose ends in bytes are *ends*, and the number of ids of each text."""
        texts = len(ends)
        if not raw:
            return (np.empty(0, np.int32) if ids else None), np.zeros(texts, np.int64)
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        byte_end = np.cumsum(width)
        first = np.concatenate([[0], ends[:-1]])
        first = first[first < len(raw)]
        doc = np.zeros(len(cp), bool)
        doc[np.searchsorted(byte_end, first, side="right")] = True
        start = np.flatnonzero(pretoken_starts(cp, classes()[cp], doc))
        at = (byte_end - width)[start]
        size = np.diff(np.append(at, len(raw)))
        data = np.frombuffer(raw + bytes(24), np.uint8)
        short = size <= 16
        found = np.full(len(at), -1, np.int32)
        w0, w1 = words(data, at[short], size[short])
        found[short] = self.hash.get(w0, w1)
        if b"\0" in raw:
            zero = np.add.reduceat(data[: len(raw)] == 0, at) > 0
            found[zero] = -1
        miss = np.flatnonzero(found < 0)
        slow = [self._slow(raw[a : a + s]) for a, s in zip(at[miss].tolist(), size[miss].tolist())]
        many = np.ones(len(at), np.int64)
        many[miss] = [len(x) for x in slow]
        upto = np.concatenate([[0], np.cumsum(many)])
        per = np.diff(np.concatenate([[0], upto[np.searchsorted(at, ends, side="left")]]))
        if not ids:
            return None, per
        out = np.empty(upto[-1], np.int32)
        hit = found >= 0
        out[upto[:-1][hit]] = found[hit]
        if slow:
            n = many[miss]
            out[np.repeat(upto[:-1][miss] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] = np.concatenate(slow)
        return out, per

    def windows(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """Joined bytes and ends of runs of texts of about WINDOW_BYTES; null is empty."""
        part: list[bytes] = []
        held = 0
        for t in texts.cast(pa.large_binary()).to_pylist():
            part.append(t or b"")
            held += len(part[-1])
            if held >= WINDOW_BYTES:
                yield b"".join(part), np.cumsum([len(x) for x in part])
                part, held = [], 0
        if part:
            yield b"".join(part), np.cumsum([len(x) for x in part])

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Lists of ids."""
        out, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for raw, ends in self.windows(texts):
            got, per = self.encode(raw, ends)
            out.append(got)
            sizes.append(per)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(out)))

    def count_array(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids."""
        return np.concatenate([np.zeros(0, np.int64), *(self.encode(raw, ends, ids=False)[1] for raw, ends in self.windows(texts))])
