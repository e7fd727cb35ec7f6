"""Vectorised pre-tokenisation for byte-level BPE, and a bounded cache of encoded pieces.

The split pattern of byte-level BPE
(`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`)
only needs the class of each character, so a buffer of many texts is split by a few NumPy
passes. Texts with a character whose class depends on the Unicode version of a regex
library, or with white space beyond ASCII, are reported as exotic; callers give those whole
texts to the library.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from . import vec

LETTER, NUMBER, SPACE, OTHER, EXOTIC = range(5)


def _classes() -> np.ndarray:
    out = np.full(0x10001, EXOTIC, np.uint8)
    old = unicodedata.ucd_3_2_0
    kind = lambda c: {"L": LETTER, "N": NUMBER, "C": EXOTIC, "Z": EXOTIC}.get(c[0], OTHER)
    for cp in range(0x80, 0xFFFE):
        ch = chr(cp)
        a, b = kind(old.category(ch)), kind(unicodedata.category(ch))
        if a == b:
            out[cp] = a
    for cp in range(0x80):
        c = unicodedata.category(chr(cp))
        out[cp] = SPACE if cp in (32, *range(9, 14)) else EXOTIC if 0x1C <= cp <= 0x1F else OTHER if c[0] in "CPSZ" else kind(c)
    return out


_TABLE: list[np.ndarray] = []


def table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def split(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the pieces of all texts, the first piece of each text (n + 1), and which texts are exotic.
    A piece ends where the next starts; no piece crosses texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64), np.zeros(len(at) - 1, bool)
    t = table()
    cls = t[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    exotic = np.zeros(len(at) - 1, bool)
    if len(lead):
        b = buf[lead].astype(np.int32)
        pad = np.concatenate((buf, np.zeros(3, np.uint8)))
        c1, c2 = pad[lead + 1].astype(np.int32) & 63, pad[lead + 2].astype(np.int32) & 63
        cp = np.where(b < 0xE0, (b & 31) << 6 | c1, np.where(b < 0xF0, (b & 15) << 12 | c1 << 6 | c2, 0x10000))
        c = t[cp]
        cls[lead] = c
        cls[lead + 1] = c
        three = b >= 0xE0
        cls[lead[three] + 2] = c[three]
        four = b >= 0xF0
        cls[lead[four] + 3] = c[four]
    if (odd := np.flatnonzero(cls == EXOTIC)).size:
        exotic[np.searchsorted(at, odd, "right") - 1] = True
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    run = edge[:-1].copy()
    run[1:] |= cls[1:] != cls[:-1]
    rs = np.flatnonzero(run)
    re_ = np.append(rs[1:], n)
    space = cls[rs] == SPACE
    st = run
    before = space & ~edge[re_]  # white space followed by something else in its text
    last = re_[before] - 1
    st[re_[before][buf[last] == 0x20]] = False
    st[last] = True
    quote = np.flatnonzero((buf == 0x27) & st)
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~edge[quote + 1]]
    if quote.size:
        pad = np.concatenate((buf, np.zeros(4, np.uint8)))
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & ~edge[np.minimum(quote + 2, n)]
        for q, k in ((quote[one], 2), (quote[two], 3)):
            st[q + 1] = False
            q = q[q + k < n] + k
            st[q] = True
    starts = np.flatnonzero(st)
    return starts, np.searchsorted(starts, at), exotic


class Encoder:
    """Encodes buffers of texts; pieces seen before come from a bounded cache.

    pieces: token ids of distinct pieces, laid end to end, and their counts.
    text: token ids of a whole text (exotic, or holding one of `whole`). slots, room (ids) and held (bytes)
    bound the cache's memory. A hash names a piece's slot in the cache; its bytes decide whether it is there.
    """

    #: Bytes that one pass handles; longer texts are cut where a word ends and one space comes before the next.
    MOST = 1 << 18

    def __init__(self, pieces: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], text: Callable[[str], list[int]], slots: int = 1 << 21, room: int = 1 << 22, held: int = 1 << 23, whole: Sequence[bytes] = ()):
        self.pieces, self.text, self.slots, self.room, self.held = pieces, text, slots, room, held
        self.whole = [x for x in whole if x]
        self.clear()

    def clear(self) -> None:
        self.value = np.full(self.slots, -1, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint16), 0
        self.bytes, self.n_bytes = np.zeros(1 << 17, np.uint8), 0
        #: Of each piece: its first id and its first byte (and the ends of the last).
        self.off, self.at, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def _room(self, name: str, size: int) -> None:
        a = getattr(self, name)
        if size > len(a):
            b = np.zeros(2 * size, a.dtype)
            b[: len(a)] = a
            setattr(self, name, b)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        flat, counts = self.pieces(pieces)
        for name, size in (("ids", self.n_ids + len(flat)), ("bytes", self.n_bytes + sum(map(len, pieces)) + 8), ("off", self.n + len(counts) + 1), ("at", self.n + len(counts) + 1)):
            self._room(name, size)
        new = slice(self.n + 1, self.n + 1 + len(counts))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.off[new] = self.n_ids + np.cumsum(counts)
        self.at[new] = self.n_bytes + np.cumsum([len(x) for x in pieces])
        self.bytes[self.n_bytes : int(self.at[self.n + len(counts)])] = np.frombuffer(b"".join(pieces), np.uint8)
        out = np.arange(self.n, self.n + len(counts), dtype=np.int32)
        self.n, self.n_ids, self.n_bytes = self.n + len(counts), self.n_ids + len(flat), int(self.at[self.n + len(counts)])
        return out

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, laid end to end, and the count of each text."""
        parts = self._parts(buf, at)
        found = [self._encode(buf[parts[i] : parts[j]], parts[i : j + 1] - parts[i]) for i, j in vec.blocks(buf, parts, self.MOST)]
        if len(found) == 1 and len(parts) == len(at):
            return found[0]
        ids, counts = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint16, np.int64), zip(*found) if found else ((), ())))
        if len(parts) > len(at):
            counts = np.bincount(np.searchsorted(at, parts[:-1], "right") - 1, weights=counts, minlength=len(at) - 1).astype(np.int64)
        return ids, counts

    def _parts(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """at, and cuts inside of texts longer than MOST."""
        cuts = []
        for i in np.flatnonzero(np.diff(at) > self.MOST):
            b = buf[at[i] : at[i + 1]]
            if any(b.tobytes().find(x) >= 0 for x in self.whole):
                continue  # goes to the library whole
            word = (b > 0x20) & (b < 0x7F)
            fine = np.flatnonzero(word[:-2] & (b[1:-1] == 0x20) & word[2:]) + 1
            k = 0
            while k + self.MOST < len(b):
                j = int(np.searchsorted(fine, k + self.MOST)) - 1
                if j < 0 or fine[j] <= k:
                    j += 1
                if j >= len(fine):
                    break
                k = int(fine[j])
                cuts.append(at[i] + k)
        return np.sort(np.concatenate((at, np.array(cuts, np.int64)))) if cuts else at

    def _encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first, exotic = split(buf, at)
        laid = buf.tobytes() if self.whole else b""
        for x in self.whole:
            # two texts laid end to end may seem to hold one: the first goes whole too, with the same ids
            k = laid.find(x)
            while k >= 0:
                exotic[np.searchsorted(at, k, "right") - 1] = True
                k = laid.find(x, k + 1)
        if self.n_ids > self.room or self.n_bytes > self.held:
            self.clear()
        ends = np.append(starts[1:], len(buf))
        size, w = ends - starts, vec.eights(buf)
        h = vec.slices_hash(buf, starts, ends)
        # a piece is in the slot that the low bits of its hash name, or else in that of higher bits
        slots = [(x & np.uint64(self.slots - 1)).astype(np.int64) for x in (h, h >> np.uint64(32))]
        which, miss = np.empty(len(h), np.int64), np.arange(len(h))
        cache = vec.eights(self.bytes[: self.n_bytes])
        for slot in slots:
            known = self.value[slot[miss]]
            held = self.at[np.maximum(known, 0)].astype(np.int64)
            there = (known >= 0) & vec.slices_equal(w, starts[miss], size[miss], cache, held, self.at[np.maximum(known, 0) + 1] - held)
            which[miss[there]] = known[there]
            miss = miss[~there]
        if miss.size:
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = buf.tobytes()
            rep = miss[one]
            new = self._add([raw[starts[i] : ends[i]] for i in rep.tolist()])
            which[miss] = new[back]
            self.value[np.where(self.value[slots[0][rep]] < 0, slots[0][rep], slots[1][rep])] = new
            rep = rep[back]
            other = miss[~vec.slices_equal(w, starts[miss], size[miss], w, starts[rep], size[rep])]
            if other.size:  # another piece with the same hash
                which[other] = self._add([raw[starts[i] : ends[i]] for i in other.tolist()])
        lens = self.off[which + 1] - self.off[which]
        end = np.cumsum(lens)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.off[which] - (end - lens), lens) + np.arange(total)]
        upto = np.concatenate(([0], end))[first]
        counts = np.diff(upto)
        if exotic.any():
            out, raw = [], buf.tobytes()
            for i, odd in enumerate(exotic):
                x = np.array(self.text(raw[at[i] : at[i + 1]].decode()), np.uint16) if odd else ids[upto[i] : upto[i + 1]]
                counts[i] = len(x)
                out.append(x)
            ids = np.concatenate(out)
        return ids, counts
