"""Re-Pair grammars of id sequences, in numpy."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPG1"
#: The least count of a pair that gets a rule, and symbols in all (two bytes each).
LEAST, LIMIT = 24, 1 << 16
#: Hash bits for counting pairs.
BITS = 18


@dataclass
class Grammar:
    """Terminals are below ``base``; nonterminal base + i expands to left[i] right[i], of length[i] ids in all."""

    base: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    symbols: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(self.base, np.int64), self.length.astype(np.int64)])[symbols]

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all nonterminals one after another, and where each starts."""
        start = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        flat = np.empty(start[-1], np.uint32)
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            at = start[i]
            for x in (a, b):
                if x < self.base:
                    flat[at] = x
                    at += 1
                else:
                    n = self.length[x - self.base]
                    flat[at : at + n] = flat[start[x - self.base] : start[x - self.base] + n]
                    at += n
        return flat, start

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_cached"):
            flat, start = self._expansions()
            self._cached = np.concatenate([np.arange(self.base, dtype=np.uint32), flat]), np.concatenate([np.arange(self.base), start[:-1] + self.base])
        flat, start = self._cached
        n = self.lengths(symbols)
        ends = np.cumsum(n)
        kind = np.int32 if len(ends) and ends[-1] + len(flat) < 1 << 31 else np.int64
        place = np.repeat((start[symbols] - (ends - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        return flat[place]

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the sequence, expanding only the symbols that cover them."""
        if not hasattr(self, "_ends"):
            self._ends = np.cumsum(self.lengths(self.symbols))
        a, b = np.searchsorted(self._ends, lo, "right"), np.searchsorted(self._ends, hi, "left") + 1
        before = int(self._ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[lo - before : hi - before]


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def apart(s: np.ndarray) -> np.ndarray:
    """Of each pair whether it counts: in a run of one id every other pair does, so that none overlaps another of its kind."""
    out = np.ones(len(s) - 1, bool)
    twin = np.flatnonzero(s[1:] == s[:-1])
    if len(twin):
        start = np.concatenate([[0], np.flatnonzero(np.diff(twin) > 1) + 1])
        out[twin[(np.arange(len(twin)) - np.repeat(start, np.diff(np.append(start, len(twin))))) % 2 == 1]] = False
    return out


def build(ids: np.ndarray, base: int, limit: int = LIMIT, least: int = LEAST) -> Grammar:
    """Gives frequent pairs nonterminals, many a round, until no pair occurs ``least`` times or ``limit`` symbols exist.

    A hash's count bounds those of its pairs, so pairs of rare hashes are left out; the others are counted
    exactly. Where chosen pairs overlap, the more frequent one is replaced, and the other has its turn later. After the
    first round only pairs with a symbol that was put in and those that were left over can be frequent.
    """
    s = np.ascontiguousarray(ids, np.uint32)
    left, right, length = [], [], []
    next_id = base
    sizes = np.ones(base, np.int64)
    fresh = first = None  # symbols that the last round put in, and those too that begin a pair it left over
    known, numbers = np.empty(0, np.uint64), np.empty(0, np.int64)  # pairs with a rule, sorted, and their nonterminals
    while len(s) > 1:
        a, b = s[:-1], s[1:]
        counted = apart(s)
        if fresh is not None:
            counted &= first[a] | fresh[b]
        at = np.flatnonzero(counted)
        h = _hash(a[at], b[at])
        likely = np.bincount(h, minlength=1 << BITS)[h] >= least
        at, h = at[likely], h[likely]
        pair = (a[at].astype(np.uint64) << np.uint64(32)) | b[at]
        sorted_ = np.sort(pair)
        heads = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)
        count = np.diff(np.append(heads, len(sorted_)))
        frequent = np.flatnonzero(count >= least)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-count[frequent], kind="stable")]
        kinds, count = sorted_[heads[frequent]], count[frequent]
        l, m = (kinds >> np.uint64(32)).astype(np.uint32), kinds.astype(np.uint32)
        which = np.full(1 << BITS, -1, np.int32)
        which[_hash(l, m)[::-1]] = np.arange(len(kinds))[::-1]  # of pairs with one hash the most frequent
        r = which[h]
        fits = np.flatnonzero(r >= 0)
        fits = fits[kinds[r[fits]] == pair[fits]]
        at, r = at[fits], r[fits]
        rank = np.full(len(s) + 1, 1 << 30, np.int32)  # of pair i at i + 1
        rank[at + 1] = r
        keep = (r < rank[at]) & (r < rank[at + 2])
        at, r = at[keep], r[keep]
        often = np.bincount(r, minlength=len(kinds))
        place = np.minimum(np.searchsorted(known, kinds), max(0, len(known) - 1))
        number = np.where(known[place] == kinds, numbers[place], -1) if len(known) else np.full(len(kinds), -1, np.int64)
        used = np.flatnonzero((number < 0) & (often >= max(1, least // 2)))[: limit - next_id]  # the first has no rival
        number[used] = next_id + np.arange(len(used))
        fits = number[r] >= 0
        at, r = at[fits], r[fits]
        if not len(at):
            break
        sizes = np.concatenate([sizes, sizes[l[used]] + sizes[m[used]]])
        left.append(l[used]), right.append(m[used]), length.append(sizes[len(sizes) - len(used) :])
        known, numbers = np.concatenate([known, kinds[used]]), np.concatenate([numbers, number[used]])
        order = np.argsort(known)
        known, numbers = known[order], numbers[order]
        s = s.copy()
        s[at] = number[r].astype(np.uint32)
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s = s[stay]
        next_id += len(used)
        fresh = np.zeros(max(limit, base) + 1, bool)
        fresh[number[np.unique(r)]] = True
        first = fresh.copy()
        first[l[np.bincount(r, minlength=len(kinds)) < count]] = True
    join = lambda x: np.concatenate(x).astype(np.uint32) if x else np.empty(0, np.uint32)
    return Grammar(base, join(left), join(right), join(length), s)


def dump(g: Grammar, starts: np.ndarray) -> bytes:
    """One shard: header, rules, expansion lengths, the documents' starts in ids, symbols of 2 or 4 bytes."""
    width = 2 if g.base + len(g.left) <= 1 << 16 else 4
    head = struct.pack("<4sBIIQQ", MAGIC, width, g.base, len(g.left), len(starts), len(g.symbols))
    narrow = lambda x: x.astype(f"<u{width}").tobytes()
    return b"".join([head, narrow(g.left), narrow(g.right), g.length.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), narrow(g.symbols)])


def load(data: bytes) -> tuple[Grammar, np.ndarray]:
    magic, width, base, rules, docs, symbols = struct.unpack_from("<4sBIIQQ", data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at, out = struct.calcsize("<4sBIIQQ"), []
    for kind, n in ((f"<u{width}", rules), (f"<u{width}", rules), ("<u4", rules), ("<u8", docs), (f"<u{width}", symbols)):
        x = np.frombuffer(data, kind, n, at)
        at += x.nbytes
        out.append(x)
    return Grammar(base, out[0], out[1], out[2], out[4]), out[3].astype(np.int64)
