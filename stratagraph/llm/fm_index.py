"""An FM-index over integer symbols: wavelet-matrix ranks, backward search, sampled suffix positions, matching statistics.

All searches take whole arrays of patterns and go forward in step, so a shard costs numpy calls, not Python loops.
"""

from __future__ import annotations

import numpy as np

from .tokens import U, mixed, window_hash

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, by prefix doubling that sorts again only what is still tied."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length() if n else 1)
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        if j < n:
            key[: n - j] |= s[j:]
    sa = np.argsort(key)
    ordered = key[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    # a suffix cut off by the end differs from one that goes on with zeros: the end sorts first
    rank = np.empty(n, np.int64)
    rows = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(fresh, rows, 0))
    depth_now = depth
    while True:
        last = np.append(fresh[1:], True)
        tied = np.flatnonzero(~(fresh & last))
        if not len(tied):
            return sa
        pos = sa[tied]
        ahead = pos + depth_now
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[pos] * (n + 1) + nxt
        order = np.argsort(both)
        pos, both = pos[order], both[order]
        sa[tied] = pos
        fresh[tied[1:]] |= both[1:] != both[:-1]
        rank[pos] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        depth_now *= 2


class WaveletMatrix:
    """rank(symbol, i): how often a symbol stands before position i; one bit vector a level, packed, with counts every 64 bits."""

    def __init__(self, s: np.ndarray, bits: int):
        self.n, self.bits = len(s), bits
        self.words, self.counts, self.zeros = [], [], []
        s = s.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = (s >> np.uint32(level)) & np.uint32(1)
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.counts.append(ones)
            self.zeros.append(self.n - int(bit.sum()))
            one = bit.astype(bool)
            s = np.concatenate([s[~one], s[one]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & below)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, i)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - start

    def offsets(self, symbols: int) -> np.ndarray:
        """Where each symbol's run begins in the order of the last level: what rank() walks to besides its place."""
        symbol, start = np.arange(symbols), np.zeros(symbols, np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a = self._ones(level, start)
            start = np.where(one, self.zeros[level] + a, start - a)
        return start

    def run_place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """rank(symbol, i) + offsets()[symbol]."""
        i = i.astype(np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            b = self._ones(level, i)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before i."""
        symbol, start, i = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.astype(np.int64)
        for level in range(self.bits):
            one = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol * 2 + one
            a, b = self._ones(level, start), self._ones(level, i)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return symbol, i - start


class FMIndex:
    """Index of one shard. Symbols are 1 and up; 0 is set aside for the end."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        s = np.append(symbols.astype(np.int64), 0)
        self.n = len(s)
        self.bits = max(1, int(s.max()).bit_length())
        sa = suffix_array(s)
        self.suffixes: np.ndarray | None = sa  # whole only until the caller drops it
        last = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=(1 << self.bits)))])
        self.wave = WaveletMatrix(last, self.bits)
        marked = sa % sample == 0
        self.mark = marked
        self.mark_rank = np.cumsum(marked, dtype=np.int32)
        self.sampled = sa[marked].astype(np.int32)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern, by backward search. patterns: a row each, left-aligned; lengths: of each."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for step in range(int(lengths.max()) if m else 0):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            known = (c > 0) & (c < (1 << self.bits))
            hi[live[~known]] = lo[live[~known]] = 0
            live, c = live[known], c[known]
            both = self.wave.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.before[c] + both[: len(c)]
            hi[live] = self.before[c] + both[len(c) :]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: backward steps until a sampled row, then the sample and the steps."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        while True:
            walking = np.flatnonzero(~self.mark[at])
            if not len(walking):
                break
            c, r = self.wave.access_rank(at[walking])
            at[walking] = self.before[c] + r
            steps[walking] += 1
        return self.sampled[self.mark_rank[at] - 1].astype(np.int64) + steps


class _RangeLeast:
    """Least value of ranges [lo, hi) of an array: windows of up to 32, and blocks of 32 for what is longer."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        for j in range(5):
            v = self.levels[-1]
            self.levels.append(np.minimum(v, np.append(v[1 << j :], np.full(min(1 << j, len(v)), v.max(initial=0)))))
        self.blocks = [self.levels[5][::32]]
        while 1 << len(self.blocks) <= len(self.blocks[0]):
            v, step = self.blocks[-1], 1 << (len(self.blocks) - 1)
            self.blocks.append(np.minimum(v[:-step], v[step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        out = np.empty(len(lo), self.levels[0].dtype)
        j = np.minimum(np.frexp(np.maximum(n, 1))[1] - 1, 5)
        for level in range(6):
            m = j == level
            a, b = lo[m], hi[m] - (1 << level)
            out[m] = np.minimum(self.levels[level][a], self.levels[level][np.maximum(a, b)])
        wide = np.flatnonzero(n > 64)
        if len(wide):
            a, b = (lo[wide] + 31) // 32, hi[wide] // 32
            k = np.frexp(b - a)[1] - 1
            for level in np.unique(k).tolist():
                m = k == level
                v = self.blocks[level]
                out[wide[m]] = np.minimum(out[wide[m]], np.minimum(v[a[m]], v[b[m] - (1 << level)]))
        return out


class Matcher:
    """Matching statistics of streamed patterns against the texts of an index that belong to earlier owners.

    owner: a number for each text position. A match of a pattern counts only where a text position of a smaller owner has it; so the
    pattern itself may be in the index. Matches are followed up to `most` symbols.
    """

    def __init__(self, index: FMIndex, symbols: np.ndarray, owner: np.ndarray, most: int):
        self.index, self.most = index, most
        self.owners = _RangeLeast(np.append(owner, owner.max(initial=0)).astype(np.int32)[np.minimum(index.suffixes, len(owner))])
        self.run = index.wave.offsets(1 << index.bits)
        self.common = [self._common_prefixes(np.append(symbols, 0))]
        while 1 << len(self.common) <= len(self.common[0]):  # least values of 2**level neighbours
            v, step = self.common[-1], 1 << (len(self.common) - 1)
            self.common.append(np.minimum(v[:-step], v[step:]))

    def _common_prefixes(self, s: np.ndarray) -> np.ndarray:
        """How many symbols each suffix shares with the one before it in order, as far as `most`; 0 at both ends."""
        sa, n = self.index.suffixes, len(s)
        a, b = sa[:-1], sa[1:]
        shared = np.zeros(n - 1, np.int64)
        for j in range(self.most.bit_length() - 1, -1, -1):
            named = window_hash(mixed(s.astype(U)), 1 << j)
            if not len(named):
                continue
            x, y = a + shared, b + shared
            inside = (x < len(named)) & (y < len(named))
            same = inside & (named[np.minimum(x, len(named) - 1)] == named[np.minimum(y, len(named) - 1)])
            shared[same] += 1 << j
        return np.concatenate([[0], shared, [0]]).astype(np.uint16)

    def _widened(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of all suffixes that share `depth` symbols with those of [lo, hi)."""
        lo, hi = lo.copy(), hi.copy()
        for level in range(len(self.common) - 1, -1, -1):
            v, step = self.common[level], 1 << level
            at = lo - step + 1  # the values at lo - step + 1 .. lo stand between lo - step and lo
            go = (at > 0) & (v[np.maximum(at, 0)] >= depth)
            lo[go] -= step
            go = (hi + step < len(self.common[0])) & (v[np.minimum(hi, len(v) - 1)] >= depth)
            hi[go] += step
        return lo, hi

    def _before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.index.before[symbol] + self.index.wave.run_place(symbol, i) - self.run[symbol]

    def lengths(self, flat: np.ndarray, begin: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For every position of the patterns (flat symbols, begin of each and the end): how many symbols from there an earlier owner has, as far
        as `most`. Patterns go backward in step: a symbol extends the range of matching suffixes; where no earlier owner is left in
        it, the match loses symbols at its end, as many as the next wider range needs, until the extension holds."""
        size = np.diff(begin)
        lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), self.index.n, np.int64), np.zeros(len(size), np.int64)
        out = np.zeros(len(flat), np.uint16)
        live = np.arange(len(size))
        for step in range(int(size.max(initial=0))):
            live = live[size[live] > step]
            at = begin[live] + size[live] - 1 - step
            todo, symbol = live, flat[at]
            while len(todo):
                both = self._before(np.concatenate([symbol, symbol]), np.concatenate([lo[todo], hi[todo]]))
                a, b = both[: len(todo)], both[len(todo) :]
                good = a < b
                good[good] = self.owners.of(a[good], b[good]) < own[todo[good]]
                done = todo[good]
                lo[done], hi[done] = a[good], b[good]
                length[done] += 1
                full = done[length[done] > self.most]
                if len(full):
                    length[full] = self.most
                    lo[full], hi[full] = self._widened(lo[full], hi[full], length[full])
                todo, symbol = todo[~good], symbol[~good]
                some = length[todo] > 0  # without a symbol left, an earlier owner does not have this one at all
                todo, symbol = todo[some], symbol[some]
                length[todo] = np.maximum(self.common[0][lo[todo]], self.common[0][hi[todo]])
                lo[todo], hi[todo] = self._widened(lo[todo], hi[todo], length[todo])
            out[at] = length[live]
        return out
