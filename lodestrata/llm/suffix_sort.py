"""External induced sorting of the suffixes of many short texts, with common-prefix values.

Suffixes are of type S where they sort before their right neighbour and of type L where they sort after it; S* suffixes are
S with an L to their left.  The sorted S* suffixes induce the L suffixes, which induce the S suffixes.  Over bytes, induction
runs bucket by bucket: a queue per first byte receives tuples (position, common prefix with the tuple before) in their final
order, and goes to disk in chunks when the queues outgrow their memory.  The order of the S* suffixes comes from the string of
their names, one recursion level down, where names are many and a priority queue with disk-backed runs takes the place of the
buckets; a string of names that fits in memory ends the recursion.  A tuple's common prefix is one more than the smallest value between the tuples that induced it and its predecessor.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Common-prefix values are exact up to here, which is all that a threshold below it needs.
CAP = 64
#: Tuples that queues hold in memory; the rest waits on disk.
QUEUE_TUPLES = 4_000_000
#: Strings of names up to this length end the recursion: they are sorted in memory.
MEMORY_NAMES = 4_000_000
#: Symbols (0 to 256, and one that stands after an end) that a 63-bit key holds.
_PER_KEY, _AFTER = 7, 511


class Scratch:
    """A task's own files, gone when the task ends; like Spark's spill files they are read by the task that wrote them only."""

    def __init__(self):
        self.path: str | None = None
        self.n = 0

    def save(self, array: np.ndarray) -> str:
        if self.path is None:
            self.path = tempfile.mkdtemp(prefix="suffix-")
        self.n += 1
        name = os.path.join(self.path, f"{self.n}.npy")
        np.save(name, array)
        return name

    def close(self) -> None:
        if self.path is not None:
            shutil.rmtree(self.path, ignore_errors=True)
            self.path = None


class SpillQueue:
    """A priority queue of integer tuples; beyond `limit` tuples its content becomes a sorted run on disk."""

    def __init__(self, scratch: Scratch, limit: int = QUEUE_TUPLES):
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (head, number, rest)
        self.scratch, self.limit, self.n_runs = scratch, limit, 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            name = self.scratch.save(np.array(sorted(self.heap), np.int64))
            self.heap = []
            self.n_runs += 1
            self._next(self._read(name), self.n_runs)

    def _read(self, name: str) -> Iterator[tuple]:
        run = np.load(name, mmap_mode="r")
        for at in range(0, len(run), 10_000):
            yield from map(tuple, run[at : at + 10_000].tolist())
        os.remove(name)

    def _next(self, rest: Iterator[tuple], number: int) -> None:
        head = next(rest, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, rest))

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, number, rest = heapq.heappop(self.runs)
            self._next(rest, number)
            return head
        return heapq.heappop(self.heap)

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last is S, as if a smallest symbol preceded nothing."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        change = np.flatnonzero(t[1:] != t[:-1])  # t[i] != t[i + 1]
        at = np.searchsorted(change, np.arange(n - 1))
        after = np.where(at < len(change), change[np.minimum(at, max(0, len(change) - 1))] if len(change) else 0, n - 1)
        out[:-1] = np.where(at < len(change), t[np.minimum(after + 1, n - 1)] > t[: n - 1], True)
    return out


def _refine(rank: np.ndarray, which: np.ndarray, key: np.ndarray) -> None:
    """Split groups of equal rank by a key.  A rank is the number of smaller items; `which` holds whole groups."""
    order = np.lexsort((key, rank[which]))
    at, k = which[order], key[order]
    r = rank[at]
    new_group = np.concatenate([[True], r[1:] != r[:-1]])
    new_key = new_group | np.concatenate([[True], k[1:] != k[:-1]])
    here = np.arange(len(at))
    group_start = np.maximum.accumulate(np.where(new_group, here, 0))
    key_start = np.maximum.accumulate(np.where(new_key, here, 0))
    rank[at] = r + key_start - group_start


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def order_in_memory(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names by doubling the length that ranks stand for, in tied groups only."""
    n = len(names)
    rank = np.zeros(n, np.int64)
    _refine(rank, np.arange(n), names)
    step = 1
    while len(which := _tied(rank)):
        after = which + step
        _refine(rank, which, np.where(after < n, rank[np.minimum(after, n - 1)], -1))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def order_of_names(names: np.ndarray, scratch: Scratch, limit: int = QUEUE_TUPLES, memory: int = MEMORY_NAMES) -> np.ndarray:
    """Suffix order of a string of names whose last name is unique and smallest where suffixes could otherwise tie."""
    n = len(names)
    if n <= memory:
        return order_in_memory(names) if n else np.zeros(0, np.int64)
    if n <= 1 or len(np.unique(names)) == n:
        return np.argsort(names, kind="stable")
    small = _types(names)
    star = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    r = names.tolist()
    kind = small.tolist()
    if len(star):
        ends = np.append(star[1:], n - 1).tolist()
        pieces = [tuple(r[a : b + 1]) for a, b in zip(star.tolist(), ends, strict=True)]
        # the last piece runs to the end of the string, where no suffix equals it
        rank = {piece: i for i, piece in enumerate(sorted(set(pieces)))}
        sorted_star = star[order_of_names(np.array([rank[p] for p in pieces], np.int64), scratch, limit, memory)].tolist()
    else:
        sorted_star = []
    # L from S* (and from the end of the string), smallest first; within a name L come before S
    queue = SpillQueue(scratch, limit)
    for i, p in enumerate(sorted_star):
        queue.push((r[p], 1, i, p))
    queue.push((r[n - 1], 1 if kind[n - 1] else 0, -1, n - 1))
    large, count, seen_last = [], 0, False
    while len(queue):
        _, flag, _, p = queue.pop()
        if p == n - 1:
            if seen_last:
                continue
            seen_last = True
        if flag == 0:
            large.append(p)
        if p and not kind[p - 1]:
            count += 1
            queue.push((r[p - 1], 0, count, p - 1))
    # S from L, largest first
    queue = SpillQueue(scratch, limit)
    for i, p in enumerate(reversed(large)):
        queue.push((-r[p], 1, i, p))
    if kind[n - 1]:
        queue.push((-r[n - 1], 0, -1, n - 1))
    out, count = [], 0
    while len(queue):
        _, _, _, p = queue.pop()
        out.append(p)
        if p and kind[p - 1]:
            count += 1
            queue.push((-r[p - 1], 0, count, p - 1))
    return np.array(out[::-1], np.int64)


class _RangeMin:
    """Minimum of value[low..high] for many ranges."""

    def __init__(self, value: np.ndarray):
        self.levels = [value]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for level in range(int(k.max()) + 1 if len(k) else 0):
            if level >= len(self.levels):
                last, step = self.levels[-1], 1 << (level - 1)
                self.levels.append(np.minimum(last[: len(last) - step], last[step:]))
            mine = np.flatnonzero(k == level)
            table = self.levels[level]
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << level) + 1])
        return out


class _Buckets:
    """A first-in first-out queue per first symbol of (position, common prefix) arrays, partly on disk."""

    def __init__(self, n: int, scratch: Scratch, limit: int):
        self.parts: list[list] = [[] for _ in range(n)]
        self.scratch, self.limit, self.held = scratch, limit, 0

    def append(self, c: int, position: np.ndarray, lcp: np.ndarray) -> None:
        self.held += len(position)
        both = np.stack([position, lcp.astype(np.int64)])
        if self.held > self.limit:
            self.held -= len(position)
            self.parts[c].append(self.scratch.save(both))
        else:
            self.parts[c].append(both)

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest array of a bucket."""
        if not self.parts[c]:
            return None
        both = self.parts[c].pop(0)
        if isinstance(both, str):
            name, both = both, np.load(both)
            os.remove(name)
        else:
            self.held -= both.shape[1]
        return both[0], both[1].astype(np.uint8)


class InducedSorter:
    """Suffixes of texts; each text is followed by a separator that is smaller than any byte and equal to no other."""

    def __init__(self, texts: list[bytes], limit: int = QUEUE_TUPLES, memory: int = MEMORY_NAMES):
        joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        t = joined.astype(np.int16) + 1
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1 if texts else np.zeros(0, np.int64)
        t[ends] = 0
        self.t, self.limit, self.memory = t, limit, memory
        # a separator sorts before the byte after it, so it is S; the byte before it is L
        self.small = _types(t)
        self.star = np.flatnonzero(self.small & np.concatenate([[len(t) > 0 and t[0] == 0], ~self.small[:-1]])) if len(t) else np.zeros(0, np.int64)
        if len(t):  # separators in a row (empty texts) are all S*
            self.star = np.union1d(self.star, ends)

    def _common(self, a: np.ndarray, b: np.ndarray, cap: int = CAP) -> np.ndarray:
        """Common prefixes of pairs of suffixes by comparing bytes, up to `cap`; separators differ from each other."""
        out = np.zeros(len(a), np.uint8)
        live = np.arange(len(a))
        n = len(self.t)
        for k in range(cap):
            x, y = a[live] + k, b[live] + k
            inside = (x < n) & (y < n)
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            live = live[inside & (self.t[x] == self.t[y]) & (self.t[x] != 0)]
            if not len(live):
                break
            out[live] += 1
        return out

    def _sorted_star(self, scratch: Scratch) -> np.ndarray:
        """S* suffixes in order: their substrings up to the next S* are sorted and named, the string of names is sorted in turn."""
        star, t = self.star, self.t
        if not len(star):
            return star
        end = np.where(t[star] == 0, star, np.append(star[1:], len(t) - 1))  # a separator is told apart by its place alone
        # the shorter of two substrings that agree so far ends in an S where the longer goes on with an L: it sorts after
        rank = np.zeros(len(star), np.int64)
        which, offset = np.arange(len(star)), 0
        while len(which):
            key = np.zeros(len(which), np.uint64)
            for k in range(_PER_KEY):
                at = star[which] + offset + k
                key = (key << np.uint64(9)) | np.where(at <= end[which], t[np.minimum(at, len(t) - 1)], _AFTER).astype(np.uint64)
            _refine(rank, which, key)
            offset += _PER_KEY
            longer = np.flatnonzero(end - star >= offset)
            which = np.flatnonzero(np.isin(rank, rank[longer])) if len(longer) else longer
            which = which[np.bincount(rank, minlength=len(rank))[rank[which]] > 1]
        # separators differ by place, and so do substrings that end in one
        closing = np.flatnonzero(t[end] == 0)
        ties = np.flatnonzero(np.isin(rank, rank[closing]))
        _refine(rank, ties, star[ties])
        if not len(_tied(rank)):
            out = np.empty(len(star), np.int64)
            out[rank] = star
            return out
        return star[order_of_names(rank, scratch, self.limit, self.memory)]

    def _induce(self, seeds: np.ndarray, seed_lcp: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes from the largest to the smallest where seeds are sorted, each with its common prefix with the one before."""
        t, small = self.t, self.small
        symbols = 257
        large = _Buckets(symbols, scratch, self.limit)
        kept = _Buckets(symbols, scratch, self.limit)
        first_seed = np.searchsorted(t[seeds], np.arange(symbols + 1))
        since = np.zeros(symbols, np.uint8)
        used = np.zeros(symbols, bool)

        def push(queue: _Buckets, position: np.ndarray, lcp: np.ndarray, wanted) -> None:
            nonlocal since
            before = position - 1
            ok = np.flatnonzero((position > 0) & wanted(position, before))
            if len(ok):
                symbol = t[before[ok]]
                order = np.argsort(symbol, kind="stable")
                ok, symbol = ok[order], symbol[order]
                head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
                tail = np.append(head[1:], len(ok)) - 1
                low = np.concatenate([[0], ok[:-1] + 1])
                low[head] = 0
                value = _RangeMin(lcp)(low, ok)
                value[head] = np.minimum(value[head], since[symbol[head]])
                value = np.minimum(value, CAP - 1) + np.uint8(1)
                value[head[~used[symbol[head]]]] = 0
                for a, b in zip(head.tolist(), tail.tolist(), strict=True):
                    queue.append(int(symbol[a]), before[ok[a : b + 1]], value[a : b + 1])
            if len(lcp):
                since = np.minimum(since, lcp.min())
                if len(ok):
                    rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
                    since[symbol[tail]] = rest[ok[tail] + 1]
            if len(ok):
                used[symbol[head]] = True

        for c in range(symbols):
            last = None
            while (got := large.take(c)) is not None:
                position, lcp = got
                kept.append(c, position, lcp)
                last = position[-1:]
                push(large, position, lcp, lambda p, q: t[q] >= t[p])
            position = seeds[first_seed[c] : first_seed[c + 1]]
            if len(position):
                lcp = seed_lcp[first_seed[c] : first_seed[c + 1]].copy()
                lcp[0] = self._common(last, position[:1])[0] if last is not None else 0
                push(large, position, lcp, lambda p, q: t[q] > t[p])
        since = np.zeros(symbols, np.uint8)
        used = np.zeros(symbols, bool)
        little = _Buckets(symbols, scratch, self.limit)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        induced_from = lambda p, q: small[q] & ((t[q] < t[p]) | ((t[q] == t[p]) & small[p]))
        if len(t):  # the last suffix, a separator, has nothing after it that could induce it
            little.append(0, np.array([len(t) - 1]), np.zeros(1, np.uint8))
        for c in range(symbols - 1, -1, -1):
            last = None
            while (got := little.take(c)) is not None:
                position, lcp = got
                out.append((position, lcp))
                last = position[-1:]
                push(little, position, lcp, induced_from)
            parts = []
            while (got := kept.take(c)) is not None:
                parts.append(got)
            if parts:
                position = np.concatenate([p[0] for p in parts])[::-1]
                up = np.concatenate([p[1] for p in parts])
                lcp = np.append(up[1:], np.uint8(0))[::-1].copy()  # with the next larger one
                lcp[0] = self._common(last, position[:1])[0] if last is not None else 0
                out.append((position, lcp))
                push(little, position, lcp, induced_from)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all suffixes, the largest first, and each one's common prefix (up to CAP) with the one before."""
        scratch = Scratch()
        try:
            seeds = self._sorted_star(scratch)
            lcp = np.zeros(len(seeds), np.uint8)
            if len(seeds) > 1:
                lcp[1:] = self._common(seeds[:-1], seeds[1:])
            return self._induce(seeds, lcp, scratch)
        finally:
            scratch.close()
