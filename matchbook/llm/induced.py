"""External induced sorting of the suffixes of a shard, with common-prefix values.

Suffixes that begin with a fall (L) or a rise (S) are told apart; only those at the
foot of a rise (LMS) are sorted by recursion on the string of their names. All others
are induced: taken in order, a suffix passes its place on to the one that begins a
symbol earlier. A priority queue on disk holds what has been passed on, as tuples
(symbol, order of arrival, position, common prefix); it hands them out in blocks, as
large as no tuple still to come can fall into. The common prefix of two neighbours in
a bucket is one more than the least common prefix between the suffixes that induced
them, so it is carried along and never compared, up to ``cap`` symbols.

Memory holds the text and the sorted heads of the queue; the tuples, many times the
text, go to unnamed files of the task beyond ``budget`` bytes.
"""

from __future__ import annotations

import tempfile

import numpy as np

from matchbook.llm.texts import Rolling

_SEQ = 34  # bits of a key below the kind: the order of arrival


class Spill:
    """Arrays that stay in memory up to a budget and go to an unnamed file beyond it."""

    def __init__(self, budget: int):
        self._left, self._file, self._end = budget, None, 0
        self.spilled = 0

    def hold(self, array: np.ndarray) -> np.ndarray:
        if not array.nbytes or array.nbytes <= self._left:
            self._left -= array.nbytes
            return array
        if self._file is None:
            # Like a spill of Spark's own: unnamed, so it is gone with the task however it ends.
            self._file = tempfile.TemporaryFile()
        at = self._end
        self._file.seek(at)
        self._file.write(np.ascontiguousarray(array).data)
        self._file.flush()
        self._end = at + -(-array.nbytes // 4096) * 4096
        self.spilled += array.nbytes
        return np.memmap(self._file, array.dtype, "r", at, array.shape)

    def release(self, array: np.ndarray) -> None:
        if not isinstance(array, np.memmap):
            self._left += array.nbytes


class DiskQueue:
    """A priority queue of tuples ``(key, position, common prefix)`` as sorted runs.

    Runs of like size are merged, so there are never many of them.
    """

    def __init__(self, spill: Spill):
        self._spill = spill
        self._runs: list[tuple[np.ndarray, ...]] = []
        self._at: list[int] = []

    def push(self, *run: np.ndarray) -> None:
        """Add tuples in the order of their keys."""
        if not len(run[0]):
            return
        while self._runs and len(self._runs[-1][0]) - self._at[-1] <= 2 * len(run[0]):
            top, at = self._runs.pop(), self._at.pop()
            run = _merged([tuple(a[at:] for a in top), run])
            for a in top:
                self._spill.release(a)
        self._runs.append(tuple(self._spill.hold(a) for a in run))
        self._at.append(0)

    def peek(self, n: int) -> tuple[np.ndarray, ...] | None:
        """The smallest tuples, ``n`` of them or somewhat more."""
        live = [i for i, run in enumerate(self._runs) if self._at[i] < len(run[0])]
        if len(live) < len(self._runs):
            for i, run in enumerate(self._runs):
                if i not in live:
                    for a in run:
                        self._spill.release(a)
            self._runs, self._at = [self._runs[i] for i in live], [self._at[i] for i in live]
        if not self._runs:
            return None
        pairs = list(zip(self._runs, self._at))
        far = [run[0][at + n - 1] for run, at in pairs if len(run[0]) - at >= n]
        bound = min(far) if far else None
        heads = []
        for run, at in pairs:
            end = len(run[0])
            if bound is not None:
                end = at + int(np.searchsorted(run[0][at : at + n], bound, "right"))
            heads.append(tuple(np.asarray(a[at:end]) for a in run))
        return _merged([h for h in heads if len(h[0])])

    def drop(self, key: np.uint64) -> None:
        """Forget the tuples up to a key."""
        for i, run in enumerate(self._runs):
            self._at[i] += int(np.searchsorted(run[0][self._at[i] :], key, "right"))


def _merged(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if len(runs) == 1:
        return runs[0]
    columns = [np.concatenate(c) for c in zip(*runs)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


class _RangeMin:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self._levels = [values]
        span = 1
        while 2 * span <= len(values):
            last = self._levels[-1]
            self._levels.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        size = last - first + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(first), self._levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self._levels[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        return out


def suffix_types(symbols: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end is smaller than any symbol."""
    n = len(symbols)
    edge = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = np.concatenate(([0], edge))
    rises = np.zeros(len(starts), bool)
    rises[:-1] = symbols[starts[1:]] > symbols[starts[:-1]]
    return np.repeat(rises, np.diff(np.append(starts, n)))


class _Pass:
    """One scan that induces: falls in ascending order, or rises in descending order."""

    def __init__(self, symbols: np.ndarray, rising: np.ndarray, up: bool, top: int, cap: int, spill: Spill):
        self._symbols, self._rising, self._up, self._top = symbols, rising, up, top
        self._cap, self._spill, self._seq = cap, spill, 0
        self.queue = DiskQueue(spill)
        #: Least common prefix passed since the last push to a bucket; -1 before the first.
        self._since = np.full(top + 1, -1, np.int16) if cap else None
        self.positions: list[np.ndarray] = []
        self.prefixes: list[np.ndarray] = []

    def _rank(self, positions: np.ndarray) -> np.ndarray:
        found = self._symbols[positions].astype(np.int64)
        return found if self._up else self._top - found

    def keys(self, positions: np.ndarray, kind: int, seq: np.ndarray) -> np.ndarray:
        rank = self._rank(positions).astype(np.uint64)
        return (rank << np.uint64(_SEQ + 1)) | np.uint64(kind << _SEQ) | seq.astype(np.uint64)

    def seed(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Suffixes that only induce; they come after the induced ones of their symbol."""
        self.queue.push(self.keys(positions, 1, np.arange(len(positions))), positions, prefixes)

    def induce(self, sources: np.ndarray, prefixes: np.ndarray, targets: np.ndarray) -> None:
        """Pass places on from the sources numbered ``targets``."""
        before = sources[targets] - 1
        rank = self._rank(before)
        order = np.argsort(rank, kind="stable")
        at, rank = targets[order], rank[order]
        if self._cap:
            least = _RangeMin(prefixes)
            first = np.ones(len(at), bool)
            first[1:] = rank[1:] != rank[:-1]
            start = np.zeros(len(at), np.int64)
            start[1:] = at[:-1] + 1
            start[first] = 0
            found = least(start, at)
            found[first] = np.minimum(found[first], self._since[rank[first]])
            found = np.minimum(found + 1, self._cap).astype(np.int16)
            self._since = np.minimum(self._since, prefixes.min())
            last = np.append(first[1:], True)
            rest = np.full(last.sum(), self._cap, np.int16)
            open_ = at[last] + 1 < len(prefixes)
            rest[open_] = least(at[last][open_] + 1, np.full(open_.sum(), len(prefixes) - 1))
            self._since[rank[last]] = rest
        else:
            found = np.zeros(len(at), np.int16)
        seq = self._seq + np.arange(len(before))
        self._seq += len(before)
        before = before[order]
        self.queue.push(self.keys(before, 0, seq[order]), before, found)

    def run(self, block: int = 1 << 15) -> None:
        shift, n = np.uint64(_SEQ + 1), block
        while (head := self.queue.peek(n)) is not None:
            keys, positions, prefixes = head
            before = positions - 1
            inner = before >= 0
            wanted = inner & (self._rising[before] != self._up)
            targets = np.flatnonzero(wanted)
            k = len(keys)
            if len(targets):
                # No tuple to come is smaller than the least that is passed on now.
                least = np.uint64(self._rank(before[targets]).min())
                bound = (least << shift) | np.uint64(1 << _SEQ)
                k = int(np.searchsorted(keys, bound, "left"))
                targets = targets[: int(np.searchsorted(targets, k))]
            n = max(1 << 10, min(1 << 18, 2 * k))
            self.queue.drop(keys[k - 1])
            keys, positions, prefixes = keys[:k], positions[:k], prefixes[:k].copy()
            kind = (keys >> np.uint64(_SEQ)) & np.uint64(1)
            if self._cap:
                self._borders(keys >> shift, kind, positions, prefixes)
            if len(targets):
                self.induce(positions, prefixes, targets)
            elif self._cap:
                self._since = np.minimum(self._since, prefixes.min())
            own = kind == 0
            if own.any():
                self.positions.append(self._spill.hold(positions[own]))
                self.prefixes.append(self._spill.hold(prefixes[own]))

    _last: tuple[int, int, int] = (-1, -1, -1)

    def _borders(self, rank, kind, positions, prefixes) -> None:
        """Common prefixes where the symbol, or the kind within a symbol, changes."""
        rank, kind = rank.astype(np.int64), kind.astype(np.int64)
        earlier = np.concatenate(([self._last[0]], rank[:-1]))
        earlier_kind = np.concatenate(([self._last[1]], kind[:-1]))
        prefixes[rank != earlier] = 0
        for i in np.flatnonzero((rank == earlier) & (kind != earlier_kind)).tolist():
            other = positions[i - 1] if i else self._last[2]
            prefixes[i] = min(self._cap, self._run(int(other)), self._run(int(positions[i])))
        self._last = int(rank[-1]), int(kind[-1]), int(positions[-1])

    def _run(self, at: int) -> int:
        """Length of the run of one symbol from here, up to the cap."""
        part = self._symbols[at : at + self._cap]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)


def _both_passes(
    symbols: np.ndarray, rising: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray, top: int, cap: int, spill: Spill
) -> tuple[_Pass, _Pass]:
    """All falls, then all rises, induced from LMS suffixes in the order given."""
    falls = _Pass(symbols, rising, True, top, cap, spill)
    falls.seed(seeds, prefixes)
    # The end of the text, smaller than all, induces the last suffix.
    falls.induce(np.array([len(symbols)]), np.zeros(1, np.int16), np.array([0]))
    falls.run()
    rises = _Pass(symbols, rising, False, top, cap, spill)
    if falls.positions:
        downward = np.concatenate(falls.positions)[::-1]
        values = np.concatenate(falls.prefixes)
        rises.seed(downward, np.append(values, np.int16(0))[1:][::-1])
        rises.run()
    return falls, rises


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` symbols at least."""
    n = len(names)
    rank = names.astype(np.int64)
    reach = 1
    open_ = np.arange(n)
    while reach < depth and len(open_):
        later = np.zeros(len(open_), np.int64)
        inside = open_ + reach < n
        later[inside] = rank[open_[inside] + reach] + 1
        order = np.lexsort((later, rank[open_]))
        open_, later = open_[order], later[order]
        base = rank[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (base[1:] != base[:-1]) | (later[1:] != later[:-1])
        group = np.flatnonzero(new)
        head = np.ones(len(open_), bool)
        head[1:] = base[1:] != base[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))
        number = np.repeat(group, np.diff(np.append(group, len(open_))))
        fresh = base + (number - start)
        rank = rank.copy()
        rank[open_] = fresh
        alone = np.repeat(np.diff(np.append(group, len(open_))) == 1, np.diff(np.append(group, len(open_))))
        open_ = np.sort(open_[~alone])
        reach *= 2
    return np.argsort(rank, kind="stable")


def sorted_lms(
    symbols: np.ndarray, rising: np.ndarray, top: int, depth: int, in_memory: int, budget: int
) -> np.ndarray:
    """LMS suffixes in order of their first ``depth`` symbols at least."""
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(lms) < 2:
        return lms
    # Any order within a symbol sorts the LMS substrings.
    spill = Spill(budget)
    first = lms[np.argsort(symbols[lms], kind="stable")]
    _, rises = _both_passes(symbols, rising, first, np.zeros(len(first), np.int16), top, 0, spill)
    is_lms = np.zeros(len(symbols), bool)
    is_lms[lms] = True
    upward = np.concatenate([p[is_lms[p]] for p in rises.positions])[::-1]
    del rises
    # Equal substrings, to the next LMS symbol, get one name.
    number = np.searchsorted(lms, upward)
    ends = np.append(lms[1:] + 1, len(symbols))[number]
    rolling = Rolling()
    marks = rolling.spans(rolling.prefix(symbols.astype(np.uint64) * np.uint64(2) + np.uint64(1)), upward, ends)
    new = np.ones(len(upward), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (np.diff(ends - upward) != 0)
    unique = np.flatnonzero(ends == len(symbols))  # it has no such symbol at its end
    new[unique] = new[np.minimum(unique + 1, len(new) - 1)] = True
    names = np.empty(len(lms), np.int64)
    names[number] = np.cumsum(new) - 1
    if new.all():
        return upward
    # Two LMS positions are two symbols apart at least.
    if len(names) <= in_memory:
        return lms[_doubling(_ranked(names), depth // 2 + 2)]
    below = suffix_types(names)
    order = sorted_lms(names, below, int(names.max()), depth // 2 + 2, in_memory, budget)
    spill = Spill(budget)
    falls, rises = _both_passes(names, below, order, np.zeros(len(order), np.int16), int(names.max()), 0, spill)
    return lms[_in_order(names, falls, rises)]


def _ranked(names: np.ndarray) -> np.ndarray:
    """Names as the number of smaller ones, as doubling refines them in place."""
    counts = np.bincount(names)
    return (np.cumsum(counts) - counts)[names]


def _in_order(symbols: np.ndarray, falls: _Pass, rises: _Pass) -> np.ndarray:
    """All positions: of each symbol the falls, then the rises."""
    parts = [np.zeros(0, np.int64)]
    down = np.concatenate([*parts, *falls.positions])
    up = np.concatenate([*parts, *rises.positions])[::-1]
    both = np.concatenate([down, up])
    kind = np.concatenate([np.zeros(len(down), np.int64), np.ones(len(up), np.int64)])
    return both[np.argsort(2 * symbols[both].astype(np.int64) + kind, kind="stable")]


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``cap``."""
    out = np.zeros(len(order), np.int16)
    if len(order) < 2:
        return out
    padded = np.zeros(len(text) + cap + 16, np.uint8)
    padded[: len(text)] = text
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    for low in range(1, len(order), 1 << 18):
        a, b = order[low - 1 : low + (1 << 18) - 1], order[low : low + (1 << 18)]
        a = a[: len(b)]
        found = np.zeros(len(b), np.int64)
        open_ = np.arange(len(b))
        reach = 0
        while len(open_) and reach < cap:
            differ = words[a[open_] + reach] ^ words[b[open_] + reach]
            same = differ == 0
            ended = open_[~same]
            lowest = differ[~same] & (~differ[~same] + np.uint64(1))
            found[ended] = reach + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8
            open_ = open_[same]
            reach += 8
        found[open_] = cap
        out[low : low + len(b)] = np.minimum(found, cap)
    return out


def repeated_positions(
    text: np.ndarray, cap: int, in_memory: int = 1 << 21, budget: int = 64 << 20
) -> np.ndarray:
    """Positions whose first ``cap`` symbols also start elsewhere in the text.

    ``text`` holds symbols below 256. Strings that run past a separator count like any.
    """
    if len(text) <= cap:
        return np.zeros(0, np.int64)
    rising = suffix_types(text)
    order = sorted_lms(text, rising, 255, cap, in_memory, budget)
    prefixes = common_prefixes(text, order, cap)
    falls, rises = _both_passes(text, rising, order, prefixes, 255, cap, Spill(budget))
    found = [np.zeros(0, np.int64)]
    for part in (falls, rises):
        if part.positions:
            positions, shared = np.concatenate(part.positions), np.concatenate(part.prefixes)
            full = shared >= cap
            found.append(positions[full | np.append(full[1:], False)])
    # Of each symbol, the last fall and the first rise have its longest runs.
    if falls.positions and rises.positions:
        down, up = np.concatenate(falls.positions), np.concatenate(rises.positions)
        last = {int(text[p]): int(p) for p in down[_last_of_runs(text[down])]}
        first = {int(text[p]): int(p) for p in up[_last_of_runs(text[up])]}
        for symbol in last.keys() & first.keys():
            pair = [last[symbol], first[symbol]]
            if all((text[p : p + cap] == symbol).all() and p + cap <= len(text) for p in pair):
                found.append(np.array(pair))
    out = np.unique(np.concatenate(found))
    return out[out + cap <= len(text)]


def _last_of_runs(values: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1)
