"""Suffix sorting with common prefixes by induced sorting over disk-backed queues.

A suffix is of type L if it is larger than the one after it, else S; an S suffix after
an L one starts a star substring. Star substrings are sorted by induction, named, and
their names sorted by recursion, whose base case are BASE names; from the sorted star
suffixes, one pass in ascending order induces all L suffixes and one in descending order
all S suffixes.

Both passes run on a priority queue of tuples (key, position, common prefix), which
keeps ranges of keys apart and puts them on disk when its memory is used up. Tuples are
popped in bulk: as many as come before anything that they themselves induce. With
each tuple goes the length of the prefix that it shares with its neighbour in the
order, which for an induced suffix is one more than the least value between the two
suffixes that induce it and its neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Tuples that are popped at once, at most; tuples that a queue holds in memory; names that the recursion's base case sorts.
BULK, HELD, BASE = 1 << 17, 1 << 19, 1 << 18
UNKNOWN, FAR = -1, 1 << 30


class DiskQueue:
    """A priority queue of (key, position, common prefix); equal keys leave in the order in which they came.

    ``cuts`` are the first keys of its ranges. ``spill`` stores bytes outside memory and
    returns a function (offset, length) that reads a part of them back; each part is read
    once, and with length 0 the function removes what was stored. What a queue holds of
    ranges that aren't being popped yet goes there, as one piece sorted by range.
    """

    def __init__(self, cuts: np.ndarray, spill: Callable[[bytes], Callable[[int, int], bytes]] | None = None, held: int = HELD):
        self.cuts, self.spill, self.limit = cuts, spill, held
        self.parts: list[list] = [[] for _ in cuts]
        self.later: list = []
        self.now, self.held = 0, 0
        steps = np.diff(cuts[1:])
        #: Where ranges hold one key each, a key's range follows from it.
        self.shift = int(cuts[1]) - 1 if len(cuts) > 1 and (steps == 1).all() else None
        self.head = self._none()

    @staticmethod
    def _none():
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def push(self, key: np.ndarray, at: np.ndarray, shared: np.ndarray) -> None:
        if not len(key):
            return
        if self.now + 1 < len(self.parts):
            later = key >= self.cuts[self.now + 1]
            if later.all():
                self.later.append((key, at, shared))
            else:
                now = ~later
                self.parts[self.now].append((key[now], at[now], shared[now]))
                if later.any():
                    self.later.append((key[later], at[later], shared[later]))
        else:
            self.parts[self.now].append((key, at, shared))
        self.held += len(key)
        if self.spill and self.held > self.limit:
            self._deal()
            self._to_disk()

    def _deal(self) -> None:
        """Put what came for later ranges into these."""
        if not self.later:
            return
        key, at, shared = (np.concatenate(x) for x in zip(*self.later, strict=True))
        self.later = []
        if self.shift is None:
            part = (np.searchsorted(self.cuts, key, "right") - 1).astype(np.uint16)
        else:
            part = np.clip(key - self.shift, 0, len(self.parts) - 1).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        key, at, shared, part = key[order], at[order], shared[order], part[order]
        starts = np.flatnonzero(np.diff(part.astype(np.int32), prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            self.parts[part[a]].append((key[a:b], at[a:b], shared[a:b]))

    def _to_disk(self) -> None:
        data, open_ = [], []
        for k in range(self.now + 1, len(self.parts)):
            run = [x for x in self.parts[k] if not callable(x)]
            if run:
                data.append(b"".join(np.concatenate(x).tobytes() for x in zip(*run, strict=True)))
                open_.append(k)
        if not open_:
            return
        back, at, left = self.spill(b"".join(data)), 0, [len(open_)]
        for k, piece in zip(open_, data, strict=True):
            # Runs stand in the order in which they came.
            self.parts[k] = [x for x in self.parts[k] if callable(x)] + [lambda at=at, size=len(piece): self._from_disk(back, at, size, left)]
            at += len(piece)
            self.held -= len(piece) // 12

    @staticmethod
    def _from_disk(back, at: int, size: int, left: list[int]):
        data, n = back(at, size), size // 12
        left[0] -= 1
        if not left[0]:
            back(0, 0)
        return tuple(np.frombuffer(data, np.int32, n, k * n) for k in (0, 4, 8))

    def first(self, n: int):
        """The first n tuples, or fewer; None when nothing is left."""
        while True:
            fresh = self.parts[self.now]
            if fresh:
                self.parts[self.now] = []
                runs = []
                for x in fresh:
                    runs.append(x() if callable(x) else x)
                    self.held += len(runs[-1][0]) if callable(x) else 0
                key, at, shared = (np.concatenate(x) for x in zip(self.head, *runs, strict=True))
                if (key[1:] < key[:-1]).any():
                    order = np.argsort(key, kind="stable")
                    key, at, shared = key[order], at[order], shared[order]
                self.head = key, at, shared
            if len(self.head[0]):
                return tuple(x[:n] for x in self.head)
            if self.now + 1 == len(self.parts):
                return None
            self._deal()
            self.now += 1

    def drop(self, n: int) -> None:
        self.head = tuple(x[n:] for x in self.head)
        self.held -= n


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S. The last symbol is the smallest."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    return np.repeat(rising, np.diff(ends, prepend=-1))


class _Minima:
    """Least values of ranges of an array, by powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        step = 1
        while 2 * step <= longest:
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each range [a, b), which isn't empty."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.rows[k][a[i]], self.rows[k][b[i] - (1 << k)])
        return out


class _Since:
    """For each key the least common prefix since the last tuple that induced one with this key."""

    def __init__(self, base: int, n: int):
        self.base, self.least = base, np.full(n, UNKNOWN, np.int32)

    def __call__(self, shared: np.ndarray, where: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Common prefixes of tuples induced at places ``where`` of a batch with common prefixes ``shared``."""
        slot = key - self.base
        keep = slot >= 0  # other keys are of one suffix each
        out = np.full(len(key), UNKNOWN, np.int32)
        order = np.flatnonzero(keep)[np.argsort(slot[keep].astype(np.uint16), kind="stable")]
        own, place = slot[order], where[order]
        first = np.diff(own, prepend=-1) != 0
        running = np.minimum.accumulate(shared)
        before = self.least[own[first]]
        out[order[first]] = np.where(before == UNKNOWN, UNKNOWN, 1 + np.minimum(before, running[place[first]]))
        later = np.flatnonzero(~first)
        if len(later):
            a, b = place[later - 1] + 1, place[later] + 1
            out[order[later]] = 1 + _Minima(shared, int((b - a).max())).of(a, b)
        last = np.append(np.flatnonzero(first)[1:], len(own)) - 1 if len(own) else np.zeros(0, np.int64)
        known = self.least != UNKNOWN
        self.least[known] = np.minimum(self.least[known], running[-1])
        tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], FAR).astype(np.int32)
        self.least[own[last]] = tail[place[last] + 1]
        return out


def _induce(queue: DiskQueue, text: np.ndarray, wanted: np.ndarray, key_of, since: _Since | None, compare):
    """Pop all tuples, pushing each one's predecessor if it is ``wanted``; yields (key, position, common prefix)."""
    last, bulk = None, 1024
    none = np.iinfo(np.int32).max
    while (got := queue.first(bulk)) is not None:
        key, at, shared = got
        before = at - 1
        fits = (at > 0) & wanted[before]
        to = np.full(len(at), none, np.int32)
        to[fits] = key_of(text[before[fits]])
        # A tuple can go with those before it unless one of these induces a smaller one.
        late = key[1:] > np.minimum.accumulate(to)[:-1]
        n = int(late.argmax()) + 1 if late.any() else len(key)
        key, at, shared, fits, to, before = (x[:n] for x in (key, at, shared, fits, to, before))
        if since is not None:
            shared = shared.copy()
            new = np.flatnonzero(shared == UNKNOWN)
            if len(new):
                other = np.where(new > 0, at[new - 1], last if last is not None else -1)
                shared[new] = compare(at[new], other)
            told = since(shared, np.flatnonzero(fits), to[fits])
        else:
            told = np.full(int(fits.sum()), UNKNOWN, np.int32)
        last = int(at[-1])
        queue.drop(n)
        queue.push(to[fits], before[fits], told)
        yield key, at, shared
        bulk = min(BULK, max(1024, 4 * n))


def _passes(text, is_s, stars, shared, cuts_up, cuts_down, spill, held, base, compare):
    """All suffixes in descending order and common prefixes with the next larger one, from star suffixes in order."""
    top = int(text.max())
    up = DiskQueue(cuts_up, spill, held)
    up.push(2 * text[stars] + 1, stars, shared)
    since = _Since(2 * base, 2 * (top - base) + 2) if compare else None
    found = [(a[~is_s[a]], s[~is_s[a]]) for _, a, s in _induce(up, text, ~is_s, lambda c: 2 * c, since, compare)]
    at, near = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    # In descending order a suffix's neighbour is the one that followed it in ascending order.
    near = np.append(near[1:], UNKNOWN).astype(np.int32)
    symbol = text[at]
    if len(at):
        near[np.append(symbol[1:] != symbol[:-1], True)] = UNKNOWN
    down = DiskQueue(cuts_down, spill, held)
    down.push(2 * (top - symbol[::-1]) + 1, at[::-1], near[::-1])
    since = _DownSince(top, base) if compare else None
    return _induce(down, text, is_s, lambda c: 2 * (top - c), since, compare)


class _DownSince(_Since):
    """Keys of the descending pass: symbols from ``base`` on have the smallest."""

    def __init__(self, top: int, base: int):
        super().__init__(0, 2 * (top - base) + 2)

    def __call__(self, shared, where, key):
        return super().__call__(shared, where, np.where(key < len(self.least), key, -1))


def _names(text: np.ndarray, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each star substring among distinct ones; ``order`` has the stars by their substrings."""
    end = np.append(stars[1:], stars[-1])
    number = np.empty(len(text), np.int32)
    number[stars] = np.arange(len(stars), dtype=np.int32)
    place = number[order]
    size = end[place] - order
    a, b = order[:-1], order[1:]
    same = np.zeros(len(order), bool)
    live = np.flatnonzero(size[:-1] == size[1:])
    step = 0
    while len(live):
        live = live[text[a[live] + step] == text[b[live] + step]]
        done = size[live] == step
        same[live[done] + 1] = True
        live = live[~done]
        step += 1
    rank = np.cumsum(~same) - 1
    out = np.empty(len(stars), np.int32)
    out[place] = rank
    return out


def _cuts(text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys of queue ranges: a symbol each from ``base`` on, else shares of equal numbers of suffixes."""
    top = int(text.max())
    if top - base < 2048:
        up = np.concatenate([[0], np.arange(2 * base, 2 * top + 2)]) if base else np.arange(2 * top + 2)
        down = np.arange(2 * (top - base) + 3)
    else:
        pick = np.unique(np.sort(text)[:: max(1, len(text) // 256)]).astype(np.int64)
        up = np.unique(np.concatenate([[0], 2 * pick]))
        down = np.unique(np.concatenate([[0], 2 * (top - pick)]))
    return up, down


def _sorted_stars(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, cuts, spill, held, base: int) -> np.ndarray:
    """Star suffixes in ascending order: by their substrings, then by recursion on the substrings' names."""
    rough = stars[np.argsort(text[stars], kind="stable")]
    star = np.zeros(len(text), bool)
    star[stars] = True
    none = np.full(len(rough), UNKNOWN, np.int32)
    found = [a[star[a]] for _, a, _ in _passes(text, is_s, rough, none, *cuts, spill, held, base, None)]
    order = np.concatenate([*found, stars[-1:]])[::-1]  # the last suffix is induced by none; it is the smallest
    names = _names(text, stars, order)
    if int(names.max()) + 1 < len(names):
        order = stars[doubled(names) if len(names) <= min(held, BASE) else suffix_array(names, spill, held)]
    return order


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes in ascending order by prefix doubling: the recursion's base case. The last name is the smallest and occurs once."""
    times = np.bincount(names)
    rank = (np.cumsum(times) - times)[names]
    open_ = np.flatnonzero((times > 1)[names])
    step = 1
    while len(open_):
        own, then = rank[open_], rank[open_ + step]
        order = np.argsort(own << 32 | then)
        open_, own, then = open_[order], own[order], then[order]
        at = np.arange(len(open_))
        group = np.diff(own, prepend=-1) != 0
        part = group | (np.diff(then, prepend=-1) != 0)
        start = np.maximum.accumulate(np.where(part, at, 0))
        rank[open_] = own + start - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~(part & np.append(part[1:], True))]
        step *= 2
    out = np.empty(len(names), np.int32)
    out[rank] = np.arange(len(names), dtype=np.int32)
    return out


def suffix_array(text: np.ndarray, spill=None, held: int = HELD) -> np.ndarray:
    """The suffixes of ``text`` (int32, symbols below 2**30) in ascending order. Its last symbol must be its smallest and occur once."""
    return np.concatenate([a for a, _ in _descending(text, 0, spill, held, None)])[::-1]


def suffixes_with_prefixes(text: np.ndarray, base: int, common, spill=None, held: int = HELD):
    """Yields (positions, common prefixes with the next larger suffix), in descending order, in bulks.

    Symbols below ``base`` must occur once each. ``common(a, b)`` gives the lengths of
    the prefixes that suffixes at a and b share; it is asked for star suffixes and where
    the two types meet, all else is induced.
    """
    return _descending(text, base, spill, held, common)


def _descending(text, base, spill, held, common):
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.int32)
        return
    is_s = suffix_types(text)
    stars = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    cuts = _cuts(text, base)
    order = _sorted_stars(text, is_s, stars, cuts, spill, held, base)
    compare = None
    shared = np.full(len(order), UNKNOWN, np.int32)
    if common is not None:

        def compare(a, b):
            out = np.zeros(len(a), np.int32)
            same = (b >= 0) & (text[a] == text[b])
            out[same] = common(a[same], b[same])
            return out

        shared[1:] = compare(order[1:], order[:-1])
        symbol = text[order]
        shared[np.append(True, symbol[1:] != symbol[:-1])] = UNKNOWN
    for _, at, near in _passes(text, is_s, order, shared, *cuts, spill, held, base, compare):
        yield at, near
    yield np.array([n - 1], np.int32), np.zeros(1, np.int32)
