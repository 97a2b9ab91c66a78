"""Suffixes and common prefixes of a shard by external induced sorting.

The text is an array of symbols that ends with its only zero. A suffix is S-type if it is smaller than the next one, else L-type; an S-type one after
an L-type one is a seed. Seed substrings (from a seed to the next) get names in their order; where names repeat, the text of names is
sorted in the same way first, which recursion ends when all names differ. From the seeds in order all L-type suffixes are induced in ascending order,
and from these all S-type ones in descending order.

What waits to be popped is a priority queue by first symbol, and by time within one symbol: of each symbol's entries it is known how many there
will be, so the queue is one array with a region for each symbol, and entries go to the head of their region. Popping walks the array up to the
first entry that has not come yet, a block at a time. Arrays over ``MEMORY`` are mapped files without a name, which go with the task; only
blocks of them, and the sort keys of seeds, are in memory.

At the level of the text entries carry the length of the prefix that they share with the one before, up to a bound: one more than the smallest
value that was popped between their inducers.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of an array beyond which it is on disk, and entries popped at once.
MEMORY, BLOCK = 64 << 20, 1 << 16


def disk_array(size: int, kind: type, fill: int | None = None) -> np.ndarray:
    if size * np.dtype(kind).itemsize <= MEMORY:
        out = np.empty(size, kind)
    else:
        with tempfile.TemporaryFile() as file:  # has no name: its space is free when the mapping goes, or the task dies
            file.truncate(size * np.dtype(kind).itemsize)
            out = np.memmap(file, kind, "r+", shape=(size,))
    if fill is not None:
        out[:] = fill
    return out


def types_of(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes. Of equal neighbours the type is that of the next one that differs."""
    n = len(text)
    small = disk_array(n, bool, True)
    differs = np.flatnonzero(text[:-1] != text[1:])  # the type of these is known, and holds for the equal ones before
    if n > 1:
        small[: n - 1] = np.repeat(text[differs] < text[differs + 1], np.diff(np.concatenate(([-1], differs))))
    return small


def names_of(text: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each seed's substring (with the symbol of the next seed) among the distinct ones, and their number. A substring that begins
    another is larger: the other goes on with an L-type symbol."""
    top = int(text.max()) + 1
    width = max(1, 63 // top.bit_length())
    past = np.concatenate((seeds[1:] + 1, [len(text)]))
    rank, live, at = np.zeros(len(seeds), np.int64), np.arange(len(seeds)), 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        for j in range(at, at + width):
            place = seeds[live] + j
            inside = place < past[live]
            word = (word << top.bit_length()) | np.where(inside, text[np.where(inside, place, 0)], top)
        # Ranks have gaps where live ones split, as each group starts at the number of seeds before it.
        order = np.lexsort((word, rank[live])) if at else np.argsort(word, kind="stable")
        r, w = rank[live][order], word[order]
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new_word = new_group | np.concatenate(([True], w[1:] != w[:-1]))
        index = np.arange(len(live))
        start = np.maximum.accumulate(np.where(new_group, index, 0))
        place = np.maximum.accumulate(np.where(new_word, index, 0))
        rank[live[order]] = r + (place - start)
        at += width
        sizes = np.diff(np.concatenate((np.flatnonzero(new_word), [len(live)])))
        alone = np.repeat(sizes == 1, sizes)
        ended = seeds[live[order]] + at > past[live[order]]  # what ends with the word still has to go behind those that go on
        live = live[order][~alone & ~ended]
    distinct, names = np.unique(rank, return_inverse=True)
    return names.reshape(-1), len(distinct)


class Ranges:
    """Smallest values of ranges of a block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))
        self.log = np.zeros(len(values) + 2, np.int64)
        for k in range(1, len(self.levels)):
            self.log[1 << k :] = k

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the places low to high, both included."""
        k = self.log[high - low + 1]
        out = np.empty(len(low), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.levels[level][low[at]], self.levels[level][high[at] - (1 << level) + 1])
        return out


class Shared:
    """The common prefixes that entries carry. since: for each symbol the smallest value popped after the last entry of the symbol was made."""

    def __init__(self, size: int, symbols: int, bound: int):
        self.bound, self.values = bound, disk_array(size, np.int16, 0)
        self.since = np.zeros(symbols, np.int64)
        self.made = np.zeros(symbols, bool)

    def induce(self, popped: np.ndarray, symbols: np.ndarray, sources: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Values of new entries, grouped by symbol: sources are their places among the popped, ``first`` says where a symbol's group begins."""
        ranges = Ranges(popped)
        low = np.concatenate(([0], sources[:-1] + 1))
        low[first] = 0
        found = ranges.smallest(low, sources)
        lead = symbols[first]
        found[first] = np.where(self.made[lead], np.minimum(found[first], self.since[lead]), -1)
        rest = np.minimum.accumulate(popped[::-1])[::-1]
        after = np.append(rest[1:], self.bound)
        self.since = np.minimum(self.since, rest[0])
        last = np.append(first[1:], len(symbols)) - 1
        self.since[lead], self.made[lead] = after[sources[last]], True
        return np.minimum(found + 1, self.bound)


def run_length(text: np.ndarray, at: int, bound: int) -> int:
    part = text[at : at + bound]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(text: np.ndarray, queue: np.ndarray, heads: np.ndarray, step: int, small: np.ndarray, shared: Shared | None) -> None:
    """Fill the free entries (-1) of a queue. step: 1 for L-type ones in ascending order, -1 for S-type ones in descending order."""
    at, past, size = (0, len(queue), 1024) if step > 0 else (len(queue) - 1, -1, 1024)
    while at != past:
        end = min(past, at + size) if step > 0 else max(past, at - size)
        block = np.asarray(queue[at:end] if step > 0 else queue[end + 1 : at + 1][::-1])
        free = np.flatnonzero(block < 0)
        if len(free):
            block = block[: free[0]]
        size = min(BLOCK, max(1024, 2 * len(block)))
        before = block - 1
        some = np.flatnonzero(before >= 0)
        own, symbol = text[block[some]], text[before[some]]
        if step > 0:
            wanted = symbol >= own
        else:
            wanted = (symbol < own) | ((symbol == own) & small[block[some]])
        sources = some[wanted]
        symbols = symbol[wanted]
        order = np.argsort(symbols, kind="stable")  # by digits, where symbols are small
        sources, symbols = sources[order], symbols[order].astype(np.int64)
        if len(symbols):
            first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            counts = np.diff(np.append(first, len(symbols)))
            place = heads[symbols] + step * (np.arange(len(symbols)) - np.repeat(first, counts))
            queue[place] = before[sources]
            heads[symbols[first]] += step * counts
        if shared is not None:
            popped = np.asarray(shared.values[at : at + len(block)] if step > 0 else shared.values[at - len(block) + 1 : at + 1][::-1])
            if len(symbols):
                new = shared.induce(popped, symbols, sources, first)
                # A symbol's first entry keeps what its place says of the neighbour before.
                shared.values[place] = np.where(new > 0, new, shared.values[place])
            else:
                shared.since = np.minimum(shared.since, popped.min(initial=shared.bound))
        at += step * len(block)


def text_prefixes(text: np.ndarray, one: np.ndarray, other: np.ndarray, bound: int) -> np.ndarray:
    """How much the suffixes at two places share, up to the bound: words of eight bytes are compared while they agree."""
    wide = text.dtype.itemsize
    padded = np.concatenate((text, np.zeros(8, text.dtype)))
    words = np.ndarray(len(text), np.uint64, padded, strides=(wide,))  # a word at every place; the text's only zero ends all agreement in time
    out, live = np.zeros(len(one), np.int64), np.arange(len(one))
    while len(live):
        differs = words[one[live] + out[live]] ^ words[other[live] + out[live]]
        lowest = np.where(differs == 0, np.uint64(64), np.bitwise_count((differs & -differs) - np.uint64(1))) >> np.uint64(3)
        out[live] += lowest.astype(np.int64) // wide
        live = live[(differs == 0) & (out[live] < bound)]
    return np.minimum(out, bound)


def sorted_suffixes(text: np.ndarray, bound: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Places of all suffixes in their order and, with a bound, what each shares with the one before it, up to the bound."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int16) if bound else None
    small = types_of(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, distinct = names_of(text, seeds)
    if distinct == len(seeds):
        order = np.empty(len(seeds), np.int64)
        order[names] = np.arange(len(seeds))
    else:
        order, _ = sorted_suffixes(names.astype(np.uint16 if distinct < 1 << 16 else np.int32 if distinct < 1 << 31 else np.int64))
    ranked = seeds[order]
    symbols = int(text.max()) + 1
    large_counts = np.bincount(text[~small], minlength=symbols)
    seed_counts = np.bincount(text[seeds], minlength=symbols)
    small_counts = np.bincount(text[small], minlength=symbols)

    # Ascending: in each symbol's region the L-type entries to come, then the seeds.
    region = np.cumsum(large_counts + seed_counts)
    queue = disk_array(len(seeds) + int(large_counts.sum()), np.int64, -1)
    heads = region - large_counts - seed_counts
    own = text[ranked].astype(np.int64)
    seed_place = (heads + large_counts)[own] + np.arange(len(seeds)) - np.repeat(np.cumsum(seed_counts) - seed_counts, seed_counts)
    queue[seed_place] = ranked
    shared = None
    if bound:
        shared = Shared(len(queue), symbols, bound)
        same = np.flatnonzero(own[1:] == own[:-1]) + 1
        shared.values[seed_place[same]] = text_prefixes(text, ranked[same - 1], ranked[same], bound)
        seed_runs = {c: run_length(text, int(ranked[i]), bound) for i, c in zip(np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist(), np.unique(own).tolist())}
        # The last L-type entry of a symbol, before its first seed: both are runs of the symbol, and the shorter run ends what they share. Runs of L-type ones
        # come in the order of their lengths.
        longest = run_lengths(text, ~small, symbols, bound)
        for c, run in seed_runs.items():
            if large_counts[c]:
                shared.values[heads[c] + large_counts[c]] = min(run, longest[c])
    large_heads = heads.copy()
    induce(text, queue, heads, 1, small, shared)

    # Descending: in each region the S-type entries to come behind the L-type ones.
    whole = np.cumsum(large_counts + small_counts)
    begin = whole - large_counts - small_counts
    large = np.flatnonzero(np.repeat(np.tile([True, False], symbols), np.stack((large_counts, seed_counts), 1).ravel()))
    final = disk_array(n, np.int64, -1)
    place = np.arange(len(large)) + np.repeat(begin - (np.cumsum(large_counts) - large_counts), large_counts)
    final[place] = queue[large]
    if bound:
        down = Shared(n, symbols, bound)
        # What an entry shares with the one above it, which is popped before.
        inner = np.ones(len(large), bool)
        inner[(np.cumsum(large_counts) - large_counts)[large_counts > 0]] = False
        down.values[place[inner] - 1] = shared.values[large[inner]]
        small_runs = run_lengths(text, small, symbols, bound)
        for c in np.flatnonzero((large_counts > 0) & (small_counts > 0)).tolist():
            down.values[begin[c] + large_counts[c] - 1] = min(longest[c], small_runs[c])
        shared = down
    # The end of the text is the only suffix of its symbol, and nothing induces it.
    final[0] = n - 1
    heads = whole - 1
    induce(text, final, heads, -1, small, shared)
    if not bound:
        return final, None
    out = disk_array(n, np.int16, 0)
    out[1:] = shared.values[:-1]
    return final, out


def run_lengths(text: np.ndarray, which: np.ndarray, symbols: int, bound: int) -> np.ndarray:
    """The longest run of each symbol among suffixes of one type, up to the bound."""
    edges = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    lengths = np.diff(np.append(edges, len(text)))
    out = np.zeros(symbols, np.int64)
    of = which[edges]
    np.maximum.at(out, text[edges[of]].astype(np.int64), lengths[of])
    return np.minimum(out, bound)
