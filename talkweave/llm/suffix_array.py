"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour. The
leftmost smaller ones cut the text into substrings; these are sorted by one
induction, named, and the string of names is sorted recursively until names are
unique. A second induction from the sorted leftmost-smaller suffixes gives the
array. Both are linear in the text.

A bucket's suffixes are induced in waves: what a wave puts into its own bucket
is the next wave. Over bytes and the first names there are few buckets, so waves
are array operations; over later names there are many small ones, and a plain
loop is faster.
"""

from __future__ import annotations

import numpy as np

FEW = 1 << 10  # symbols up to which waves are used
SHORT = 12  # suffixes of a wave that are moved one by one


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol must be the only smallest."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.where(text[:-1] == text[1:], n, np.arange(n - 1))
        deciding = np.minimum.accumulate(differs[::-1])[::-1]  # the next place with another symbol behind it
        out[:-1] = (text[:-1] < text[1:])[deciding]
    return out


def _in_runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted symbols: the first of each run, the runs' lengths, and each item's place in its run."""
    heads = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1))
    sizes = np.diff(heads, append=len(found))
    return heads, sizes, np.arange(len(found)) - np.repeat(heads, sizes)


def _induce_waves(text, smaller, seeds, starts, ends) -> np.ndarray:
    n, k = len(text), len(starts)
    out = np.full(n, -1, np.int64)
    symbols = text[seeds]
    order = np.argsort(symbols, kind="stable")
    seeded = np.bincount(symbols, minlength=k)
    out[(ends - seeded)[symbols[order]] + _in_runs(symbols[order])[2]] = seeds[order]
    head, tail = starts.copy(), ends.copy()

    def push(suffixes: np.ndarray, want_smaller: bool) -> None:
        if len(suffixes) < SHORT:
            for i in suffixes.tolist():
                if i and smaller[i - 1] == want_smaller:
                    c = text[i - 1]
                    if want_smaller:
                        tail[c] -= 1
                        out[tail[c]] = i - 1
                    else:
                        out[head[c]] = i - 1
                        head[c] += 1
            return
        before = suffixes[suffixes > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return
        found = text[before]
        order = np.argsort(found, kind="stable")
        found, before = found[order], before[order]
        heads, sizes, place = _in_runs(found)
        if want_smaller:
            out[tail[found] - 1 - place] = before
            tail[found[heads]] -= sizes
        else:
            out[head[found] + place] = before
            head[found[heads]] += sizes

    used = np.flatnonzero(ends > starts).tolist()
    for c in used:
        done = int(starts[c])
        while done < head[c]:
            wave = slice(done, int(head[c]))
            done = wave.stop
            push(out[wave], False)
        if seeded[c]:
            push(out[int(ends[c] - seeded[c]) : int(ends[c])], False)
    for c in reversed(used):
        done = int(ends[c])
        while done > tail[c]:
            wave = slice(int(tail[c]), done)
            done = wave.start
            push(out[wave][::-1], True)
        if head[c] > starts[c]:
            push(out[int(starts[c]) : int(head[c])][::-1], True)
    out[0] = n - 1
    return out


def _induce_loop(text, smaller, seeds, starts, ends) -> np.ndarray:
    n, text = len(text), text.astype(np.int64)
    # Symbol in front of each suffix if that is of the wanted type, else -1; place n stands for "empty".
    larger, less = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    larger[1:n] = np.where(smaller[:-1], -1, text[:-1])
    less[1:n] = np.where(smaller[:-1], text[:-1], -1)
    out = np.full(n, n, np.int64)
    symbols = text[seeds]
    order = np.argsort(symbols, kind="stable")
    heads, sizes, place = _in_runs(symbols[order])
    seeded = np.zeros(len(starts), np.int64)
    seeded[symbols[order][heads]] = sizes
    out[(ends - seeded)[symbols[order]] + place] = seeds[order]
    out, head, front = out.tolist(), starts.tolist(), larger.tolist()
    for i in out:  # sees what is put behind it
        c = front[i]
        if c >= 0:
            place = head[c]
            out[place] = i - 1
            head[c] = place + 1
    tail, front = ends.tolist(), less.tolist()
    for i in reversed(out):
        c = front[i]
        if c >= 0:
            place = tail[c] - 1
            out[place] = i - 1
            tail[c] = place
    out[0] = n - 1
    return np.array(out, np.int64)


def _names(text: np.ndarray, firsts: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each leftmost-smaller substring, equal ones alike, in text order; and how many there are."""
    n = len(text)
    place = np.zeros(n, np.int64)
    place[firsts] = np.arange(len(firsts))
    stops = np.r_[firsts[1:], n - 1]
    lengths = (stops - firsts + 1)[place[ordered]]
    a, b = ordered[:-1], ordered[1:]
    same = np.flatnonzero(lengths[:-1] == lengths[1:])
    depth = 0
    equal = np.zeros(len(a), bool)
    while len(same):
        ended = lengths[same] <= depth
        equal[same[ended]] = True
        same = same[~ended]
        same = same[text[a[same] + depth] == text[b[same] + depth]]
        depth += 1
    names = np.zeros(n, np.int64)
    names[ordered] = np.r_[0, np.cumsum(~equal)]
    return names[firsts], int(np.count_nonzero(~equal)) + 1


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Start of each suffix in order. text: symbols below `size`; its last one is 0, which is nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    if size <= 1 << 16:
        text = text.astype(np.uint16)  # sorted by counting
    smaller = smaller_types(text)
    firsts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    induce = _induce_waves if size <= FEW else _induce_loop
    first = np.zeros(n, bool)
    first[firsts] = True
    ordered = induce(text, smaller, firsts, starts, ends)
    ordered = ordered[first[ordered]]
    names, distinct = _names(text, firsts, ordered)
    if distinct < len(firsts):
        ordered = firsts[suffix_array(names, distinct)]
    return induce(text, smaller, ordered, starts, ends)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by its start, how many symbols it shares with the one before it in the array.

    Where the symbols in front of both are equal, the value is one less than that
    of the suffix in front; only the others are compared, all of them one symbol a step.
    """
    n = len(text)
    before = np.full(n, n - 1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    free = np.ones(n, bool)
    free[1:] = (text[:-1] != text[before[1:] - 1]) | (before[1:] == 0) | (before[1:] == n - 1)
    i = here[free]
    j = before[free]
    length = np.zeros(len(i), np.int64)
    live = np.flatnonzero(j != n - 1)
    while len(live):
        same = text[i[live] + length[live]] == text[j[live] + length[live]]
        live = live[same]
        length[live] += 1
        live = live[(i[live] + length[live] < n) & (j[live] + length[live] < n)]
    ends = np.where(free, 0, -1)
    ends[free] = i + length
    return np.maximum(np.maximum.accumulate(ends) - here, 0)
