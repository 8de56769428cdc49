"""Suffix arrays of byte shards inside a task: Larsson-Sadakane refinement and Kasai prefixes,
and the anchors (window minimisers) by which shards agree on the text they have to compare."""

from __future__ import annotations

import numpy as np

from fleetbook.llm.common import U64, mix64, powers, BASE_INV

#: Length of the strings that are looked for, and of the grams whose smallest hash anchors one.
LENGTH = 50
GRAM = 24
WIDE = LENGTH - GRAM + 1
POS_BITS = 23


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of ``data`` in the lexicographic order of their suffixes.

    Suffixes are ranked by their first eight bytes; every refinement ranks the members of
    groups that are still tied by the pair (rank of the suffix, rank of the suffix as
    many bytes on), which doubles the compared length; groups of one are never touched again.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    key = np.zeros(n, dtype=U64)
    for j in range(8):
        key = (key << U64(8)) | padded[j:n + j].astype(U64)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.append(start, n)))     # a group's rank: where it begins
    rank[order] = group
    have = 8
    while have < n:
        tied = np.ones(n, dtype=bool)
        tied[start[np.diff(np.append(start, n)) == 1]] = False
        at = np.flatnonzero(tied)                               # places in ``order`` still tied
        if not len(at):
            break
        who = order[at]
        ahead = np.where(who + have < n, rank[np.minimum(who + have, n - 1)] + 1, 0)
        place = rank[who]
        sub = np.lexsort((who, ahead, place))
        who, ahead, place = who[sub], ahead[sub], place[sub]
        order[at] = who
        first = np.ones(len(at), dtype=bool)
        first[1:] = (place[1:] != place[:-1]) | (ahead[1:] != ahead[:-1])
        begin = np.flatnonzero(first)
        rank[who] = np.repeat(at[begin], np.diff(np.append(begin, len(at))))
        new = np.ones(n, dtype=bool)
        new[at] = first
        start = np.flatnonzero(new)
        have *= 2
    return order


def kasai(data: np.ndarray, order: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Common prefix lengths, up to ``limit``, of each suffix in ``order`` with the one before it.

    Kasai's rule (the prefix of the next position's suffix is at most one shorter) is followed in
    many stretches of the text at once, one array element per stretch.
    """
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    stretch = max(64, int(np.sqrt(n)))
    pos = np.arange(0, n, stretch)
    end = np.minimum(pos + stretch, n)
    h = np.zeros(len(pos), dtype=np.int64)
    live = np.arange(len(pos))
    while len(live):
        i = pos[live]
        r = rank[i]
        j = np.where(r > 0, order[np.maximum(r - 1, 0)], n)
        k = h[live]
        grow = (k < limit) & (i + k < n) & (j + k < n)
        grow[grow] = data[(i + k)[grow]] == data[(j + k)[grow]]
        h[live[grow]] += 1
        stop = live[~grow]
        out[rank[pos[stop]]] = h[stop]
        h[stop] = np.maximum(h[stop] - 1, 0)
        pos[stop] += 1
        live = live[pos[live] < end[live]]
    return out


def equal_runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): positions in suffix order and the number of the run of suffixes that agree
    in their first ``length`` bytes.  Positions closer than ``length`` to the end are included;
    the caller leaves out those that are no whole string."""
    order = suffix_array(data)
    return order, np.cumsum(kasai(data, order, length) < length) - 1


def windows(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray):
    """Anchor every ``LENGTH``-byte window by its leftmost smallest gram.

    Returns runs of consecutive windows of one document with one anchor: (document, first window
    start, number of windows, gram hash).  Equal windows have equal gram hashes, wherever they stand.
    ``data`` is shorter than 2**POS_BITS.
    """
    n = len(data)
    count = n - LENGTH + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none, np.zeros(0, U64)
    with np.errstate(over="ignore"):
        grams = n - GRAM + 1
        value = mix64((prefix[GRAM:] - prefix[:-GRAM]) * powers(grams, BASE_INV))
    value = (value >> U64(POS_BITS) << U64(POS_BITS)) | np.arange(grams, dtype=U64)
    size = 1
    while 2 * size <= WIDE:                                    # sliding minimum by doubling
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    if size < WIDE:
        value = np.minimum(value[:len(value) - (WIDE - size)], value[WIDE - size:])
    ends = offsets[1:]
    doc = np.repeat(np.arange(len(ends)), np.diff(offsets))[:count]
    ok = np.arange(count) + LENGTH <= ends[doc]
    first = np.ones(count, dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
    start = np.flatnonzero(first)
    width = np.diff(np.append(start, count))
    keep = ok[start]
    start, width = start[keep], width[keep]
    return doc[start], start, width, value[start] >> U64(POS_BITS)
