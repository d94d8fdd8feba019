"""Burrows-Wheeler transforms of shards of strings, merged by refining their interleave.

A symbol is a word of WORD bytes, aligned to the string's anchor, by its number among the words of all shards. Each
string closes with an end that sorts last and is a symbol of its own, so that what two strings share stops where either ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD = 8


@dataclass
class Shard:
    """The suffixes of some strings in order, of which it keeps what a merge needs."""

    #: Place of each suffix in the text, in order; the ends come last, as they stand.
    order: np.ndarray
    #: The symbol before each suffix: the Burrows-Wheeler transform. Only where ``inner``.
    bwt: np.ndarray
    #: Rank of the suffix that begins one symbol earlier.
    lf: np.ndarray
    #: Whether there is a symbol before the suffix in its string.
    inner: np.ndarray
    #: Whether a suffix shares ``depth`` symbols with the one before it.
    deep: np.ndarray
    n_plain: int


def build_shard(symbols: np.ndarray, sizes: np.ndarray, depth: int) -> Shard:
    """Sort the suffixes of strings of ``sizes`` symbols, which lie one after another in ``symbols``, by doubling prefixes."""
    n = len(symbols) + len(sizes)
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes
    is_end = np.zeros(n, bool)
    is_end[end] = True
    plain, tail = np.flatnonzero(~is_end), np.flatnonzero(is_end)
    text = np.zeros(n, np.int64)
    text[plain] = symbols
    m = len(plain)
    order = plain[np.argsort(symbols, kind="stable")]
    first = np.ones(m, bool)
    first[1:] = text[order[1:]] != text[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[tail] = np.arange(m, n)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(m), 0))
    h, half, half_rank = 1, 0, rank
    while True:
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
        if h <= depth:
            half, half_rank = h, rank.copy()
        if not len(open_):
            break
        mine = order[open_]
        mine = mine[np.argsort(rank[mine] * n + rank[mine + h], kind="stable")]
        group, second = rank[mine], rank[mine + h]
        new = np.ones(len(mine), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        order[open_] = mine
        first[open_] |= new
        rank[mine] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
    deep = np.zeros(n, bool)
    last = np.repeat(end, sizes + 1)
    a, b = order[:-1], order[1:]
    long = (a + depth <= last[a]) & (b + depth <= last[b])
    a, b, at = a[long], b[long], np.flatnonzero(long) + 1
    same = np.ones(len(a), bool)
    for skip in [*range(0, depth - half, half), depth - half]:
        same &= half_rank[a + skip] == half_rank[b + skip]
    deep[at[same]] = True
    order = np.concatenate([order, tail])
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    before = np.maximum(order - 1, 0)
    inner = order > np.repeat(begin, sizes + 1)[order]
    return Shard(order.astype(np.int32), text[before].astype(np.uint32), place[before], inner, deep, m)


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of small numbers, dealt out digit by digit."""
    turn = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = keys >> 16
    return turn[np.argsort(high[turn].astype(np.uint16), kind="stable")] if high.any() else turn


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All shards' suffixes in one order, and whether each shares ``depth`` symbols with the one before it.

    The order is given as indices into the shards laid one after another. It starts as the shards in turn. Round h
    deals the suffixes out by the symbol before them, in the order of round h - 1: what was in order by h - 1 symbols
    is then in order by h, and a shard's suffixes never change places among themselves. Where two neighbours first part
    in round h they share h - 1 symbols. A block whose suffixes all come from one shard is in its final order; once
    its own suffixes were dealt out, neither they nor what they became are looked at again. No suffix is sorted.
    """
    sizes = np.array([len(s.order) for s in shards])
    base = np.concatenate(([0], np.cumsum(sizes)))
    total = int(base[-1])
    inner = np.concatenate([s.inner for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    lf = np.concatenate([s.lf + np.int32(b) for s, b in zip(shards, base, strict=False)])
    deep = np.concatenate([s.deep for s in shards])
    owner = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    plain = np.concatenate([np.arange(n) < s.n_plain for n, s in zip(sizes, shards, strict=True)])
    n_plain = int(plain.sum())
    merged = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]).astype(np.int32)
    block = np.zeros(total, np.int64)  # twice the first place of each place's block, plus one if one shard fills it
    apart = np.zeros(total, bool)
    apart[:1] = apart[n_plain:] = True
    source, target = np.arange(total, dtype=np.int32), np.arange(n_plain, dtype=np.int32)
    for h in range(depth):
        if not len(target):
            break
        if h == 1:  # by one symbol, every end is in order
            block[n_plain:] = np.arange(n_plain, total) * 2 + 1
        suffix, origin = merged[source], block[source]
        dealt = np.flatnonzero(inner[suffix])
        source = source[origin & 1 == 0]
        suffix, origin = suffix[dealt], origin[dealt]
        symbol = bwt[suffix]
        turn = _stable(symbol)
        symbol, image, origin = symbol[turn], lf[suffix[turn]], origin[turn]
        new = np.ones(len(target), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (origin[1:] != origin[:-1]) | (target[1:] - target[:-1] != 1)
        merged[target] = image
        starts = np.flatnonzero(new)
        first, shard = target[starts], owner[image]
        apart[first] = True
        lone = np.minimum.reduceat(shard, starts) == np.maximum.reduceat(shard, starts)
        block[target] = np.repeat(first.astype(np.int64) * 2 + lone, np.diff(starts, append=len(target)))
        target = target[origin & 1 == 0]
    same = ~apart
    same[1:] &= deep[merged[1:]] | (owner[merged[1:]] != owner[merged[:-1]])
    return merged, same


def repeated_windows(strings: list[bytes], anchor_at: np.ndarray, shard_of: np.ndarray, window: int, side: int) -> np.ndarray:
    """For each string and each d in 0..side: whether the ``window`` bytes that start d before its anchor are in another string, as far before its anchor.

    ``window`` is a multiple of WORD. A window holds all but one of its words whole, however it lies to the words
    of its string. So the strings' words become one Burrows-Wheeler transform for each shard, and the merged order gives the
    intervals of suffixes that share one word less than a window; a repeat shares such an interval, its place
    and the bytes that are left on either side.
    """
    out = np.zeros((len(strings), side + 1), bool)
    if window % WORD or window <= WORD:
        raise ValueError(f"window is no multiple of {WORD}")
    if not strings:
        return out
    length = np.array([len(s) for s in strings])
    skip = anchor_at % WORD
    sizes = (length - skip) // WORD
    raw = np.frombuffer(bytes(WORD) + b"".join(strings) + bytes(window), np.uint8)
    base = WORD + np.cumsum(length) - length
    string = np.repeat(np.arange(len(strings)), sizes)
    number = np.arange(len(string)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = base[string] + skip[string] + number * WORD

    def words(place: np.ndarray) -> np.ndarray:
        value = np.zeros(len(place), np.uint64)
        for k in range(WORD):
            value = value << np.uint64(8) | raw[place + k]
        return value

    symbols = np.unique(words(at), return_inverse=True)[1]
    shards, places = [], []
    for s in np.unique(shard_of):
        mine = np.flatnonzero(shard_of == s)
        own = shard_of[string] == s
        shards.append(build_shard(symbols[own], sizes[mine], window // WORD - 1))
        flat = np.full(len(shards[-1].order), -1)  # ends have no place
        ends = np.cumsum(sizes[mine] + 1) - 1
        is_end = np.zeros(len(flat), bool)
        is_end[ends] = True
        flat[~is_end] = np.flatnonzero(own)
        places.append(flat[shards[-1].order])
    merged, same = merge(shards, window // WORD - 1)
    either = same.copy()
    either[:-1] |= same[1:]
    hits = np.flatnonzero(either)
    interval = np.cumsum(~same)[hits]
    spot = np.concatenate(places)[merged[hits]]
    owner, at = string[spot], at[spot]
    before, after = words(at - WORD), words(at + window - WORD)
    for e in range(WORD):
        first = at - base[owner] - e
        d = anchor_at[owner] - first
        ok = np.flatnonzero((first >= 0) & (first + window <= length[owner]) & (d >= 0) & (d <= side))
        bits = np.uint64(8 * e)
        rest = after[ok] >> bits
        if e:
            rest |= (before[ok] & ((np.uint64(1) << bits) - np.uint64(1))) << (np.uint64(8 * WORD) - bits)
        key = interval[ok] * (side + 1) + d[ok]
        order = np.lexsort((rest, key))
        pair = (key[order[1:]] == key[order[:-1]]) & (rest[order[1:]] == rest[order[:-1]])
        twice = np.zeros(len(ok), bool)
        twice[order[1:][pair]] = True
        twice[order[:-1][pair]] = True
        hit = ok[twice]
        out[owner[hit], d[hit]] = True
    return out
