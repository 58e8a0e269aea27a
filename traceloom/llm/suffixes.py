"""Suffix sorting by Lyndon-prefix groups, and repeated substrings of a bounded batch of texts."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_R), -1, 2**64))
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
GRAM, REACH = 8, 32  # a unit's border is the least of 32 hashes of 8 bytes each


def suffix_array(symbols: list[int]) -> list[int]:
    """Positions of the suffixes in ascending order.

    Suffixes are held in groups that will share their Lyndon prefix, at first by symbol. Groups are taken from the
    highest down. A member's pointer is the nearest place before it in a lower group; pointers of members already
    taken are followed, so that each is walked over once. Places that members point to carry their prefix on: they
    move to a new group right above their own, higher the more members point to them. At the end each suffix stands in
    its final group, and one walk from the smallest suffix on, along the pointers, gives the order within groups.
    """
    n = len(symbols) + 1
    kinds = sorted(set(symbols))
    of = {s: g for g, s in enumerate(kinds, 1)}
    gid = [of[s] for s in symbols] + [0]  # the end of the text is the smallest
    members: list[list[int]] = [[] for _ in range(len(kinds) + 1)]
    for i, g in enumerate(gid):
        members[g].append(i)
    upper = list(range(1, len(kinds) + 2))
    lower = list(range(-1, len(kinds)))
    upper[-1] = -1
    prev, done = [-1] * n, bytearray(n)
    g = len(kinds)
    while g >= 0:
        pointed: dict[int, int] = {}
        own = [i for i in members[g] if gid[i] == g]
        own.sort()
        members[g] = own
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            done[i] = 1
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p, k in pointed.items():
            moved.setdefault(gid[p], {}).setdefault(k, []).append(p)
        for h, by_count in moved.items():
            at = h
            for k in sorted(by_count):
                new, above = len(members), upper[at]
                members.append(by_count[k])
                for p in by_count[k]:
                    gid[p] = new
                lower.append(at)
                upper.append(above)
                upper[at] = new
                if above >= 0:
                    lower[above] = new
                at = new
        g = lower[g]
    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = upper[g]
    order, placed = [n - 1] * n, bytearray(n)
    start[0] += 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            h = gid[j]
            order[start[h]] = j
            start[h] += 1
            placed[j] = 1
            j = prev[j]
    return order[1:]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """64-bit hashes of any stretch of a text, from sums over its bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_powers.get("up", ())) < n + 1:
            size = max(1 << 16, 1 << n.bit_length())
            one = np.ones(1, dtype=np.uint64)
            _powers["up"] = np.concatenate([one, np.cumprod(np.full(size, _R), dtype=np.uint64)])
            _powers["down"] = np.concatenate([one, np.cumprod(np.full(size, _BACK), dtype=np.uint64)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers["up"][:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers["down"][start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * _powers["down"][: len(self.sums) - size])


def least(h: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of each stretch of `reach` values, from minima up to and from the borders of blocks."""
    n = len(h) - reach + 1
    full = np.concatenate([h, np.full(-len(h) % reach, np.uint64(2**64 - 1))]).reshape(-1, reach)
    up = np.minimum.accumulate(full, axis=1).ravel()
    down = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[reach - 1 : reach - 1 + n])


def last_least(h: np.ndarray, reach: int) -> np.ndarray:
    """Place of the minimum of each stretch, the last one of equals."""
    m = least(h, reach)
    # the last place, up to the end of each stretch, at which the stretch's own minimum stands
    order = np.lexsort((np.arange(len(h)), h))
    rank_key = h[order]
    stop = np.arange(len(m)) + reach - 1
    # among equal values places ascend; find the last place <= stop
    first = np.searchsorted(rank_key, m, side="left")
    after = np.searchsorted(rank_key, m, side="right")
    single = after - first == 1
    out = np.empty(len(m), dtype=np.int64)
    out[single] = order[first[single]]
    many = np.flatnonzero(~single)
    if len(many):
        kind = np.cumsum(np.concatenate([[0], rank_key[1:] != rank_key[:-1]]))
        wide = np.int64(len(h) + 1)
        flat = kind * wide + order
        out[many] = order[np.searchsorted(flat, kind[first[many]] * wide + stop[many], side="right") - 1]
    return out


def within(h: np.ndarray, value: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often value[k] stands in h[first[k]:end[k]]."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    kind = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    if kind[-1] == len(h) - 1:
        return np.ones(len(value), dtype=np.int64)
    wide = np.int64(len(h) + 1)
    flat, own = kind * wide + order, kind[np.searchsorted(ranked, value)] * wide
    return np.searchsorted(flat, own + end) - np.searchsorted(flat, own + first)


def regions(data: np.ndarray, window: int, gram: int, most: int = 2048) -> tuple[np.ndarray, ...]:
    """Stretches of window starts that share the least of the hashes of all `gram` bytes in their windows: that hash,
    the hash of all bytes of the stretch's windows, first start, starts, whether the least hash stands in it more than
    once (then it may repeat itself). Equal windows get equal first hashes, wherever they stand; a stretch has `most`
    starts at most."""
    if len(data) < window:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(bool)
    h = Hashes(data)
    grams = h.grams(gram)
    m = least(grams, window - gram + 1)
    n = len(m)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    length = np.diff(np.append(first, n))
    if (length > most).any():
        parts = -(-length // most)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(first + length, parts)
        first = np.repeat(first, parts) + k * most
        length = np.minimum(whole - first, most)
    again = within(grams, m[first], first, first + length + window - gram) > 1
    return m[first], h.of(first, first + length + window - 1), first, length, again


def words_at(data: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """`words` big-endian numbers of eight bytes each from each place on: they order places as their bytes do. data
    has eight times as many bytes behind the last place."""
    eight = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    return eight[at[:, None] + 8 * np.arange(words)].astype(np.uint64)


def blocks_at(data: np.ndarray, at: np.ndarray, left: np.ndarray, words: int) -> list[np.ndarray]:
    """Keys, the last one first in rank, that order the bytes from each place on, of which `left` are the text's own; of
    two equal ones that which ends sooner comes first."""
    found = words_at(data, at, words)
    for k in range(words):
        own = np.clip(left - 8 * k, 0, 8).astype(np.uint64)
        found[:, k] &= ~np.where(own == 8, np.uint64(0), np.uint64(2**64 - 1) >> (np.uint64(8) * own))
    return [np.minimum(left, 8 * words), *(found[:, k] for k in reversed(range(words)))]


def shared(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from a[k] and b[k] on, most[k] at most: the bytes themselves are compared, eight at a time."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = np.maximum(most, 0)
    live, j = np.flatnonzero(most > 0), 0
    while len(live):
        differ = eight[a[live] + j] ^ eight[b[live] + j]
        on = differ != 0
        lowest = differ[on] & (~differ[on] + np.uint64(1))
        out[live[on]] = np.minimum(out[live[on]], j + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        j += 8
        live = live[~on & (out[live] > j)]
    return out


def repeated(texts: list[bytes], times: list[int], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, which stands `times` times, the starts of its windows that occur elsewhere: (first, end) of runs.

    Texts are cut into units at borders that their own bytes fix: 40 bytes from a border on fix the next one. A border's
    symbol is the rank of these bytes, so that sorting the suffixes of symbols sorts the suffixes of bytes. A window is
    cut at its first border, k bytes from its start. It occurs elsewhere if a suffix shares window - k bytes with the
    border's, which the common prefixes of sorted neighbours tell, and k bytes before it, which the common endings of
    neighbours sorted backwards tell.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join([*texts, bytes(window + 64)]), dtype=np.uint8)
    total = int(size.sum())
    begin = np.cumsum(size) - size
    border_of = last_least(Hashes(data[:total]).grams(GRAM), REACH)
    at = np.unique(border_of)
    text_of = np.searchsorted(begin, at, side="right") - 1
    left = begin[text_of] + size[text_of] - at
    ranked = blocks_at(data, at, left, (REACH + GRAM) // 8)
    order = np.lexsort(ranked)
    symbol = np.empty(len(at), dtype=np.int64)
    symbol[order] = np.cumsum(np.any([np.diff(x[order], prepend=x[order[:1]]) != 0 for x in ranked], axis=0)) + 1
    order = np.array(suffix_array(symbol.tolist()), dtype=np.int64)
    a, b = order[:-1], order[1:]
    prefix = shared(data, at[a], at[b], np.minimum(np.minimum(left[a], left[b]), window))
    starts = size - window + 1
    s = np.concatenate([np.arange(x, x + n) for x, n in zip(begin.tolist(), starts.tolist(), strict=True)])
    border = np.searchsorted(at, border_of[s])
    before = at[border] - s
    weight = np.asarray(times, dtype=np.int64)
    # places to look at: suffixes that share enough with a neighbour for the longest part before a border
    near = prefix >= window - REACH + 1
    close = np.zeros(len(at), bool)
    close[order[:-1][near]] = close[order[1:][near]] = True
    found = np.flatnonzero(close)
    back = data[:total][::-1]
    back = np.concatenate([back, np.zeros(window + 64, np.uint8)])
    ahead = at[found] - begin[text_of[found]]
    by_left = np.lexsort(blocks_at(back, total - at[found], ahead, REACH // 8))
    x, y = by_left[:-1], by_left[1:]
    ending = shared(back, total - at[found[x]], total - at[found[y]], np.minimum(np.minimum(ahead[x], ahead[y]), REACH))
    hit = np.zeros(len(s) + 1, bool)
    group, side = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    on = np.flatnonzero(close[border])
    on = on[np.argsort(before[on], kind="stable")]
    cuts = np.searchsorted(before[on], np.arange(REACH + 1))
    for k in range(REACH):
        some = on[cuts[k] : cuts[k + 1]]
        if not len(some):
            continue
        group[order] = np.cumsum(np.concatenate([[0], prefix < window - k]))
        side[found[by_left]] = np.cumsum(np.concatenate([[0], ending < k]))
        p = border[some]
        kind, of, n = np.unique(group[p] * len(at) + side[p], return_inverse=True, return_counts=True)
        hit[some[n[of] > 1]] = True
    out = []
    base = np.cumsum(starts) - starts
    for x, n, m in zip(base.tolist(), starts.tolist(), weight.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[x : x + n].astype(np.int8), [0]]))) if m == 1 else np.array([0, n])
        out.append((edge[::2], edge[1::2]))
    return out
