"""Linear suffix sorting by grouping: suffixes are grouped by their longest Lyndon prefix, then every group is ordered.

First phase: suffixes begin in groups by their first symbol, and all positions in one list. Groups are taken in descending
order, and their members leave the list. Where l members of a group stood side by side in it, the position before them (their
previous-smaller pointer) gets their prefix l times behind its own, so it moves into a new group directly above its old one.
The position that follows a member when it leaves is where its Lyndon prefix ends.

Second phase: groups are emitted in ascending order. What follows a member's prefix is a smaller suffix, which has its place
already, and orders the members; where it is a member itself (a prefix that repeats), the members come after those that they
repeat, in their order. Nothing is renamed, and no two suffixes are compared.

Groups of at least MANY members go through numpy, smaller ones through views of the same arrays. Many short texts take their
steps side by side (suffix_arrays): a step takes the next group of every text at once.
"""

from __future__ import annotations

import gc

import numpy as np

MANY = 48
#: Texts that must still have groups for a step of all of them to cost less than their steps one by one.
TOGETHER = 24


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes of text in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    collecting = gc.isenabled()
    gc.disable()  # a few lists a group, none in cycles
    try:
        after, group, taken = _groups(text)
        return _emitted(n, after, group, taken)
    finally:
        if collecting:
            gc.enable()


def _groups(text: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """Where each position's Lyndon prefix ends, its group, and (group, members) in descending order."""
    n, codes = len(text), np.frombuffer(text, np.uint8)
    order = np.argsort(codes, kind="stable")
    symbols, own = np.unique(codes, return_inverse=True)
    members: list = np.split(order, np.cumsum(np.bincount(own))[:-1])
    group = np.append(own, -1).astype(np.int64)
    # neighbours of what is left; the last entries serve the end and the beginning
    before, after = np.arange(-1, n), np.arange(1, n + 2)
    group_at, before_at, after_at = memoryview(group), memoryview(before), memoryview(after)
    below, above = [*range(-1, len(symbols) - 1)], [*range(1, len(symbols)), -1]
    taken: list = []
    now = len(symbols) - 1
    while now >= 0:
        held = members[now]
        members[now] = None
        if len(held) == 1:  # most groups: no runs, and no more than one position that moves
            i = int(held[0])
            mine = [i] if group_at[i] == now else []
            if mine:
                p, q = before_at[i], after_at[i]
                before_at[q], after_at[p] = p, q
                if p >= 0:
                    old, new = group_at[p], len(members)
                    group_at[p] = new
                    members.append([p])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = below[up] = new
        elif len(held) < MANY:
            mine = [i for i in (held if type(held) is list else held.tolist()) if group_at[i] == now]
            moved: dict[tuple[int, int], list[int]] = {}
            last, count = -1, 0  # the position before the members side by side, and how many they are
            for i in mine:
                p, q = before_at[i], after_at[i]
                before_at[q], after_at[p] = p, q
                if p == last:
                    count += 1
                    continue
                if last >= 0:
                    moved.setdefault((count, group_at[last]), []).append(last)
                last, count = p, 1
            if last >= 0:
                moved.setdefault((count, group_at[last]), []).append(last)
            for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                old, to, new = key[1], moved[key], len(members)
                for p in to:
                    group_at[p] = new
                members.append(to)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = below[up] = new
        else:
            held = np.asarray(held)
            mine = held[group[held] == now]
            if len(mine):
                left = before[mine]
                starts = np.flatnonzero(np.concatenate([[True], left[1:] != mine[:-1]]))
                ends = np.append(starts[1:], len(mine))
                p, count = left[starts], ends - starts
                before[mine] = np.repeat(p, count)
                q = after[mine[ends - 1]]
                before[q], after[p] = p, q
                if p[0] < 0:
                    p, count = p[1:], count[1:]
                olds = group[p]
                by = np.lexsort((olds, -count))
                p, count, olds = p[by], count[by], olds[by]
                if len(p):
                    cuts = np.flatnonzero((count[1:] != count[:-1]) | (olds[1:] != olds[:-1])) + 1
                    bounds = [0, *cuts.tolist(), len(p)]
                    group[p] = np.repeat(np.arange(len(members), len(members) + len(bounds) - 1), np.diff(bounds))
                    plain = p.tolist()
                    for a, b, old in zip(bounds, bounds[1:], olds[bounds[:-1]].tolist(), strict=False):
                        new = len(members)
                        members.append(plain[a:b] if b - a < MANY else p[a:b])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = below[up] = new
        if len(mine):
            taken.append((now, mine))
        now = below[now]
    return after, group, taken


def _emitted(n: int, after: np.ndarray, group: np.ndarray, taken: list) -> np.ndarray:
    out, rank = np.empty(n, np.int64), np.full(n + 1, -1)
    out_at, rank_at, after_at, group_at = memoryview(out), memoryview(rank), memoryview(after), memoryview(group)
    at = 0
    for g, mine in reversed(taken):
        m = len(mine)
        if m == 1:
            i = int(mine[0])
            out_at[at] = i
            rank_at[i] = at
            at += 1
            continue
        if m < MANY:
            if type(mine) is not list:
                mine = mine.tolist()
            listed = [(rank_at[after_at[i]], i) for i in mine if group_at[after_at[i]] != g]
            listed.sort()
            order = [i for _, i in listed]
            if len(order) < m:
                _repeating(order, {after_at[i]: i for i in mine if group_at[after_at[i]] == g})
            for i in order:
                out_at[at] = i
                rank_at[i] = at
                at += 1
            continue
        mine = np.asarray(mine)
        ends = after[mine]
        inside = group[ends] == g
        order = mine[~inside]
        order = order[np.argsort(rank[ends[~inside]], kind="stable")]
        if inside.any():
            order = order.tolist()
            _repeating(order, dict(zip(ends[inside].tolist(), mine[inside].tolist(), strict=True)))
        out[at : at + m] = order
        rank[out[at : at + m]] = np.arange(at, at + m)
        at += m
    return out


def _repeating(order: list[int], of: dict[int, int]) -> None:
    """Appends the members whose prefix is followed by a member, in the order of those members."""
    for s in order:  # grows
        i = of.get(s)
        if i is not None:
            order.append(i)


def suffix_arrays(texts: list[bytes]) -> np.ndarray:
    """suffix_array of every text, text after text, as places in the texts laid end to end. Texts longer than all but TOGETHER are
    sorted one by one, the others together."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    limit = int(np.partition(sizes, -TOGETHER)[-TOGETHER]) if len(sizes) >= TOGETHER else 0
    for k in np.flatnonzero(sizes > limit).tolist():
        out[begins[k] : begins[k] + sizes[k]] = suffix_array(texts[k]) + begins[k]
    rest = np.flatnonzero((sizes <= limit) & (sizes > 0))
    if len(rest):
        own = sizes[rest]
        shift = np.repeat(begins[rest] - (np.cumsum(own) - own), own)
        out[np.arange(len(shift)) + shift] = _together([texts[k] for k in rest.tolist()]) + shift
    return out


def _order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by keys, the first one first; none is negative. They and the places are sorted as one number where they fit one."""
    widths, places = [int(k.max()).bit_length() for k in keys], (len(keys[0]) - 1).bit_length()
    if sum(widths) + places > 62:
        return np.lexsort(keys[::-1])
    packed = keys[0].astype(np.int64)
    for k, width in zip(keys[1:], widths[1:], strict=True):
        packed <<= width
        packed |= k
    packed <<= places
    packed |= np.arange(len(packed))
    packed.sort()
    packed &= (1 << places) - 1
    return packed


def _together(texts: list[bytes]) -> np.ndarray:
    """suffix_arrays of texts that aren't empty. Each text has a slot before it, which is also the end of the one before; groups
    are numbered through all texts, and their members stand one after the other in a pool, those that have moved on as well."""
    sizes = np.array([len(t) for t in texts], np.int64)
    heads = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int32)
    n = int(sizes.sum()) + len(texts)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    codes = np.frombuffer(b"".join(b"\0" + t for t in texts), np.uint8)
    inside = np.ones(n, bool)
    inside[heads] = False
    slots = np.flatnonzero(inside).astype(np.int32)
    order = slots[np.argsort(codes[slots], kind="stable")]
    order = order[np.argsort(of[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    total, owner, symbol = len(order), of[order], codes[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
    edge = np.flatnonzero(fresh)
    made, top = len(edge), total
    pool = np.empty(2 * total, np.int32)
    pool[:total] = order
    # first place in the pool, size, and neighbours of every group; a member that leaves moves one other at most
    start, size, below, above = (np.empty(made + total, np.int32) for _ in range(4))
    start[:made], size[:made] = edge, np.diff(edge, append=total)
    below[:made], above[:made] = np.arange(-1, made - 1), np.arange(1, made + 1)
    lowest = np.flatnonzero(np.diff(owner[edge], prepend=-1))
    below[lowest] = -1
    now = np.append(lowest[1:], made) - 1
    group = np.full(n + 1, -1, np.int32)
    group[order] = np.repeat(np.arange(made), size[:made])
    before, after = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    count_up = np.arange(total)
    taken: list = []
    while len(now):
        held = size.take(now)
        stop = np.cumsum(held)
        places = (start.take(now) - stop + held).repeat(held)
        places += count_up[: stop[-1]]
        mine = pool.take(places)
        mine = mine[group.take(mine) == now.repeat(held)]
        if len(mine):
            left = before.take(mine)
            first = np.ones(len(mine), bool)
            first[1:] = left[1:] != mine[:-1]
            starts = np.flatnonzero(first)
            count = np.diff(starts, append=len(mine))
            p, q = left.take(starts), after.take(mine.take(starts + count - 1))
            before[q], after[p] = p, q
            if len(starts) == len(mine):
                taken.append((mine, q, None))
            else:
                taken.append((mine, np.repeat(q, count), np.repeat(starts + count, count) - count_up[: len(mine)]))
            old = group.take(p)
            moves = old >= 0
            if not moves.all():
                p, old, count = p[moves], old[moves], count[moves]
            if len(p):
                whose = of.take(p)
                if (whose[1:] == whose[:-1]).any():
                    by = _order(old, count.max() - count)
                    p, old, count = p.take(by), old.take(by), count.take(by)
                fresh = np.ones(len(p), bool)
                fresh[1:] = (old[1:] != old[:-1]) | (count[1:] != count[:-1])
                edge = np.flatnonzero(fresh)
                new = np.arange(made, made + len(edge))
                many = np.diff(edge, append=len(p))
                group[p] = new.repeat(many)
                pool[top : top + len(p)] = p
                start[made : made + len(edge)], size[made : made + len(edge)] = edge + top, many
                old = old.take(edge)
                differ = old[1:] != old[:-1]
                highest, lowest = np.append(True, differ), np.append(differ, True)
                up = above.take(old)
                below[made : made + len(edge)], above[made : made + len(edge)] = np.where(lowest, old, new + 1), np.where(highest, up, new - 1)
                below[up[highest]], above[old[lowest]] = new[highest], new[lowest]
                made, top = made + len(edge), top + len(p)
        now = below.take(now)
        now = now[now >= 0]
    # the end of a text is smaller than all of its suffixes, and greater than all of the text before it
    rank = np.empty(n + 1, np.int32)
    rank[heads[1:]], rank[n] = heads[:-1], heads[-1]
    place, out = heads + 1, np.empty(n, np.int32)
    for mine, ends, depth in reversed(taken):
        whose = of.take(mine)
        first = np.ones(len(mine), bool)
        first[1:] = whose[1:] != whose[:-1]
        starts = np.flatnonzero(first)
        if len(starts) == len(mine):
            spots = place.take(whose)
            place[whose] = spots + 1
        else:
            # what follows the prefixes orders the members; of those that repeat, the fewer come first
            after_them = rank.take(ends) - heads.take(whose)
            mine = mine.take(_order(whose, after_them) if depth is None else _order(whose, depth, after_them))
            many, whose = np.diff(starts, append=len(mine)), whose[starts]
            spots = np.repeat(place[whose] - starts, many) + np.arange(len(mine))
            place[whose] += many
        out[spots] = mine
        rank[mine] = spots
    return out[inside].astype(np.int64) - of[slots] - 1
