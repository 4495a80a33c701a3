"""Edit distance within a limit, by a band that widens until it decides."""

from __future__ import annotations

import numpy as np

FIRST_BAND = 8


def _core(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences without their common start and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    end = int(differ[0]) if len(differ) else n
    return a[:len(a) - end], b[:len(b) - end]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(where[:len(a)], minlength=len(values))
    right = np.bincount(where[len(a):], minlength=len(values))
    return int(np.minimum(left, right).sum())


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance over alignments that stay within ``band`` of the diagonal.

    Exact where the result is at most ``band``; otherwise the true distance is
    above ``band``.  Column k of a row stands for b's position i + k - band.
    """
    width = 2 * band + 1
    shift = np.arange(width)
    far = len(a) + len(b) + 1
    row = np.where(shift >= band, shift - band, far)
    row[shift - band > len(b)] = far
    padded = np.full(len(a) + len(b) + 2 * width, -1, dtype=np.int64)
    padded[band:band + len(b)] = b
    for i in range(1, len(a) + 1):
        # b's item at column k is number i + k - band, at padded place i + k - 1.
        step = row + (padded[i - 1:i - 1 + width] != a[i - 1])
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        at = shift + (i - band)
        step[(at < 0) | (at > len(b))] = far
        if 0 <= band - i:
            step[band - i] = i
        # Items of b put in: a running minimum along the row.
        row = np.minimum(np.minimum.accumulate(step - shift) + shift, far)
        if row.min() > band:
            return band + 1
    end = len(b) - len(a) + band
    return int(row[end]) if 0 <= end < width else band + 1


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the edit distance of two arrays of whole numbers is at most ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return False
    a, b = _core(a.astype(np.int64, copy=False), b.astype(np.int64, copy=False))
    longest = max(len(a), len(b))
    if longest <= limit or (len(a) == len(b) and int((a != b).sum()) <= limit):
        return True
    if longest - _common(a, b) > limit:
        return False
    band = min(FIRST_BAND, limit)
    if longest <= MOST_BITS:
        # Bit vectors say how wide a band is needed, or that none will do.
        band = edit_distance(a, b)
        if band > limit:
            return False
    while True:
        if banded(a, b, band) <= band:
            return True
        if band >= limit:
            return False
        band = min(band * 4, limit)


# Cells of the tables in which a batch of pairs is compared at once.
TALLY_CELLS = 4_000_000
# Buckets for each place of the longest sequence of a slice of pairs.
TALLY_SHARE = 2


def maybe_within(first: list[np.ndarray], second: list[np.ndarray], limits: np.ndarray, run: int = 3) -> np.ndarray:
    """For many pairs, whether their edit distance can be within the limit; False is certain.

    An edit changes at most ``run`` of the windows of ``run`` items on each side, so
    the multisets of windows differ by at most 2 x ``run`` x limit.  Windows are
    hashed into a table as wide as the sequences are long; what falls together
    there only makes sequences look more alike.
    """
    sizes = np.array([max(len(a), len(b)) for a, b in zip(first, second)], np.int64)
    out = np.ones(len(sizes), dtype=bool)
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        # Pairs of like length in one table.
        stop, width = start, 64
        while stop < len(order):
            wide = max(64, int(sizes[order[stop]]) * TALLY_SHARE)
            if stop > start and (stop + 1 - start) * wide > TALLY_CELLS:
                break
            stop, width = stop + 1, wide
        chosen = order[start:stop]
        table = np.zeros(len(chosen) * width, np.int64)
        for sign, side in ((1, first), (-1, second)):
            rows = [side[i] for i in chosen]
            flat = np.concatenate(rows).astype(np.uint64) if rows else np.empty(0, np.uint64)
            lengths = np.array([len(x) for x in rows], np.int64)
            where = np.repeat(np.arange(len(rows)), lengths)
            if len(flat) < run:
                continue
            codes = np.zeros(len(flat) - run + 1, np.uint64)
            for j in range(run):
                codes = codes * np.uint64(0x9E3779B97F4A7C15) + flat[j:len(flat) - run + 1 + j]
            inside = where[:len(codes)] == where[run - 1:]
            codes = (codes[inside] ^ (codes[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            cells = where[:len(inside)][inside] * width + ((codes >> np.uint64(33)) % np.uint64(width)).astype(np.int64)
            table += sign * np.bincount(cells, minlength=len(table))
        apart = np.abs(table).reshape(len(chosen), width).sum(axis=1)
        out[chosen] = apart <= 2 * run * limits[chosen]
        start = stop
    return out


# Longer cores are aligned in a band: the bit vectors of all rows would cost more.
MOST_BITS = 50_000


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance by bit vectors: a column of the table is two whole numbers of ``len(a)`` bits."""
    if not len(a):
        return len(b)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    up, down, distance = full, 0, len(a)
    for y in b.tolist():
        same = where.get(y, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & last:
            distance += 1
        elif minus & last:
            distance -= 1
        plus = (plus << 1 | 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return distance


def within_limit(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """As ``within``, faster where the sequences differ in many places."""
    if abs(len(a) - len(b)) > limit:
        return False
    x, y = _core(a, b)
    if max(len(x), len(y)) > MOST_BITS:
        return within(a, b, limit)
    return max(len(x), len(y)) <= limit or (
        len(x) == len(y) and int((x != y).sum()) <= limit) or edit_distance(x, y) <= limit


# Longer sequences are asked one by one; at once at most so many cells of an anti-diagonal, and items of one side.
MOST_TOGETHER = 2_500
DIAGONAL_CELLS = 1 << 15
ITEMS_TOGETHER = 1 << 20
# Anti-diagonals after which pairs that cannot come within their limit leave.
DIAGONALS = 32


def within_each(first: list[np.ndarray], second: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """For many pairs, whether their edit distance is at most the limit: ``within_limit`` for pairs side by side."""
    limits = np.asarray(limits, np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(first, second)], np.int64).reshape(-1, 2)
    longest, apart = sizes.max(axis=1, initial=0), abs(sizes[:, 0] - sizes[:, 1])
    out = longest <= limits
    open_ = (apart <= limits) & ~out
    alone = np.flatnonzero(open_ & (longest > MOST_TOGETHER))
    near = maybe_within([first[i] for i in alone], [second[i] for i in alone], limits[alone])
    for i in alone[near]:
        out[i] = within_limit(first[i], second[i], int(limits[i]))
    # Pairs of like limits and lengths in one slice.
    todo = np.flatnonzero(open_ & (longest <= MOST_TOGETHER))
    todo = todo[np.lexsort((longest[todo], limits[todo]))]
    start = 0
    while start < len(todo):
        chosen = todo[start:start + max(16, DIAGONAL_CELLS // (int(limits[todo[start]]) // 2 + 2))]
        items = np.maximum.accumulate(longest[chosen]) * np.arange(1, len(chosen) + 1)
        fits = (items <= ITEMS_TOGETHER) & (limits[chosen] <= 2 * limits[chosen[0]] + 16) & (
            longest[chosen] <= 2 * longest[chosen[0]] + 64)
        chosen = chosen[:max(1, len(chosen) if fits.all() else int(fits.argmin()))]
        start += len(chosen)
        turned = sizes[chosen, 0] > sizes[chosen, 1]
        out[chosen] = _cores_within(
            [second[i] if t else first[i] for i, t in zip(chosen, turned)],
            [first[i] if t else second[i] for i, t in zip(chosen, turned)], limits[chosen])
    return out


def _cores_within(x: list[np.ndarray], y: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    """``within_each`` for a slice of pairs, no x longer than its y: common starts and ends go, diagonals decide."""
    n, m = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    items = np.concatenate([*x, *y])
    if items.max(initial=0) > 65_000 or items.min(initial=0) < 0:
        items = np.unique(items, return_inverse=True)[1]
    # Two numbers stay free for what lies beyond the ends; one item more, so that any place can be read.
    kind = np.uint8 if items.max(initial=0) < 254 else np.uint16 if items.max(initial=0) < 65_534 else np.uint32
    items = np.append(items, 0).astype(kind)
    x_at, y_at = np.cumsum(n) - n, n.sum() + np.cumsum(m) - m
    place = np.arange(n.max(initial=0))

    def same(x_place: np.ndarray, y_place: np.ndarray) -> np.ndarray:
        differ = (items.take(x_place, mode="clip") != items.take(y_place, mode="clip")) | (place >= n[:, None])
        return np.where(differ.any(axis=1), differ.argmax(axis=1), n) if len(place) else n

    head = same(x_at[:, None] + place, y_at[:, None] + place)
    tail = np.minimum(same((x_at + n)[:, None] - 1 - place, (y_at + m)[:, None] - 1 - place), n - head)
    n, m, x_at, y_at = n - head - tail, m - head - tail, x_at + head, y_at + head
    out = m <= limits
    left = np.flatnonzero(~out)
    if len(left):
        out[left] = _diagonals(items, x_at[left], y_at[left], n[left], m[left], limits[left])
    return out


def _diagonals(items: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, n: np.ndarray, m: np.ndarray,
               limits: np.ndarray) -> np.ndarray:
    """The tables of all pairs, one anti-diagonal after the other; a column is a pair.

    An alignment within the limit leaves the diagonals between (0, 0) and (n, m)
    by half of the edits that the difference in length does not need, so only
    those are kept.  Cell (i, s - i) of anti-diagonal s stands in row i - first
    + 1; what lies outside the table or these diagonals is ``far``.
    """
    gap, total = m - n, n + m
    low, high, last = int(((limits - gap) // 2).max()), int(((limits + gap) // 2).max()), int(total.max())
    reach, kind = (low + high) // 2 + 4, items.dtype
    cell, far = (np.int16, 16_000) if last + high + 8 < 16_000 else (np.int32, 1 << 30)

    def side(start: np.ndarray, size: np.ndarray, place: np.ndarray, beyond: int) -> np.ndarray:
        inside = (place >= 0) & (place < size)
        return np.where(inside, items.take(start + place, mode="clip"), np.array(np.iinfo(kind).max - beyond, kind))

    # The second sequences from their end: along an anti-diagonal both are read upwards.
    a = side(x_at, n, np.arange(-reach, int(n.max()) + reach)[:, None], 0)
    back = int(m.max()) + reach
    b = side(y_at, m, back - np.arange(back + reach)[:, None], 1)
    old, now, new = (np.full((reach + 2, len(n)), far, cell) for _ in range(3))
    flags = np.empty(now.shape, bool)
    ids, out = np.arange(len(n)), np.zeros(len(n), dtype=bool)
    before = (1 - high) // 2
    now[1 - before] = 0
    s, soon = 0, int(total.min())
    while s < last:
        s += 1
        first = (s - high + 1) // 2
        count, shift, at = (s + low) // 2 - first + 1, first - before, back - (s - first - 1)
        mine, step, differ = new[1:count + 1], old[1:count + 1], flags[:count]
        np.minimum(now[shift:shift + count], now[shift + 1:shift + 1 + count], out=mine)
        mine += 1
        np.not_equal(a[first - 1 + reach:first - 1 + reach + count], b[at:at + count], out=differ)
        step += differ
        np.minimum(mine, step, out=mine)
        new[count + 1] = far
        old, now, new = now, new, old
        if s == soon:
            done = np.flatnonzero(total == s)
            out[ids[done]] = now[n[done] - first + 1, done] <= limits[done]
            soon = int(total.min(where=total > s, initial=last + 1))
        if s % DIAGONALS == 0 and s < last:
            # Every way on passes one of the last two anti-diagonals, and must still reach the last diagonal.
            least = np.full(len(ids), far)
            for cells, t, lowest in ((now, s, first), (old, s - 1, before)):
                size = (t + low) // 2 - lowest + 1
                away = abs((t - 2 * np.arange(lowest, lowest + size))[:, None] - gap)
                least = np.minimum(least, (cells[1:size + 1] + away).min(axis=0, initial=far))
            left = np.flatnonzero((least <= limits) & (total > s))
            if not len(left):
                break
            if 4 * len(left) < 3 * len(ids):
                ids, n, total, limits, gap = ids[left], n[left], total[left], limits[left], gap[left]
                a, b, old, now = (v.take(left, axis=1) for v in (a, b, old, now))
                new, flags = np.full_like(now, far), np.empty(now.shape, bool)
                last, soon = int(total.max()), int(total.min())
        before = first
    return out
