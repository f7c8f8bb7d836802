"""Edit distances and the scores made of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edits(hyp: Column, ref: Column) -> Column:
    """Character edit distance of texts of any length, exact, in memory that grows with their length only; null if one is.

    Equal texts need no table. The others of an Arrow batch are made together.
    """
    # a Python function is called for every row, so it gets nulls where it has nothing to do
    differ = lambda c: F.when(hyp != ref, c)
    return F.when(hyp == ref, F.lit(0)).otherwise(_edits()(differ(hyp), differ(ref)))


#: The same under the name that callers of whole texts use.
edits_of_any_length = edits

#: Characters of the shorter text up to which many pairs are made at once.
WHOLE_CHARS = 512
#: Bytes of the tables of letters of the pairs that are made at once; they stay in the processor's cache.
LETTER_BYTES = 1 << 21


@lru_cache
def _edits():
    @F.pandas_udf("int")
    def made(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        work = np.flatnonzero((hyp.notna() & ref.notna()).to_numpy())
        out = np.full(len(hyp), -1, np.int64)
        out[work] = distances(hyp.to_numpy()[work], ref.to_numpy()[work])
        return pd.Series(out, dtype="Int32").where(out >= 0)

    return made


def distances(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """The edit distances of many pairs: bits of a column of the table at once (Myers, Hyyrö), pair beside pair; long pairs one by one.

    Pairs whose distance two bounds settle need no table.
    """
    out = settled(left, right)
    rest = np.flatnonzero(out < 0)
    if len(rest):
        out[rest] = _by_tables([left[i] for i in rest], [right[i] for i in rest])
    return out


#: Cells of the codes of pairs that are looked at together for their bounds.
BOUND_CELLS = 1 << 19


def settled(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """The distances that bounds tell, -1 for the others.

    Texts of one length are at most as far apart as the places where they differ, and at least as far as the letters that one
    has more often than the other. A text that is left when letters of a longer one are taken out is as far as these are many.
    """
    n = len(left)
    out = np.full(n, -1, np.int64)
    size = np.array([list(map(len, left)), list(map(len, right))], np.int64).reshape(2, n)
    short, long = size.min(axis=0), size.max(axis=0)
    order = np.argsort(long, kind="stable")
    for wanted in (short == long, short < long):
        work = order[wanted[order] & (long[order] <= BOUND_CELLS >> 6)]
        while len(work):
            fit = int((np.arange(1, len(work) + 1) * long[work] <= BOUND_CELLS).argmin()) or len(work)  # one fits always
            some, work = work[:fit], work[fit:]
            if short[some[0]] == long[some[0]]:
                out[some] = _by_places(_codes([left[i] for i in some]), _codes([right[i] for i in some]), long[some])
            else:
                turned = size[0, some] > size[1, some]
                a = [right[i] if t else left[i] for i, t in zip(some.tolist(), turned.tolist(), strict=True)]
                b = [left[i] if t else right[i] for i, t in zip(some.tolist(), turned.tolist(), strict=True)]
                out[some] = np.where(_left_over(a, b, short[some]), (long - short)[some], -1)
    return out


def _by_places(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distances of texts of one length that as many letters must be replaced in as places differ, else -1."""
    differ = x != y
    most = differ.sum(axis=1)
    few = most <= size // 2  # letters of more places seldom all differ, and cost more to count
    row, at = np.nonzero(differ & few[:, None])
    keys = np.concatenate([row << 32 | x[row, at], row << 32 | y[row, at]])
    each, which = np.unique(keys, return_inverse=True)
    more = np.bincount(which[: len(row)], minlength=len(each)) - np.bincount(which[len(row) :], minlength=len(each))
    least = np.bincount(each >> 32, np.maximum(more, 0), minlength=len(x)).astype(np.int64)
    return np.where(few & (least == most), most, -1)


def _left_over(short: list[str], long: list[str], size: np.ndarray) -> np.ndarray:
    """Whether each short text is left when letters are taken out of the long one beside it."""
    y = _codes(long, filler=-2)
    x = np.column_stack([_codes(short, filler=-1), np.full(len(short), -1, np.int32)])
    start = np.arange(len(short)) * x.shape[1]
    at, flat = start.copy(), x.ravel()
    for column in np.ascontiguousarray(y.T):
        at += flat[at] == column
    return at - start == size


def _by_tables(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    out = np.zeros(len(left), np.int64)
    ends = lambda a, b: _without_ends(a, b) if min(len(a), len(b)) > 32 and (a[0] == b[0] or a[-1] == b[-1]) else (a, b)
    pairs = [sorted(ends(a, b), key=len) for a, b in zip(left, right, strict=True)]
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    bare = size[:, 0] == 0
    out[bare] = size[bare, 1]
    for i in np.flatnonzero(size[:, 0] > WHOLE_CHARS):
        out[i] = long_distance(*pairs[i])
    words = (size[:, 0] + 63) // 64
    for w in np.unique(words[~bare & (size[:, 0] <= WHOLE_CHARS)]):
        work = np.flatnonzero(words == w)
        work = work[np.argsort(-size[work, 1], kind="stable")]  # those that end first come last
        start, some = 0, 4096
        while start < len(work):
            own = work[start : start + some]
            x, y = _codes([pairs[i][0] for i in own]), _codes([pairs[i][1] for i in own])
            letters = np.unique(x)
            fit = max(1, LETTER_BYTES // (8 * int(w) * (len(letters) + 1)))
            own = own[:fit]
            out[own] = _columns(x[:fit], y[:fit], size[own], letters, int(w))
            start += len(own)
    return out


def _columns(x: np.ndarray, y: np.ndarray, size: np.ndarray, letters: np.ndarray, words: int) -> np.ndarray:
    """Distances of pairs in falling order of their second lengths; ``words`` of 64 bits hold the steps down a column."""
    n, one, top = len(x), np.uint64(1), np.uint64(63)
    kinds = len(letters) + 1  # the last is for letters that no first text has
    rows = np.arange(n) * kinds
    same = np.zeros((words, n * kinds), np.uint64)
    for i in range(x.shape[1]):
        has = np.flatnonzero(size[:, 0] > i)
        same[i >> 6, rows[has] + np.searchsorted(letters, x[has, i])] |= np.uint64(1 << (i & 63))
    place = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
    place = np.where(letters[place] == y, place, len(letters)) + rows[:, None]
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    live = (size[:, 1][None, :] > np.arange(y.shape[1])[:, None]).sum(axis=1)
    for j, k in enumerate(live):
        at = place[:k, j]
        more, less = np.ones(k, np.uint64), np.zeros(k, np.uint64)  # what comes in from the word above
        for w in range(words):
            pv, mv, eq = up[w, :k], down[w, :k], same[w, at]
            xv = eq | mv
            eq = eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            out_more, out_less = ph >> top, mh >> top
            ph, mh = (ph << one) | more, (mh << one) | less
            up[w, :k], down[w, :k] = mh | ~(xv | ph), ph & xv
            more, less = out_more, out_less
    bits = np.clip(size[:, 0][None, :] - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    mask = ~np.uint64(0) >> (np.uint64(64) - np.maximum(bits, one))
    mask = np.where(bits > 0, mask, np.uint64(0))
    return size[:, 1] + np.bitwise_count(up & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & mask).sum(axis=0, dtype=np.int64)


def _without_ends(a: str, b: str) -> tuple[str, str]:
    """Both texts without their common beginning and end."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    n = min(len(x), len(y))
    same = np.flatnonzero(x[:n] != y[:n])
    head = int(same[0]) if len(same) else n
    n -= head
    same = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    return a[head : len(a) - tail], b[head : len(b) - tail]


def long_distance(a: str, b: str) -> int:
    """The edit distance of two texts of any length.

    Common ends are cut off. Near texts follow the farthest places that each number of edits reaches (Ukkonen), which costs
    the square of the distance; where that would cost more than all columns by their bits, these are made.
    """
    a, b = _without_ends(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    most = int((2 * len(b) * (1 + len(a) / 5000)) ** 0.5)
    found = _farthest(a, b, most) if len(b) - len(a) <= most else None
    return _by_bits(a, b) if found is None else found


def _farthest(a: str, b: str, most: int) -> int | None:
    """The distance if it is at most ``most``: for each diagonal the farthest row that so many edits reach."""
    n, m = len(a), len(b)
    goal = m - n

    def run(i: int, j: int) -> int:
        """The row where the equal run from here ends."""
        step = 1
        while a[i : i + step] == b[j : j + step] and i < n and j < m:
            if i + step > n or j + step > m:
                step = min(n - i, m - j)
                if a[i : i + step] == b[j : j + step]:
                    return i + step
                break
            i, j, step = i + step, j + step, 2 * step
        while step > 1:
            step = (step + 1) // 2
            if i + step <= n and j + step <= m and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i

    none = -2
    reach = {0: run(0, 0)}
    if goal == 0 and reach[0] == n:
        return 0
    for d in range(1, most + 1):
        now = {}
        for k in range(-d, d + 1):
            i = max(reach.get(k, none) + 1, reach.get(k - 1, none), reach.get(k + 1, none) + 1)
            if i > n:
                i = n
            if i + k > m:
                i = m - k
            if i < 0 or i + k < 0:
                continue
            if i < n and i + k < m and a[i] == b[i + k]:
                i = run(i, i + k)
            now[k] = i
        if now.get(goal) == n:
            return d
        reach = now
    return None


def _by_bits(a: str, b: str) -> int:
    """The distance by the columns of the table, each held in the bits of two whole numbers."""
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = {chr(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    mask = (1 << len(a)) - 1
    up, down = mask, 0
    for c in b:
        eq = same.get(c, 0)
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & mask
        more, less = ((down | (mask ^ (xh | up))) << 1 | 1) & mask, ((up & xh) << 1) & mask
        up, down = less | (mask ^ (xv | more)), more & xv
    return len(b) + up.bit_count() - down.bit_count()


def edits_within(hyp: Column, ref: Column, most: Column) -> Column:
    """The distance if it doesn't exceed ``most``, else -1; only that band of the table is made."""
    return F.when(hyp == ref, F.lit(0)).when(F.abs(F.length(hyp) - F.length(ref)) > most, F.lit(-1)).otherwise(F.call_function("levenshtein", hyp, ref, most))


def cer(hyp: Column, ref: Column) -> Column:
    """Edits for each reference character; it may exceed 1."""
    return edits(hyp, ref) / F.greatest(F.lit(1), F.length(ref))


def string_anls(pred: Column, gt: Column, threshold: float = 0.5) -> Column:
    """1 - edits / longer length, 0 below the threshold; two empty texts are equal.

    Texts whose lengths alone put them below the threshold have no distance made.
    """
    longest = F.greatest(F.length(pred), F.length(gt))
    near = F.least(F.length(pred), F.length(gt)) >= threshold * longest
    share = 1 - edits(F.when(near, pred), F.when(near, gt)) / longest
    return (
        F.when((F.length(pred) == 0) & (F.length(gt) == 0), F.lit(1.0))
        .when((F.length(pred) == 0) | (F.length(gt) == 0), F.lit(0.0))
        .otherwise(F.when(share >= threshold, share).otherwise(0.0))
    )


def alignment(ref: str, hyp: str) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of one cheapest alignment, substitutions preferred, then deletions."""
    return tuple(int(n[0]) for n in alignments([ref], [hyp]))


#: Cells of a row of all tables that are made at once; they stay in the processor's cache.
CELLS = 1 << 17


def alignments(refs: Sequence[str], hyps: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many pairs, as three arrays.

    Common ends are cut off: no cheapest alignment of these rules leaves their diagonal. Texts of one length whose distance is
    the number of places where they differ have substitutions only. Tables of the other pairs are filled together, those of
    similar lengths, row after row. A cell holds its distance and the
    substitutions on the way there; with both lengths these give the other two, so no table is kept and none is walked
    back. Repeated pairs are made once.
    """
    pairs: dict[tuple[str, str], int] = {}
    at = np.array([pairs.setdefault(p, len(pairs)) for p in zip(refs, hyps, strict=True)], np.int64)
    lengths = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    total, swapped = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    texts = [_without_ends(a, b) if a != b else ("", "") for a, b in pairs]
    apart = lengths[:, 0] - lengths[:, 1]
    lengths = np.array([(len(a), len(b)) for a, b in texts], np.int64).reshape(-1, 2)
    bare = lengths.min(axis=1) == 0
    total[bare] = lengths[bare].max(axis=1)
    even = np.flatnonzero(~bare & (lengths[:, 0] == lengths[:, 1]))
    unlike = np.array([(_codes([texts[i][0]]) != _codes([texts[i][1]])).sum() for i in even], np.int64)
    plain = even[distances([texts[i][0] for i in even], [texts[i][1] for i in even]) == unlike]
    total[plain] = swapped[plain] = unlike[np.isin(even, plain)]
    done = bare.copy()
    done[plain] = True
    for size in range(int(lengths[:, 0].max(initial=0)).bit_length() + 1):  # first texts of at most twice the length
        work = np.flatnonzero(~done & (lengths[:, 0] >= 1 << size >> 1) & (lengths[:, 0] < 1 << size))
        work = work[np.argsort(lengths[work, 1], kind="stable")]
        while len(work):
            # the last pair of a group has the longest second text
            some = work[: CELLS // (lengths[work[0], 1] + 1) + 1]
            fit = int((np.arange(1, len(some) + 1) <= CELLS // (lengths[some, 1] + 1)).sum())
            some, work = some[: max(1, fit)], work[max(1, fit) :]
            total[some], swapped[some] = _tables([texts[i] for i in some])
    deleted, added = (total - swapped + apart) // 2, (total - swapped - apart) // 2
    return swapped[at], deleted[at], added[at]


def _codes(texts: list[str], filler: int = 0) -> np.ndarray:
    """Code points, a row for each text, filled up with zeros (or another number that is none)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(size.max(initial=0))), filler, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _tables(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(distances, substitutions) of pairs; one row of each table at a time."""
    ref, hyp = _codes([a for a, _ in pairs]), _codes([b for _, b in pairs])
    n, m = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    kind = np.int16 if max(n.max(), m.max()) < 1 << 14 else np.int32
    place = np.arange(hyp.shape[1] + 1, dtype=kind)
    before, subs = np.tile(place, (len(pairs), 1)), np.zeros((len(pairs), len(place)), kind)
    total, swapped = m.copy(), np.zeros(len(pairs), np.int64)  # of empty first texts
    rows = (np.arange(len(pairs)) * len(place))[:, None]
    for i in range(1, ref.shape[1] + 1):
        differs = (hyp != ref[:, i - 1 : i]).astype(kind)
        best, above = np.empty_like(before), before + kind(1)
        diagonal = before[:, :-1] + differs
        best[:, 0] = i
        np.minimum(above[:, 1:], diagonal, out=best[:, 1:])
        # insertions: the running minimum of what is left of the cell
        now = np.minimum.accumulate(best - place, axis=1) + place
        straight = now[:, 1:] == diagonal
        own = np.empty_like(subs)
        own[:, 0] = 0
        own[:, 1:] = np.where(straight, subs[:, :-1] + differs, subs[:, 1:])
        # a cell reached by an insertion counts what the last other cell on its left does
        other = np.empty(now.shape, bool)
        other[:, 0] = True
        other[:, 1:] = straight | (now[:, 1:] == above[:, 1:])
        source = np.maximum.accumulate(np.where(other, place, 0), axis=1)
        before, subs = now, own.ravel()[source + rows]
        ends = np.flatnonzero(n == i)
        total[ends], swapped[ends] = now[ends, m[ends]], subs[ends, m[ends]]
    return total, swapped


def edit_ops(ref: Column, hyp: Column) -> Column:
    """struct(substitutions, deletions, insertions); the built-in distance has only their sum. A null counts as an empty text."""

    @F.pandas_udf("substitutions long, deletions long, insertions long")
    def ops(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        made = alignments([x or "" for x in a], [x or "" for x in b])
        return pd.DataFrame(dict(zip(("substitutions", "deletions", "insertions"), made, strict=True)))

    return ops(ref, hyp)


def best_matching(score: np.ndarray) -> float:
    """Largest sum of a one-to-one matching of rows and columns (shortest augmenting paths)."""
    if score.shape[0] > score.shape[1]:
        score = score.T
    n, m = score.shape
    best = score.argmax(axis=1)
    if len(set(best.tolist())) == n:  # each row can have its best column
        return float(score[np.arange(n), best].sum())
    cost = np.zeros((n + 1, m + 1))
    cost[1:, 1:] = -score
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0] - u[i0] - v
            better = ~used & (now < least)
            least[better], way[better] = now[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            step = free[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return float(sum(score[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


def matching_by_parts(score: np.ndarray) -> float:
    """The same sum, each connected part of the positive scores matched on its own.

    Equal items aren't paired off first: the normalised distance keeps no triangle rule, so an equal pair may cost two
    good ones (``ab aba`` against ``aba ba``).
    """
    left, right = np.nonzero(score > 0)
    if not len(left):
        return 0.0
    n = score.shape[0]
    label = np.arange(n + score.shape[1])
    while True:  # the smallest neighbour's label, until nothing changes
        least = np.minimum(label[left], label[right + n])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right + n, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = 0.0
    for part in np.unique(label[left]):
        own = label == part
        out += best_matching(score[np.ix_(own[:n], own[n:])])
    return out


def list_anls(pred: Column, gt: Column, threshold: float = 0.5) -> Column:
    """ANLS of two lists of texts: the best one-to-one matching over the longer length; two empty lists are equal.

    The distances of all pairs of items of an Arrow batch are made together, each different pair once; pairs whose lengths
    alone put them below the threshold have none.
    """

    @F.pandas_udf("double")
    def assign(p: pd.Series, g: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        ids = lambda side: [] if side is None else [known.setdefault(x or "", len(known)) for x in side]
        rows = [(ids(a), ids(b)) for a, b in zip(p, g, strict=True)]
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (a, b) in enumerate(rows):
            shapes.setdefault((len(a), len(b)), []).append(i)
        texts = list(known)
        out = np.zeros(len(rows))
        for (n, m), own in shapes.items():
            if not n or not m:
                out[own] = float(n == m)
                continue
            for at in range(0, len(own), max(1, PAIRS // (n * m))):
                some = np.array(own[at : at + max(1, PAIRS // (n * m))])
                left, right = (np.array([rows[i][side] for i in some], np.int64) for side in (0, 1))
                if n == m:
                    equal = (np.sort(left, axis=1) == np.sort(right, axis=1)).all(axis=1)
                    out[some[equal]] = 1.0
                    some, left, right = some[~equal], left[~equal], right[~equal]
                if len(some):
                    out[some] = best_matchings(_item_scores(left, right, texts, threshold)) / max(n, m)
        return pd.Series(out, dtype="float64")

    return assign(pred, gt)


#: Pairs of items that are scored at once.
PAIRS = 1 << 18
#: Columns of a matching up to which all sets of them are tried.
SETS = 8


def _item_scores(left: np.ndarray, right: np.ndarray, texts: list[str], threshold: float) -> np.ndarray:
    """(list, left item, right item): scores of items given by number; each different pair is made once."""
    pairs, at = np.unique(left[:, :, None] * len(texts) + right[:, None, :], return_inverse=True)
    a, b = pairs // len(texts), pairs % len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    long, short = np.maximum(length[a], length[b]), np.minimum(length[a], length[b])
    score = (a == b).astype(float)
    wanted = np.flatnonzero((a != b) & (short > 0) & (short >= threshold * long))
    s = 1 - distances([texts[i] for i in a[wanted]], [texts[i] for i in b[wanted]]) / long[wanted]
    score[wanted] = np.where(s >= threshold, s, 0.0)
    return score[at.reshape(len(left), left.shape[1], right.shape[1])]


def best_matchings(score: np.ndarray) -> np.ndarray:
    """The largest sum of a one-to-one matching in each of many tables (table, row, column) of scores that aren't negative."""
    if score.shape[1] > score.shape[2]:
        score = score.transpose(0, 2, 1)
    _, n, m = score.shape
    out = score.max(axis=2).sum(axis=1)
    # each row that scores at all can have its best column
    best = np.where(score.max(axis=2) > 0, score.argmax(axis=2), m + np.arange(n))
    left = np.flatnonzero((np.diff(np.sort(best, axis=1), axis=1) == 0).any(axis=1))
    if m > SETS:
        out[left] = [matching_by_parts(score[i]) for i in left]
        return out
    # the largest sum of the rows so far that takes no other columns than those of each set
    sums, sets = np.zeros((len(left), 1 << m)), np.arange(1 << m)
    for i in range(n):
        now = sums.copy()
        for j in range(m):
            with_j = sets[sets >> j & 1 == 1]
            now[:, with_j] = np.maximum(now[:, with_j], sums[:, with_j ^ (1 << j)] + score[left, i, j][:, None])
        sums = now
    out[left] = sums[:, -1]
    return out
