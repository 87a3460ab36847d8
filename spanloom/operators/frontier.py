"""Where greedy caches end, without their entries.

A greedy cache takes windows by (-parent's count, parent's depth, parent's rank, -count, rank). All
windows of one class, a parent's count and a depth, cost the same, so the number of windows in each
class says how many entries fit a budget, and one key of that order which they are. The classes are
counted over the ranges of the suffix order. A window that lies in several ranges touches an end of
each, so what the ranges say of their ends is put together; only windows of up to `head` tokens can.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat
from spanloom.operators import suffixes
from spanloom.operators.suffixes import column, packed, unpacked
from spanloom.session import materialize


@dataclass
class Cut:
    """The first window that a greedy cache of a budget doesn't hold, in the order above; None where
    it holds all."""

    count: int
    depth: int
    up: int
    cnt: int
    lo: int


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range: the place of each row, the first of its group, the tokens that it has in common
    with the row before it, and its tokens, both inside the document."""
    get = lambda c, k: unpacked(batch.column(batch.schema.get_field_index(c))[i].as_py(), k)
    same, room = get("same", "<i2"), get("room", "<i2")
    at, lo = (get("at", "<i8"), get("lo", "<i8")) if "lo" in batch.schema.names else (np.arange(len(same)), np.zeros(len(same), dtype=np.int64))
    return at, lo, np.minimum(same, room), room


def _families(lo: np.ndarray, agree: np.ndarray, room: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of j tokens and their parents of j - 1: the parents' first rows, whether these are
    whole, and the windows' first rows."""
    first = np.ones(len(lo), dtype=bool)
    first[1:] = lo[1:] != lo[:-1]
    parents = np.flatnonzero(first | (agree < j - 1))
    return parents, room[parents] >= j - 1, np.flatnonzero((first | (agree < j)) & (room >= j))


def _ends(rows: DataFrame) -> list:
    return sorted(rows.select("part", "n", "first", "last").collect())  # one for each range


class Frontier:
    """The classes of the windows of docs, as far as greedy caches of these floors come to them under
    the budgets and under the sizes of all windows of up to each of depths. levels: the number of
    distinct windows of each depth up to head."""

    def __init__(self, docs: DataFrame, fmt: TokenFormat, floors: tuple[int, ...], depths: tuple[int, ...], budgets: list[int]):
        self.fmt, self.floors = fmt, floors
        self.text = suffixes.document_blocks(docs, fmt, max(suffixes.HEAD, *floors, *depths))
        self.head = self.text.head
        self.rows = suffixes.ranges(self.text)
        ends = _ends(self.rows)
        self.parts = [e.part for e in ends]
        self.before = dict(zip(self.parts, np.cumsum([0, *(e.n for e in ends)]).tolist()))
        self.ranks = sum(e.n for e in ends)
        self.meets = [self._common(a.last, b.first) for a, b in zip(ends, ends[1:])]
        self.classes: Counter = Counter()
        self.found: dict[tuple[int, int, int], Cut] = {}
        self.counted: dict[int, DataFrame] = {}  # what the ranges say, by the depth that a round begins at
        self.levels = [0] * (self.head + 1)
        self.rounds = [(0, self.head, self.rows)]
        said = self._count(self.rows, 0, self.head, 2)
        for j in range(1, self.head + 1):
            self.levels[j] = sum(said[p][1][j] for p in self.parts) - sum(m >= j for m in self.meets)
            for _, u, n, _ in self._joined(j, {p: said[p][0][j] for p in self.parts}):
                self.classes[u, j] += n
        self.budgets = sorted({*budgets, *(sum(self.levels[d] * fmt.entry_bytes(d) for d in range(1, depth + 1)) for depth in depths)})
        self.max_bytes = self.budgets[-1]
        rows, depth, full, left = self.rows, self.head, self.head, 1
        while left:
            least = self._least()
            step = min(suffixes.AHEAD, suffixes.STEP if depth == self.head else 2 * full)
            rows = suffixes.further(self.text, rows, depth, full, step, least=least)
            self.rounds.append((depth, step, rows))
            left = sum(x[2] for x in self._count(rows, depth, step, least).values())
            full, depth = step, depth + step

    def _common(self, a: bytes, b: bytes) -> int:
        """Tokens that two heads have in common before a separator or the end of the stream."""
        x, y = (np.frombuffer(t, dtype=">u8").astype(np.uint64) for t in (a, b))
        alike = (x == y) & (x != 0) & (x != np.uint64((1 << self.text.bits) - 1))
        return int(np.argmin(np.append(alike, False)))

    def _count(self, rows: DataFrame, depth: int, step: int, least: int) -> dict:
        """Adds the classes of a round to the classes; {range: (ends by depth, windows by depth,
        suffixes that are left)}. The windows at the ends of a range of the first round aren't added."""
        edged = depth == 0

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, part in enumerate(column(batch, "part")):
                    _, lo, agree, room = _arrays(batch, i)
                    left = len(suffixes.members(lo, agree, step, least)[0])
                    us, js, ns, ends, sizes = [], [], [], [], []
                    for j in range(1, step + 1):
                        parents, whole, kids = _families(lo, agree, room, j)
                        u = np.diff(np.append(parents, len(lo)))
                        n = np.diff(np.append(np.searchsorted(kids, parents), len(kids)))
                        sizes.append(len(kids))
                        if edged:
                            for k in (0, len(parents) - 1):
                                ends += [int(parents[k]), int(u[k]), int(n[k]), int(whole[k]), len(parents)]
                            whole[[0, -1]] = False
                        ok = whole & (u >= least) & (n > 0)
                        each = np.bincount(u[ok], weights=n[ok]).astype(np.int64)
                        us.append(np.flatnonzero(each))
                        js.append(np.full(len(us[-1]), depth + j))
                        ns.append(each[us[-1]])
                    cat = lambda x: packed(np.concatenate([np.asarray(y, dtype=np.int64) for y in x]))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([left], pa.int64()), *(pa.array([x], pa.binary()) for x in (cat(us), cat(js), cat(ns), cat([ends]), cat([sizes])))], names=["part", "left", "u", "j", "n", "ends", "sizes"])

        out = {}
        self.counted[depth] = materialize(rows.mapInArrow(count, "part bigint, left bigint, u binary, j binary, n binary, ends binary, sizes binary"))
        for r in self.counted[depth].collect():
            for u, j, n in zip(*(unpacked(x, "<i8").tolist() for x in (r.u, r.j, r.n))):
                self.classes[u, j] += n
            ends = unpacked(r.ends, "<i8").reshape(-1, 2, 5).tolist()
            out[r.part] = ([None, *ends], [0, *unpacked(r.sizes, "<i8").tolist()], r.left)
        return out

    def _joined(self, j: int, ends: dict) -> Iterator[tuple[int, int, int, list[int]]]:
        """(rank, count, children, ranges) of each parent of j - 1 tokens that touches a range's end."""
        open_, before = None, None
        for i, part in enumerate(self.parts):
            meet = self.meets[i - 1] if i else -1
            (at, u, n, whole, _), last = ends[part]
            if open_ and meet >= j - 1:
                open_ = [open_[0], open_[1] + u, open_[2] + n - (meet >= j), [*open_[3], part], whole]
            else:
                if open_ and open_[4] and open_[1] >= 2:
                    yield tuple(open_[:4])
                open_ = [self.before[part] + at, u, n, [part], whole]
            if last[4] > 1:
                if open_[4] and open_[1] >= 2:
                    yield tuple(open_[:4])
                open_ = [self.before[part] + last[0], last[1], last[2], [part], last[3]]
        if open_ and open_[4] and open_[1] >= 2:
            yield tuple(open_[:4])

    def _ordered(self, floor: int) -> list[tuple[int, int, int]]:
        """(count, depth, windows) of the classes behind the floor, in the order of a greedy cache."""
        return [(u, j, n) for (u, j), n in sorted(self.classes.items(), key=lambda x: (-x[0][0], x[0][1])) if j > floor and n]

    def whole(self, floor: int) -> tuple[int, int]:
        """Entries and bytes of the root and all windows of up to floor tokens."""
        return 1 + sum(self.levels[1 : floor + 1]), sum(self.levels[d] * self.fmt.entry_bytes(d) for d in range(1, floor + 1))

    def _least(self) -> int:
        """The least count of a window whose children beyond the last level counted a cache may come
        to: the children of more frequent windows come first, and shallow ones among equals."""
        least = []
        for floor in self.floors:
            spent = self.whole(floor)[1]
            for u, j, n in self._ordered(floor):
                spent += n * self.fmt.entry_bytes(j)
                if spent > self.max_bytes:
                    least.append(u + 1)
                    break
            else:
                least.append(2)
        return min(least, default=2)

    def limits(self, floor: int) -> list[tuple[int, int, int]]:
        """(budget, entries, bytes) of the budgets that hold the floor: how many leading entries fit."""
        return [(b, n, size) for b, n, size, _ in self._walk(floor)]

    def _walk(self, floor: int) -> Iterator[tuple[int, int, int, tuple[int, int, int] | None]]:
        """With the class that isn't held whole, and how many windows of it are."""
        classes = self._ordered(floor)
        for budget in self.budgets:
            entries, spent = self.whole(floor)
            if spent > budget:
                continue
            cut = None
            for u, j, n in classes:
                fit = min(n, (budget - spent) // self.fmt.entry_bytes(j))
                entries, spent = entries + fit, spent + fit * self.fmt.entry_bytes(j)
                if fit < n:
                    cut = (u, j, fit)
                    break
            yield budget, entries, spent, cut

    def cuts(self, floor: int, deepest: int) -> list[tuple[int, int, Cut | None]]:
        """(budget, entries, cut). Of a cut whose parent has more than deepest tokens only the class is
        looked for."""
        ends = [(b, n, c) for b, n, _, c in self._walk(floor)]
        if any(c and c[1] <= deepest + 1 and c not in self.found for _, _, c in ends):
            wanted = sorted({c for f in self.floors for *_, c in self._walk(f) if c and c[1] <= deepest + 1 and c not in self.found})
            for r in self.rounds:  # those of all floors and budgets in one pass over a round's rows
                if mine := [c for c in wanted if r[0] < c[1] <= r[0] + r[1]]:
                    self.found.update(zip(mine, self._cuts(mine, *r)))
        return [(b, n, c and (self.found[c] if c[1] <= deepest + 1 else Cut(c[0], c[1], 0, 0, 0))) for b, n, c in ends]

    def _cuts(self, wanted: list[tuple[int, int, int]], before: int, step: int, rows: DataFrame) -> list[Cut]:
        """Of each (count, depth, taken) the window of number `taken` in the class."""
        edged, starts = before == 0, self.before
        classes = sorted({(u, j) for u, j, _ in wanted})

        def families(arrays: tuple, part: int, count: int, j: int):
            at, lo, agree, room = arrays
            parents, whole, kids = _families(lo, agree, room, j)
            u = np.diff(np.append(parents, len(lo)))
            inner = whole & (u == count)
            ends = np.zeros(len(parents), dtype=bool)
            if edged:
                ends[[0, -1]] = True
            return at + starts[part], agree, room, parents, u, kids, inner & ~ends, ends & whole

        said: list[dict] = [{} for _ in classes]
        counted = self.counted[before]

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, *data in zip(*(column(batch, c) for c in ("part", "u", "j", "n", "ends"))):
                    u, j, n, ends = (unpacked(x, "<i8") for x in data)
                    edges = ends.reshape(-1, 2, 5)
                    for k, (count, depth) in enumerate(classes):
                        mine = int(n[(u == count) & (j == depth)].sum())
                        edge = edges[depth - 1] if edged else edges.reshape(-1, 5)
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (k, pa.int64()), (mine, pa.int64()), (packed(edge.ravel()), pa.binary()))], names=["part", "k", "n", "ends"])

        for r in counted.mapInArrow(total, "part bigint, k bigint, n bigint, ends binary").collect():
            said[r.k][r.part] = (r.n, unpacked(r.ends, "<i8").reshape(-1, 5).tolist())
        where = []  # of each cut the number within what is fetched, the one parent at ranges' ends, and the ranges
        for count, depth, taken in wanted:
            mine = said[classes.index((count, depth))]
            items = [(self.before[p], n, None, [p]) for p, (n, _) in mine.items() if n]
            if edged:
                items += [(lo, n, lo, over) for lo, u, n, over in self._joined(depth - before, {p: mine[p][1] for p in self.parts}) if u == count and n]
            # the inner parents of a range lie behind the one that it begins with
            for _, n, one, over in sorted(items, key=lambda x: (x[0], x[2] is None)):
                if taken < n:
                    break
                taken -= n
            where.append((taken, one, over))
        asked = [(count, depth - before, one is None, set(over)) for (count, depth, _), (_, one, over) in zip(wanted, where)]

        def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, part in enumerate(column(batch, "part")):
                    arrays = _arrays(batch, i)
                    for k, (count, j, within, over) in enumerate(asked):
                        if part not in over:
                            continue
                        at, agree, room, parents, _, kids, inner, ends = families(arrays, part, count, j)
                        wanted = inner if within else ends
                        of = np.searchsorted(parents, kids, side="right") - 1
                        # a window ends where the next one of its parent's or another row begins
                        stops = np.flatnonzero((agree < j) | (room < j))
                        stop = np.append(stops, len(at))[np.searchsorted(stops, kids, side="right")]
                        keep = wanted[of]
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), *(pa.array([packed(x)], pa.binary()) for x in (at[parents[of[keep]]], at[kids[keep]], (stop - kids)[keep]))], names=["k", "part", "up", "lo", "cnt"])

        every = rows.where(F.col("part").isin(*set().union(*(a[3] for a in asked)))).mapInArrow(children, "k bigint, part bigint, up binary, lo binary, cnt binary").collect()
        cuts = []
        for k, ((count, depth, _), (taken, one, over)) in enumerate(zip(wanted, where)):
            got = sorted(r for r in every if r.k == k)
            up, lo, cnt = (np.concatenate([unpacked(r[c], "<i8") for r in got]) for c in ("up", "lo", "cnt"))
            if one is not None:  # pieces of the one parent, whose windows go on from range to range
                mine = (up == one) | np.isin(up, [self.before[p] for p in over[1:]])
                lo, cnt = lo[mine], cnt[mine]
                begins = {self.before[p]: self.meets[self.parts.index(p) - 1] >= depth - before for p in over[1:]}
                new = np.array([not begins.get(x, False) for x in lo.tolist()])
                first = np.flatnonzero(new)
                lo, cnt = lo[first], np.add.reduceat(cnt, first)
                up = np.full(len(lo), one)
            by = np.lexsort((lo, -cnt, up))[taken]
            cuts.append(Cut(count, depth, int(up[by]), int(cnt[by]), int(lo[by])))
        return cuts
