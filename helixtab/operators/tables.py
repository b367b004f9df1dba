"""Gap-affine costs and alignments of focus ranges, and single template switches on top of them.

Pairs are independent, so Spark deals them out; a task takes pairs of like shape together and goes through them row by
row, each row of all of them one vector. Costs are by character: an insertion charges the query's, a deletion the
reference's; the first character of a gap pays open, the others extend. Characters that the cost tables lack cost
INFINITE. Pairs with a null sequence have no alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtab.functions.seq import default_range
from helixtab.operators.anchors import inverted_repeats

INFINITE = 1 << 40
#: Numbers that a task holds at once for pairs of like shape, and of those a row; half the width that a band has at first.
HELD, CACHED, BAND = 1 << 23, 1 << 16, 12
#: Cells of the two tables of a pair's focus range in a search for switches; longer ranges are refused.
MAX_CELLS = 1 << 26


@dataclass
class Costs:
    """A cost set in arrays: by character code, step functions as (lo, hi, cost)."""

    subst: np.ndarray
    open: np.ndarray
    extend: np.ndarray
    base: dict[tuple[str, str], int]
    steps: dict[str, list[tuple[int, int, int]]]

    @staticmethod
    def of(costs: dict[str, DataFrame], table: str = "primary") -> Costs:
        """From the four tables of one set, which have some hundred rows at most."""
        far = lambda c: INFINITE if c is None else int(c)
        subst, open_, extend = np.full((128, 128), INFINITE, np.int64), np.full(128, INFINITE, np.int64), np.full(128, INFINITE, np.int64)
        for r in costs["subst"].where(F.col("tbl") == table).collect():
            subst[ord(r["c1"]), ord(r["c2"])] = far(r["cost"])
        for r in costs["gaps"].where(F.col("tbl") == table).collect():
            open_[ord(r["c"])], extend[ord(r["c"])] = far(r["open"]), far(r["extend"])
        steps: dict[str, list] = {}
        for r in costs["step_fn"].orderBy("name", "lo").collect():
            steps.setdefault(r["name"], []).append((r["lo"], r["hi"], far(r["cost"])))
        return Costs(subst, open_, extend, {(r["p"], r["s"]): far(r["cost"]) for r in costs["base_cost"].where("dir = 'R'").collect()}, steps)

    def step(self, name: str, x: np.ndarray) -> np.ndarray:
        out = np.full(np.shape(x), INFINITE, np.int64)
        for lo, hi, cost in self.steps[name]:
            out[(x >= lo) & (x < hi)] = cost
        return out

    def shortest(self) -> int:
        """The shortest length of a switch: the first with a finite cost."""
        return max(min((lo for lo, _, cost in self.steps["Length"] if cost < INFINITE), default=1), 1)


M, I, D = 0, 1, 2


def _codes(texts: list[str], left: int = 0, right: int = 0) -> np.ndarray:
    """The texts' characters, a column each, with 0 around them."""
    out = np.zeros((len(texts), left + max(map(len, texts), default=0) + right), np.int64)
    for row, t in zip(out, texts):
        row[left : left + len(t)] = np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), 127)
    return np.ascontiguousarray(out.T)


class Sweep:
    """Tables of pairs, row by row, on the diagonals j - i from lo to hi, or on all columns where there are no more of
    them: arrays [state, diagonal or column, pair], so that what is next to one another in memory is alike. Numbers have four
    bytes where no way costs more; `far` is infinite.

    Forwards: least cost of the first i and j characters that ends in a match or substitution, insertion or deletion.
    Backwards (texts reversed): least cost of the last i and j characters after that state. In a row, insertions follow
    one another; as the least of what each may start from, less the sum of extensions so far, they are running minima."""

    def __init__(self, a: list[str], b: list[str], c: Costs, lo: int, hi: int, backwards: bool = False):
        if backwards:
            a, b = [x[::-1] for x in a], [x[::-1] for x in b]
        self.lo, self.backwards = lo, backwards
        self.n, m = max(map(len, a), default=0), max(map(len, b), default=0)
        self.slides = hi - lo < m
        self.width = hi - lo + 1 if self.slides else m + 1
        if not self.slides:
            self.lo = lo = 0
        finite = max((int(v[v < INFINITE].max(initial=0)) for v in (c.subst, c.open, c.extend)))
        kind, self.far = (np.int32, 1 << 28) if finite * (self.n + m + 2) < 1 << 28 else (np.int64, INFINITE)
        subst, open_, extend = (np.minimum(v, self.far).astype(kind) for v in (c.subst, c.open, c.extend))
        # what is around the texts can't be aligned
        subst[0], subst[:, 0], open_[0], extend[0] = self.far, self.far, self.far, self.far
        self.subst = subst.ravel()
        self.x = _codes(a)
        self.x_open, self.x_extend = open_[self.x], extend[self.x]
        self.pad = max(-lo, 0) + 1
        self.at = self.pad + lo  # place of the first column of row 0
        self.y = _codes(b, self.pad, max(self.n + hi - m, 0) + 1 if self.slides else 0)
        place = (np.arange(self.y.shape[0]) - self.pad)[:, None]  # j - 1 of each character
        sizes = np.array([len(t) for t in b])
        self.open, self.extend = open_[self.y], extend[self.y]
        self.sums = np.cumsum(np.where((place >= 0) & (place < sizes), self.extend, 0), 0, dtype=kind)
        self.wall = np.where((place >= -1) & (place < sizes), 0, self.far).astype(kind)

    def place(self, i: int, j: np.ndarray | int) -> np.ndarray | int:
        return j - i - self.lo if self.slides else j

    def row(self, i: int, before: np.ndarray | None) -> np.ndarray:
        start, far = self.at - 1 + (i if self.slides else 0), self.far
        s = slice(start, start + self.width)  # the character before each column
        open_, sums = self.open[s], self.sums[s]
        new = np.full((3, *sums.shape), far, sums.dtype)
        if before is None:
            if 0 <= -self.lo < self.width:
                new[:, -self.lo] = 0 if self.backwards else np.array([0, far, far])[:, None]
        else:
            corner = self.subst.take((self.x[i - 1] << 7) + self.y[s])
            gap, more = self.x_open[i - 1], self.x_extend[i - 1]
            # the cells above, and above and to the left
            if self.slides:
                up, back, own, after = before[:, 1:], before, slice(0, -1), slice(0, None)
            else:
                up, back, own, after = before, before[:, :-1], slice(0, None), slice(1, None)
        if self.backwards:
            if before is None:
                base = new[M].copy()
            else:
                diagonal = np.full_like(sums, far)
                np.add(back[M], corner[after], out=diagonal[after])
                base = diagonal.copy()
                np.minimum(base[own], up[D] + gap, out=base[own])
            # after an insertion, one more extends it
            np.minimum.accumulate(base - sums, 0, out=new[I])
            new[I] += sums
            new[I] += self.wall[s]
            left = np.full_like(base, far)
            np.add(new[I][:-1], open_[1:], out=left[1:])
            np.minimum(base, left, out=new[M])
            if before is None:
                new[D] = new[M]
            else:
                np.minimum(diagonal, left, out=new[D])
                np.minimum(new[D][own], up[D] + more, out=new[D][own])
        else:
            if before is not None:
                np.add(np.minimum(np.minimum(back[M], back[I]), back[D]), corner[after], out=new[M][after])
                np.minimum(np.minimum(up[M], up[I]) + gap, up[D] + more, out=new[D][own])
            first = np.minimum(new[M], new[D])[:-1] + open_[1:] - sums[1:]
            new[I, 1:] = np.minimum.accumulate(first, 0) + sums[1:] + self.wall[s][1:]
        return np.minimum(new, far, out=new)

    def rows(self, start: int = 0, state: np.ndarray | None = None, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(start, (self.n if stop is None else stop) + 1):
            state = self.row(i, state)
            yield i, state

    def whole(self, cells: np.ndarray) -> np.ndarray:
        """The numbers in eight bytes, INFINITE for what is infinite."""
        out = cells.astype(np.int64)
        out[out >= self.far] = INFINITE
        return out


def _shapes(a: list[str], b: list[str], width: Callable[[int, int], int], held: int | None = None) -> Iterator[list[int]]:
    """The pairs in parts of like lengths whose numbers, width(longest a, longest b) a pair, come to no more than held (else
    HELD)."""
    bits = lambda k: (len(a[k]).bit_length(), len(b[k]).bit_length())
    part: list[int] = []
    n = m = 0
    for k in sorted(range(len(a)), key=lambda k: (bits(k), len(b[k]) - len(a[k]), len(a[k]))):
        n2, m2 = max(n, len(a[k])), max(m, len(b[k]))
        if part and (bits(k) != bits(part[0]) or (len(part) + 1) * width(n2, m2) > (held or HELD)):
            yield part
            part, n2, m2 = [], len(a[k]), len(b[k])
        part.append(k)
        n, m = n2, m2
    if part:
        yield part


def _gap_least(c: Costs, n: np.ndarray | int) -> np.ndarray:
    """What as many insertions, or deletions, cost at least."""
    open_, least = int(c.open.min()), int(min(c.open.min(), c.extend.min()))
    return np.where(n > 0, open_ - least + least * n, 0) if least > 0 else np.zeros(np.shape(n), np.int64)


def _beyond(c: Costs, lo: int, hi: int, difference: np.ndarray | int) -> np.ndarray | int:
    """Less than any way costs that leaves the diagonals from lo to hi: as many insertions as lead out of them, and
    deletions back to the last one, or the other way round; insertions and deletions are opened."""
    one = lambda n: _gap_least(c, n)
    return np.minimum(one(np.maximum(hi + 1, 0)) + one(np.maximum(hi + 1 - difference, 0)), one(np.maximum(1 - lo, 0)) + one(np.maximum(difference - lo + 1, 0)))


def solve(a: list[str], b: list[str], c: Costs, trace: bool = False) -> list[tuple[int, list[tuple[int, str]] | None]]:
    """Each pair's least cost and, if traced, the runs (n, kind) of one cheapest alignment (see solved)."""
    cost, (own, sizes, kinds) = solved(a, b, c, trace)
    runs: list = [[] if trace and v < INFINITE else None for v in cost.tolist()] if trace else [None] * len(a)
    for k, n, kind in zip(own.tolist(), sizes.tolist(), kinds.tolist()):
        runs[k].append((n, _STEPS[kind]))
    return [(v, [] if trace and r is None else r) for v, r in zip(cost.tolist(), runs)]


def solved(a: list[str], b: list[str], c: Costs, trace: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair's least cost, INFINITE if there is none, and, if traced, the runs of one cheapest alignment as (pair, n, kind's
    place in _STEPS), pair by pair: of equal ways, from the start on, a match or substitution goes before an insertion, that
    before a deletion.

    The tables are filled on a band of diagonals, of parts whose rows fit a core's cache. A cost below what any way out of the
    band costs is the least one; pairs without such a cost are tried again on a wider band, which that cost tells, at last on
    all diagonals. To trace, all rows are kept where they fit, else each so many rows one, and the rows between are filled
    again from there, from the start of the texts on."""
    least, runs = np.full(len(a), INFINITE), [(np.zeros(0, np.int64),) * 3]
    todo, half = list(range(len(a))), BAND
    while todo:
        again, most = [], 0
        step = lambda n: int(n**0.5) + 1
        band = lambda n, m: min(m, abs(n - m) + 2 * half) + 1
        for part in _shapes([a[k] for k in todo], [b[k] for k in todo], lambda n, m: max(HELD // CACHED * 3 * band(n, m), 6 * band(n, m) * (step(n) if trace else 1) + 6 * (n + m))):
            own = [todo[k] for k in part]
            sa, sb = [a[k] for k in own], [b[k] for k in own]
            na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
            differences = nb - na
            lo, hi = max(min(0, int(differences.min())) - half, -int(na.max())), min(max(0, int(differences.max())) + half, int(nb.max()))
            sweep = Sweep(sa, sb, c, lo, hi, backwards=True)
            every = 1 if 3 * (sweep.n + 1) * sweep.width * len(own) <= HELD else step(sweep.n)
            kept, cost = {}, np.full(len(own), INFINITE)
            for i, t in sweep.rows():
                ends = np.flatnonzero(na == i)
                if len(ends):
                    cost[ends] = sweep.whole(t[M, sweep.place(i, nb[ends]), ends])
                if trace and i % every == 0:
                    kept[i] = t
            exact = (cost < _beyond(c, lo, hi, differences)) | (not sweep.slides) | ((lo <= -na) & (hi >= nb))
            again += [k for k, e in zip(own, exact) if not e]
            most = max(most, int(cost[~exact].max(initial=0)))
            least[np.array(own)[exact]] = cost[exact]
            if trace:
                pair, *rest = _paths(sweep, kept, every, na, nb, exact & (cost < INFINITE))
                runs.append((np.array(own)[pair], *rest))
        # with the next band, all whose cost is known are exact, unless it were much wider
        wide = next((h for h in range(half + 1, 3 * half) if _beyond(c, -h, h, 0) > most), 8 * half)
        todo, half = again, wide
    whole = [np.concatenate(v) for v in zip(*runs)]
    order = np.argsort(whole[0], kind="stable")
    return least, tuple(v[order] for v in whole)


def _paths(sweep: Sweep, kept: dict[int, np.ndarray], step: int, na: np.ndarray, nb: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (pair, n, kind) along one cheapest way of each wanted pair, from the last row to the first by blocks of `step` rows;
    the pairs take their steps together."""
    i, j, state = na.copy(), nb.copy(), np.full(len(na), M)
    taken: list[np.ndarray] = []
    if step == 1:
        blocks = [(0, np.stack([kept[r] for r in range(sweep.n + 1)]))]
    else:
        # with the next block's first row, from which the ways come
        blocks = ((first, np.stack([kept[first], *(t for _, t in sweep.rows(first + 1, kept[first], min(first + step, sweep.n)))])) for first in sorted(kept, reverse=True))
    gaps, pairs = np.stack([sweep.open, sweep.extend]), len(na)
    for first, block in blocks:
        cells = block.ravel()

        def table(r, s, at, k, cells=cells, first=first):
            place = sweep.place(r, at)
            ok = (r >= first) & (place >= 0) & (place < sweep.width)
            return np.where(ok, cells.take((((r - first) * 3 + s) * sweep.width + place) * pairs + k, mode="clip"), sweep.far)

        while len(k := np.flatnonzero(wanted & ((i > 0) | (j > 0)) & ((i > first) | (first == 0)))):
            r, at, s = i[k], j[k], state[k]
            here = table(r, s, at, k)
            x, y = sweep.x[np.maximum(r - 1, 0), k] if sweep.n else np.zeros(len(k), np.int64), sweep.y[sweep.pad + at - 1, k]
            both = (r > 0) & (at > 0) & (sweep.subst.take((x << 7) + y) + table(r - 1, M, at - 1, k) == here)
            insert = ~both & (at > 0) & (gaps[(s == I).astype(int), sweep.pad + at - 1, k] + table(r, I, at - 1, k) == here)
            delete = ~both & ~insert
            i[k] -= both | delete
            j[k] -= both | insert
            state[k] = np.where(both, M, np.where(insert, I, D))
            kind = np.full(pairs, -1, np.int8)
            kind[k] = np.where(both, np.where(x == y, 0, 1), np.where(insert, 2, 3))
            taken.append(kind)
    if not taken:
        return (np.zeros(0, np.int64),) * 3
    # as runs: a pair's steps follow one another
    steps = np.stack(taken, 1)
    own, at = np.nonzero(steps >= 0)
    kinds = steps[own, at]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(kinds) != 0)))[: len(own)])
    return own[new], np.diff(np.append(new, len(own))), kinds[new].astype(np.int64)


_STEPS = ("PrimaryMatch", "PrimarySubstitution", "PrimaryInsertion", "PrimaryDeletion")


def _renamed(x: str, y: str) -> tuple[str, str]:
    """The texts with codes below 128 that are equal just where theirs are; there is room, as one of the texts has fewer
    than 100 characters."""
    if x.isascii() and y.isascii() and "\0" not in x and "\0" not in y and "\x7f" not in x + y:
        return x, y
    both = {c: chr(3 + i) for i, c in enumerate(sorted(set(x) & set(y)))}
    return "".join(both.get(c, "\1") for c in x), "".join(both.get(c, "\2") for c in y)


def ends_of(a: list[str], b: list[str], c: Costs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, costs) of parts of the pairs: the least costs of whole tables of short texts, of any characters and any costs."""
    a, b = (list(v) for v in (zip(*map(_renamed, a, b)) if a else ((), ())))
    for part in _shapes(a, b, lambda n, m: HELD // CACHED * 3 * (m + 1) + 6 * n):
        sa, sb = [a[k] for k in part], [b[k] for k in part]
        na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
        sweep, cost = Sweep(sa, sb, c, -int(na.max()), int(nb.max())), np.full(len(part), INFINITE)
        for i, t in sweep.rows():
            ends = np.flatnonzero(na == i)
            if len(ends):
                cost[ends] = sweep.whole(t[:, nb[ends], ends].min(0))
        yield np.array(part), cost


def focus_ranges(pairs: DataFrame) -> DataFrame:
    """pair_id, and the characters of the focus ranges as a and b."""
    return _ranges(pairs).select("pair_id", "a", "b")


def _ranges(pairs: DataFrame, *more: str) -> DataFrame:
    """pair_id, a and b (the focus ranges' characters), a_start, b_start, and other columns."""
    p = default_range(pairs)
    cut = lambda s: F.substr(F.col(f"{s}_seq"), F.col(f"{s}_start") + 1, F.col(f"{s}_limit") - F.col(f"{s}_start"))
    return p.select("pair_id", cut("r").alias("a"), cut("q").alias("b"), F.col("r_start").cast("int").alias("a_start"), F.col("q_start").cast("int").alias("b_start"), *more)


def _typed(df: DataFrame, schema: str) -> str:
    """The schema with pair_id in the type that it has in df."""
    return f"pair_id {df.schema['pair_id'].dataType.simpleString()}, {schema}"


def gap_affine_table(pairs: DataFrame, costs: dict[str, DataFrame], backwards: bool = False, states: bool = True) -> DataFrame:
    """pair_id, i, j (positions in the sequences), m, ins, del, cost: of every cell of the focus range, the least cost
    from the range's start by last operation, or backwards to its end by the operation before. Null is infinite. Without
    `states`, pair_id, i, j and cost alone."""
    c = Costs.of(costs)
    rows = _ranges(pairs).where("a is not null and b is not null")
    kinds = ("m", "ins", "del", "cost") if states else ("cost",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, a0, b0 = (batch.column(n).to_pylist() for n in ("a", "b", "a_start", "b_start"))
            for part in _shapes(a, b, lambda n, m: HELD // CACHED * 3 * (m + 1) + 6 * n):
                sa, sb, own = [a[k] for k in part], [b[k] for k in part], np.array(part)
                na, nb, starts = (np.array([v[k] for k in part])[:, None] for v in (list(map(len, a)), list(map(len, b)), list(zip(a0, b0))))
                sweep = Sweep(sa, sb, c, -max(map(len, sa)), max(map(len, sb)), backwards)
                at, places = None, None
                for i, t in sweep.rows():
                    # the row of all pairs that have it, pair by pair; mostly the same pairs as in the row before
                    has = na[:, 0] >= i
                    if at is None or not has[at].all():
                        at, j = np.nonzero(has[:, None] & (np.arange(sweep.width) <= nb))
                        places, flat = batch.column(0).take(pa.array(own[at])), j * len(part) + at
                        across = pa.array(((nb[at, 0] - j if backwards else j) + starts[at, 0, 1]).astype(np.int32))
                        down = (na[at, 0] if backwards else 0) + starts[at, 0, 0]
                    if not len(at):
                        continue
                    best = t[M] if backwards else t.min(0)
                    values = [sweep.whole(v.take(flat)) for v in ([*t, best] if states else [best])]
                    yield pa.RecordBatch.from_arrays([places, pa.array((down - i if backwards else down + i).astype(np.int32)), across, *[pa.array(v, mask=v >= INFINITE) for v in values]], ["pair_id", "i", "j", *kinds])

    return rows.mapInArrow(run, _typed(rows, "i int, j int, " + ", ".join(f"{k} long" for k in kinds)))


def gap_affine_cost(pairs: DataFrame, costs: dict[str, DataFrame]) -> DataFrame:
    """pair_id, cost: the least cost of the focus ranges without switches, null if there is none."""
    c = Costs.of(costs)
    rows = _ranges(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(n).to_pylist() for n in ("a", "b"))
            known = [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
            cost = dict(zip(known, (v for v, _ in solve([a[k] for k in known], [b[k] for k in known], c))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if (v := cost.get(k, INFINITE)) < INFINITE else None for k in range(len(a))], pa.int64())], ["pair_id", "cost"])

    return rows.mapInArrow(run, _typed(rows, "cost long"))


OPS = "op_idx int, n int, kind string, first_offset int, p string, s string, dir string, gap int"
_OP_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]


def op_batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (place in ids, op_idx, n, kind, first_offset, p, s, dir, gap) as operations."""
    cols = list(zip(*rows)) or [[]] * 9
    return pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), *[pa.array(v, t) for v, t in zip(cols[1:], _OP_TYPES)]], ["pair_id", *[x.split()[0] for x in OPS.split(", ")]])


def gap_affine_align(pairs: DataFrame, costs: dict[str, DataFrame], table: str = "primary") -> DataFrame:
    """Operation rows of one optimal alignment of the focus ranges without switches. Pairs without a finite one, such as
    of characters that the costs lack, have no rows."""
    c = Costs.of(costs, table)
    rows = _ranges(pairs).where("a is not null and b is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, (own, n, kind) = solved(*(batch.column(n).to_pylist() for n in ("a", "b")), c, trace=True)
            first = np.flatnonzero(np.diff(own, prepend=-1))
            at = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            names = pa.DictionaryArray.from_arrays(pa.array(kind, pa.int32()), pa.array(_STEPS)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(at, pa.int32()), pa.array(n, pa.int32()), names, *[pa.nulls(len(own), t) for t in _OP_TYPES[3:]]], ["pair_id", *[x.split()[0] for x in OPS.split(", ")]])

    return rows.mapInArrow(run, _typed(rows, OPS))


def runs_of(pair: np.ndarray, kind: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Columns (pair, kind, x, y, length) of the longest inverted repeats that secondary anchors of k bases make up: those in a
    row on one antidiagonal. x is the ancestor's right end, y the descendant's left one."""
    order = np.lexsort((y, x + y, kind, pair))
    pair, kind, x, y = pair[order], kind[order], x[order], y[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(kind) != 0) | (np.diff(x + y) != 0) | (np.diff(y) != 1)))[: len(x)])
    return np.stack([pair[first], kind[first], x[first], y[first], np.diff(np.append(first, len(x))) + k - 1])


def _gap_pieces(c: Costs, length: int) -> list[tuple[int, int, int]]:
    """The gap's and the length difference's cost together, as pieces (lo, hi, cost) of the gap, finite ones."""
    one, two = c.steps["ReverseAntiPrimaryGap"], [(lo + length, hi + length, v) for lo, hi, v in c.steps["LengthDifference"]]
    both = [(max(a, x), min(b, y), v + w) for a, b, v in one for x, y, w in two]
    return [(lo, hi, v) for lo, hi, v in both if lo < hi and v < INFINITE]


class Grids:
    """The tables of a part's pairs: least costs from the start of the pairs' ranges, and to their end, [i, j, pair]; those to the
    end count from there. If half is given, both are bands of so many diagonals on either side of where they start."""

    def __init__(self, a: list[str], b: list[str], c: Costs, half: int | None = None):
        self.sizes = {"R": np.array([len(x) for x in a]), "Q": np.array([len(x) for x in b])}
        n, m = int(self.sizes["R"].max()), int(self.sizes["Q"].max())
        lo, hi = (-n, m) if half is None else (max(-half, -n), min(half, m))
        there, back = (Sweep(a, b, c, lo, hi, backwards) for backwards in (False, True))
        self.sweep, self.whole, self.slides = there, there.whole, there.slides
        self.before, self.after = np.stack([t.min(0) for _, t in there.rows()]), np.stack([t[M] for _, t in back.rows()])
        self.low = {"R": [self.whole(t.min(1)) for t in (self.before, self.after)], "Q": [self._columns(t, m) for t in (self.before, self.after)]}
        place, own = there.place(*self.sizes.values()), np.arange(len(a))
        inside = (place >= 0) & (place < there.width)
        self.plain = np.where(inside, self.whole(self.before[self.sizes["R"], np.where(inside, place, 0), own]), INFINITE)
        # ways that leave the band
        self.plain_known = (self.plain < _beyond(c, lo, hi, self.sizes["Q"] - self.sizes["R"])) | (not self.slides)
        base, length = (min((v for v in costs if v < INFINITE), default=0) for costs in (c.base.values(), (v for *_, v in c.steps["Length"])))
        self.known_below = int(min(_gap_least(c, hi + 1), _gap_least(c, 1 - lo))) + base + length if self.slides else INFINITE + 1

    def _columns(self, table: np.ndarray, m: int) -> np.ndarray:
        """Least numbers of the columns."""
        if not self.slides:
            return self.whole(table.min(0))
        out = np.full((m + 1, table.shape[2]), self.sweep.far, table.dtype)
        for place in range(table.shape[1]):
            j = place + self.sweep.lo  # of row 0
            i, end = max(-j, 0), min(len(table), m + 1 - j)
            if i < end:
                np.minimum(out[i + j : end + j], table[i:end, place], out=out[i + j : end + j])
        return self.whole(out)

    def bound(self, p: str, pair: np.ndarray, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Least cost of what is before and after a switch of the descendant p from d on."""
        return self.low[p][0][d, pair] + self.low[p][1][self.sizes[p][pair] - d - length, pair]

    def lines(self, p: str, pair: np.ndarray, d: np.ndarray, at: np.ndarray, after: bool) -> np.ndarray:
        """A line of a table for each: p is at d, the other sequence at the places `at`, which may be outside of it."""
        pair, d = pair[:, None], d[:, None]
        end = self.sizes["Q" if p == "R" else "R"][pair]
        inside, table = (at >= 0) & (at <= end), self.before
        if after:
            d, at, table = self.sizes[p][pair] - d, end - at, self.after
        i, j = (d, at) if p == "R" else (at, d)
        place = self.sweep.place(i, j)
        inside = inside & (place >= 0) & (place < self.sweep.width)
        return np.where(inside, self.whole(table[np.where(inside, i, 0), np.where(inside, place, 0), pair]), INFINITE)


#: Switches that are looked at together: places and lengths before their order is known, and ways in a round.
PLACES, ROUND = 1 << 20, 128


def _ways(runs: np.ndarray, grids: Grids, starts: dict[str, np.ndarray], c: Costs) -> np.ndarray:
    """Columns (bound, pair, descendant, ancestor, d, length, a) of all switches inside the runs; the sequences are 0 for Q and
    1 for R."""
    least = c.shortest()
    runs = runs[:, runs[4] >= least]
    own = np.repeat(np.arange(runs.shape[1]), runs[4] - least + 1)
    skip = np.arange(len(own)) - np.searchsorted(own, own)
    n = runs[4][own] - skip - least + 1
    one = np.repeat(np.arange(len(own)), n)
    length = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + least
    own, skip = own[one], skip[one]
    pair, kind, x, y = runs[:4, own]
    p, s = 1 - kind % 2, 1 - kind // 2
    d = y + skip - np.where(p == 1, starts["R"][pair], starts["Q"][pair])
    fits = (d >= 0) & (d + length <= np.where(p == 1, grids.sizes["R"][pair], grids.sizes["Q"][pair]))
    pair, p, s, d, length, a = (v[fits] for v in (pair, p, s, d, length, x - skip))
    base = np.array([[c.base.get((i, j), INFINITE) for j in "QR"] for i in "QR"])
    bound = base[p, s] + c.step("Length", length)
    for code, name in enumerate("QR"):
        own = p == code
        bound[own] += grids.bound(name, pair[own], d[own], length[own])
    return np.stack([bound, pair, p, s, d, length, a])[:, bound < INFINITE]


def _tried(ways: np.ndarray, grids: Grids, starts: dict[str, np.ndarray], c: Costs) -> np.ndarray:
    """Columns (cost, e, f, first_offset): each way's cheapest SP1 and SP4. The best SP4 for every SP1 is a least number of a range for
    each piece of the gap's cost, which are the same for all ways once they count from the switch's length on."""
    out = np.zeros((4, ways.shape[1]), np.int64)
    out[0] = INFINITE
    groups: dict[tuple, list[int]] = {}
    pieces_of = {int(n): tuple((lo - int(n), hi - int(n), v) for lo, hi, v in _gap_pieces(c, int(n))) for n in np.unique(ways[5])}
    reach = sum(int(v.max()) for v in grids.sizes.values()) + 1  # no gap differs by more
    clipped = {n: tuple((max(lo, -reach), min(hi, reach), v) for lo, hi, v in pieces if lo < reach and hi > -reach) for n, pieces in pieces_of.items()}
    for w, (p, n) in enumerate(zip(ways[2].tolist(), ways[5].tolist())):
        groups.setdefault((p, clipped[n]), []).append(w)
    for (p_code, pieces), own in groups.items():
        if not pieces:
            continue
        _, pair, _, s, d, length, a = ways[:, own]
        p, o = ("R", "Q") if p_code else ("Q", "R")
        columns = int(grids.sizes[o][pair].max()) + 1
        at, low, high = np.arange(columns), min(x[0] for x in pieces), max(x[1] for x in pieces)
        sp1 = np.where((s != p_code)[:, None], at + starts[o][pair][:, None], (d + starts[p][pair])[:, None])
        offset = a[:, None] - sp1
        first = grids.lines(p, pair, d, at[None, :], False) + np.where((s == p_code)[:, None], c.step("RRQQOffset", offset), c.step("RQQROffset", offset))
        # line[:, e + difference - low]: SP4 is the gap after SP1, and the gap is the length and the difference
        places = np.arange(columns - 1 + high - low) + low + length[:, None]
        levels = [grids.lines(p, pair, d + length, places, True)]
        line = levels[0]
        rest = np.full(first.shape, INFINITE)
        for lo, hi, v in pieces:
            t = (hi - lo).bit_length() - 1
            while len(levels) <= t:
                half = 1 << len(levels) - 1
                levels.append(np.minimum(levels[-1][:, :-half], levels[-1][:, half:]))
            left, right = lo - low, hi - low - (1 << t)
            np.minimum(rest, np.minimum(levels[t][:, left : left + columns], levels[t][:, right : right + columns]) + v, out=rest)
        total = first + rest
        row, e = np.arange(len(own)), total.argmin(1)
        # SP4 of that SP1: the first of the cheapest
        difference = np.arange(low, high)
        gaps = np.full(len(difference), INFINITE)
        for lo, hi, v in pieces:
            gaps[lo - low : hi - low] = v
        f = e + low + length + (line[row[:, None], e[:, None] + difference - low] + gaps).argmin(1)
        base = np.array([[c.base.get((i, j), INFINITE) for j in "QR"] for i in "QR"])
        out[:, own] = np.stack([total[row, e] + c.step("Length", length) + base[p_code, s], e, f, offset[row, e]])
    return out


def best_switches(runs: np.ndarray, grids: Grids, starts: dict[str, np.ndarray], c: Costs, longest: bool = True) -> dict[int, tuple]:
    """By pair: cost, descendant, ancestor, SP1, SP2 and SP4 ..., length, gap, first_offset of its cheapest switch whose inner
    part is without an error; of equal ones the longest, if so asked, then the first in the order of descendant, ancestor, SP1,
    length. Pairs without one are left out.

    A pair's places and lengths come in the order of what they cost at least, and end once that can't be bettered; the next ones
    of all pairs are tried together."""
    ways = _ways(runs, grids, starts, c)
    if ways.shape[1]:
        # one of the cheapest of each pair tells which others can't be better
        order = np.lexsort((ways[0], ways[1]))
        first = order[np.flatnonzero(np.diff(ways[1, order], prepend=-1))]
        least = np.full(len(grids.plain), INFINITE)
        least[ways[1, first]] = _tried(ways[:, first], grids, starts, c)[0]
        ways = ways[:, ways[0] <= least[ways[1]]]
    order = np.lexsort((*ways[6:1:-1], *((-ways[5],) if longest else ()), ways[0], ways[1]))
    ways = ways[:, order]
    pairs = np.unique(ways[1])
    at, end = np.searchsorted(ways[1], pairs, "left"), np.searchsorted(ways[1], pairs, "right")
    best = np.full((2, len(pairs)), INFINITE)  # cost, then length, less where longer, or nothing
    rows = np.zeros((11, len(pairs)), np.int64)
    rank = lambda w: -ways[5, w] if longest else np.zeros(len(w), np.int64)
    while len(pairs):
        now = np.minimum(at, end - 1)
        open_ = np.flatnonzero((at < end) & ((ways[0, now] < best[0]) | ((ways[0, now] == best[0]) & (rank(now) < best[1]))))
        if not len(open_):
            break
        many = np.minimum(end[open_] - at[open_], max(ROUND // len(open_), 1))
        owner = np.repeat(open_, many)
        w = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + at[owner]
        at[open_] += many
        found = _tried(ways[:, w], grids, starts, c)
        first = np.lexsort((w, rank(w), found[0], owner))
        first = first[np.flatnonzero(np.diff(owner[first], prepend=-1))]  # each pair's best of this round
        better = (found[0, first] < INFINITE) & ((found[0, first] < best[0, owner[first]]) | ((found[0, first] == best[0, owner[first]]) & (rank(w[first]) < best[1, owner[first]])))
        first = first[better]
        best[:, owner[first]] = np.stack([found[0, first], rank(w[first])])
        rows[:, owner[first]] = np.concatenate([ways[:, w[first]], found[:, first]])
    out = {}
    for _, k, p, s, d, length, a, cost, e, f, offset in rows[:, best[0] < INFINITE].T.tolist():
        p, s = "QR"[p], "QR"[s]
        o = "Q" if p == "R" else "R"
        own, their = (d + int(starts[p][k]), d + length + int(starts[p][k])), (e + int(starts[o][k]), f + int(starts[o][k]))
        (r1, r4), (q1, q4) = (own, their) if p == "R" else (their, own)
        out[k] = (cost, p, s, r1, q1, a, r4, q4, length, f - e, offset)
    return out


SWITCH = "ts_cost long, no_ts_cost long, p string, s string, sp1_r int, sp1_q int, sp2 int, sp4_r int, sp4_q int, length int, gap int, first_offset int"


def _grid(a: list[str], b: list[str], c: Costs, backwards: bool) -> list[np.ndarray]:
    """Each pair's whole table of least costs from its start (or to its end), [i, j]."""
    sweep = Sweep(a, b, c, -max(map(len, a)), max(map(len, b)), backwards)
    rows = np.stack([t[M] if backwards else t.min(0) for _, t in sweep.rows()])
    out = [sweep.whole(rows[: len(x) + 1, : len(y) + 1, k]) for k, (x, y) in enumerate(zip(a, b))]
    return [x[::-1, ::-1] for x in out] if backwards else out


def _called(batch: pa.RecordBatch, c: Costs, k: int, longest: bool) -> list[tuple]:
    """Per row of the batch, the switch's columns (nulls without one)."""
    got = {n: batch.column(n).to_pylist() for n in batch.schema.names[1:]}
    a, b, out = got["a"], got["b"], [(None,) * 12] * batch.num_rows
    known = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
    if any((len(a[i]) + 1) * (len(b[i]) + 1) > MAX_CELLS for i in known):
        raise ValueError("focus range too long to search for switches in: give a shorter one")
    start = {s: np.array([got[f"{n}_start"][i] for i in known], np.int64) for s, n in (("R", "a"), ("Q", "b"))}
    ranges = np.stack([start["R"], start["R"] + [len(a[i]) for i in known], start["Q"], start["Q"] + [len(b[i]) for i in known]], 1).astype(np.int64).reshape(-1, 4)
    runs = [np.zeros((5, 0), np.int64)]
    size = np.cumsum([len(got["r_seq"][i]) + len(got["q_seq"][i]) for i in known])
    for some in np.split(np.arange(len(known)), np.flatnonzero(np.diff(size // CACHED)) + 1):
        texts = ([got[n][known[i]] for i in some] for n in ("r_seq", "q_seq"))
        for pair, kind, x, y in inverted_repeats(*texts, k, ranges[some]):
            runs.append(runs_of(some[pair], kind, x, y, k))
    runs = np.concatenate(runs, 1)
    runs = runs[:, runs[4] >= c.shortest()]
    with_runs = set(runs[0].tolist())
    plain = np.full(len(known), -1)
    best: dict[int, tuple] = {}
    places = np.bincount(runs[0], (runs[4] - c.shortest() + 1) * (runs[4] - c.shortest() + 2) // 2, len(known)).astype(np.int64)
    todo, narrow = sorted(with_runs), True
    while todo:
        again = []
        band = lambda n, m, narrow=narrow: max(BAND, max(n, m) // 5) if narrow else max(n, m)
        for part in _shapes([a[known[i]] for i in todo], [b[known[i]] for i in todo], lambda n, m: 2 * (n + 1) * (min(m, 2 * band(n, m)) + 1) + 6 * (n + m + 1)):
            own = np.array([todo[i] for i in part])
            sa, sb = [a[known[i]] for i in own], [b[known[i]] for i in own]
            grids = Grids(sa, sb, c, band(max(map(len, sa)), max(map(len, sb))) if narrow else None)
            plain[own[grids.plain_known]] = grids.plain[grids.plain_known]
            of = np.full(len(known), -1)
            of[own] = np.arange(len(own))
            for some in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(places[own]) // PLACES)) + 1):
                mine = of[runs[0]]
                mine = np.flatnonzero((mine >= some[0]) & (mine <= some[-1]))
                found = best_switches(np.concatenate([of[runs[:1, mine]], runs[1:, mine]]), grids, {s: v[own] for s, v in start.items()}, c, longest)
                # a switch that costs no less than what is needed to leave the band may have a better one beside it
                best |= {int(own[i]): v for i, v in found.items() if v[0] < grids.known_below}
                again += [int(own[i]) for i in some if (found[int(i)][0] if int(i) in found else INFINITE) >= grids.known_below]
        todo, narrow = again, False
    rest = np.flatnonzero(plain < 0)
    plain[rest] = solved([a[known[i]] for i in rest], [b[known[i]] for i in rest], c)[0]
    for at, i in enumerate(known):
        one = best.get(at, (None,) * 11)
        out[i] = (one[0], int(plain[at]) if plain[at] < INFINITE else None, *one[1:])
    return out


def call_single_ts(pairs: DataFrame, costs: dict[str, DataFrame], k: int | None = None, tie: str = "maximise") -> DataFrame:
    """Of each pair, the cheapest explanation of the focus range with one reverse switch whose inner part is error-free,
    and the cost without one; ts_cost is null where there is none. Of equal ones the longest (maximise), or the first
    (none). The inner part may leave the focus range, SP1 and SP4 may not.

    Inverted repeats of k or more bases are looked through, all within their pair's task; k is the set's shortest length
    of a switch unless it is given, and may not be longer than that."""
    c = Costs.of(costs)
    k = _seed(c, k)
    rows = _ranges(pairs, "r_seq", "q_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SWITCH.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() if x.endswith("long") else pa.int32() for x in SWITCH.split(", ")]
        for batch in batches:
            cols = list(zip(*_called(batch, c, k, tie == "maximise"))) or [[]] * 12
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(cols, kinds)]], ["pair_id", *names])

    return rows.mapInArrow(run, _typed(rows, SWITCH))


def _seed(c: Costs, k: int | None) -> int:
    if k is not None and k > c.shortest():
        raise ValueError(f"switches may be {c.shortest()} long: seeds of {k} would miss them")
    return min(k or c.shortest(), 64)


def align_with_switch(pairs: DataFrame, costs: dict[str, DataFrame], tie: str = "maximise") -> DataFrame:
    """Operation rows of each pair's cheapest alignment with at most one switch (see call_single_ts): the switch is taken
    if it costs less than none. Pairs without a finite alignment have no rows."""
    c = Costs.of(costs)
    k = _seed(c, None)
    rows = _ranges(pairs, "r_seq", "q_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, inner = [], {}  # (row, reference part, query part), in order
            got = {n: batch.column(n).to_pylist() for n in ("a", "b", "a_start", "b_start")}
            for i, (ts, plain, p, s, r1, q1, _, r4, q4, length, gap, first) in enumerate(_called(batch, c, k, tie == "maximise")):
                a, b, a0, b0 = (got[n][i] for n in ("a", "b", "a_start", "b_start"))
                if ts is not None and (plain is None or ts < plain):
                    parts += [(i, a[: r1 - a0], b[: q1 - b0]), (i, a[r4 - a0 :], b[q4 - b0 :])]
                    inner[i] = [(1, "TemplateSwitchEntrance", first, p, s, "R", None), (length, "SecondaryMatch", *[None] * 5), (1, "TemplateSwitchExit", *[None] * 4, gap)]
                elif plain is not None:
                    parts.append((i, a, b))
            ops: dict[int, list[tuple]] = {}
            for (i, _, _), (_, path) in zip(parts, solve([x[1] for x in parts], [x[2] for x in parts], c, trace=True)):
                after = i in ops
                ops.setdefault(i, []).extend([*(inner[i] if after else []), *((n, kind, *[None] * 5) for n, kind in path)])
            yield op_batch(batch.column(0), [(i, at, *row) for i, found in ops.items() for at, row in enumerate(found)])

    return rows.mapInArrow(run, _typed(rows, OPS))
