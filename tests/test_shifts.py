"""Ranges of equal cost against all shifts of small alignments."""

import random

from pyspark.sql import functions as F

from helixtab.operators import ops, shifts
from helixtab.sources.costs import load_costs, of_set

COMPLEMENT = str.maketrans("ACGT", "TGCA")
OPS = "pair_id string, op_idx int, n int, kind string, first_offset int, p string, s string, dir string, gap int"


def tables(costs):
    """The cost set as dictionaries; None is infinite."""
    subst = {(r.tbl, r.c1, r.c2): r.cost for r in costs["subst"].collect()}
    gaps = {(r.tbl, r.c): (r.open, r.extend) for r in costs["gaps"].collect()}
    base = {(r.p, r.s, r.dir): r.cost for r in costs["base_cost"].collect()}
    steps = [(r.name, r.lo, r.hi, r.cost) for r in costs["step_fn"].collect()]
    return subst, gaps, base, lambda name, x: next(c for n, lo, hi, c in steps if n == name and lo <= x < hi)


def cost_of(units, r, q, c, at):
    """The cost of units (kind letter, or entrance and exit tuples) from the positions `at`; inf if any part is."""
    subst, gaps, base, step = c
    pos, total, inside, before = dict(zip("RQ", at)), 0, None, None
    add = lambda x: float("inf") if x is None else x
    seqs = {"R": r, "Q": q}
    for u in units:
        if u[0] == "enter":
            _, p, s, d, first = u
            total += add(base[p, s, d]) + add(step("RRQQOffset" if p == s else "RQQROffset", first))
            inside, second, length = (p, s, d), pos[s] + first, 0
        elif u[0] == "leave":
            p, s, d = inside
            total += add(step("ReverseAntiPrimaryGap" if d == "R" else "ForwardAntiPrimaryGap", u[1])) + add(step("Length", length)) + add(step("LengthDifference", u[1] - length))
            pos["Q" if p == "R" else "R"] += u[1]
            inside = None
        elif inside:
            p, s, d = inside
            mine = seqs[p][pos[p]] if u != "D" else None
            theirs = None if u == "I" else seqs[s][second - 1].translate(COMPLEMENT) if d == "R" else seqs[s][second]
            total += add(subst["secondary", theirs, mine] if u == "M" else gaps["secondary", mine or theirs][before == u])
            pos[p] += u != "D"
            length += u != "D"
            second += (u != "I") * (-1 if d == "R" else 1)
        else:
            a, b = r[pos["R"]] if u != "I" else None, q[pos["Q"]] if u != "D" else None
            total += add(subst["primary", a, b] if u == "M" else gaps["primary", b or a][before == u])
            pos["R"] += u != "I"
            pos["Q"] += u != "D"
        before = u if isinstance(u, str) else None
    return total


def moved(units, at, which, end, right, sizes, start):
    """The units with the which-th switch's end moved by one, or None where it can't be."""
    units, enter = list(units), [i for i, u in enumerate(units) if u[0] == "enter"][which]
    leave = next(i for i in range(enter, len(units)) if units[i][0] == "leave")
    _, p, s, d, first = units[enter]
    into = right == (end == "end")
    gap = units[leave][1] + (1 if into else -1)
    place = lambda upto: position(units[:upto], start)
    shift = (2 if into else -2) * (d == "R")
    if end == "start":
        beside = enter - 1 if into else enter + 1
        if beside < 0 or units[beside] != "M":
            return None
        pos = place(enter)
        if into:
            second = pos[s] + first
            if second >= sizes[s] if d == "R" else second == 0:
                return None
        elif pos["R"] >= sizes["R"] or pos["Q"] >= sizes["Q"]:
            return None
        units[leave], units[enter] = ("leave", gap), ("enter", p, s, d, first + shift)
        units[beside], units[enter] = units[enter], "M"
        return units
    beside = leave + 1 if into else leave - 1
    if beside >= len(units) or units[beside] != "M":
        return None
    if into:
        taken = sum(u != "I" for u in units[enter + 1 : leave])
        second = place(enter)[s] + first + (-taken if d == "R" else taken)
        if second == 0 if d == "R" else second >= sizes[s]:
            return None
    elif 0 in place(leave + 1).values():
        return None
    units[leave] = ("leave", gap)
    units[beside], units[leave] = units[leave], "M"
    return units


def position(units, start):
    pos, inside = dict(start), None
    for u in units:
        if u[0] == "enter":
            inside = u[1]
        elif u[0] == "leave":
            pos["Q" if inside == "R" else "R"] += u[1]
            inside = None
        elif inside:
            pos[inside] += u != "D"
        else:
            pos["R"] += u != "I"
            pos["Q"] += u != "D"
    return pos


def by_hand(units, r, q, c, at):
    out, sizes, start = [], {"R": len(r), "Q": len(q)}, dict(zip("RQ", at))
    for which in range(sum(u[0] == "enter" for u in units)):
        current, ranges = cost_of(units, r, q, c, at), []
        for end in ("start", "end"):
            for right in (False, True):
                now, n = units, 0
                while (now := moved(now, at, which, end, right, sizes, start)) is not None:
                    cost = cost_of(now, r, q, c, at)
                    if cost > current:
                        break
                    current, n = cost, n + 1
                ranges.append(n if right else -n)
        out.append(tuple(ranges))
    return out


def some_alignment(rng, dirs="R"):
    """Sequences, units and start of a legal alignment with one or two switches."""
    while True:
        r, q = ("".join(rng.choices("ACGT", [5, 2, 1, 1], k=rng.randrange(40, 90))) for _ in range(2))
        if rng.random() < 0.5:
            q = r[: len(q)] + q[len(r) :]
        start = {"R": rng.randrange(4), "Q": rng.randrange(4)}
        units = []
        some = lambda n: [x for _ in range(n) for x in rng.choices(["M", "I", "D"], [12, 1, 1])]
        for _ in range(rng.choice([1, 1, 2])):
            units += some(rng.randrange(12))
            units += [("enter", rng.choice("RQ"), rng.choice("RQ"), rng.choice(dirs), rng.randrange(-20, 30)), *some(rng.randrange(10, 16)), ("leave", rng.randrange(2, 22))]
        units += some(rng.randrange(12))
        try:  # inside the sequences everywhere
            pos, sizes, legal = dict(start), {"R": len(r), "Q": len(q)}, True
            for i, u in enumerate(units):
                pos = position(units[: i + 1], start)
                legal &= all(0 <= pos[x] <= sizes[x] for x in "RQ")
                if u[0] == "enter":
                    stop = next(j for j in range(i, len(units)) if units[j][0] == "leave")
                    taken, second = sum(x != "I" for x in units[i + 1 : stop]), position(units[:i], start)[u[2]] + u[4]
                    legal &= (taken <= second <= sizes[u[2]]) if u[3] == "R" else (0 <= second and second + taken <= sizes[u[2]])
            if legal:
                return r, q, units, (start["R"], start["Q"])
        except (StopIteration, IndexError):
            pass


def as_rows(pair, units, r, q, start):
    rows = []
    for i, u in enumerate(units):
        inside = sum(x[0] == "enter" for x in units[: i + 1]) > sum(x[0] == "leave" for x in units[:i])
        if u[0] == "enter":
            rows.append((1, ops.ENTRANCE, u[4], u[1], u[2], u[3], None))
        elif u[0] == "leave":
            rows.append((1, ops.EXIT, None, None, None, None, u[1]))
        else:
            part = "Secondary" if inside else "Primary"
            pos = position(units[:i], start)
            if u == "M" and not inside:
                what = "Match" if r[pos["R"]] == q[pos["Q"]] else "Substitution"
            elif u == "M":
                enter = max(j for j in range(i) if units[j][0] == "enter")
                _, p, s, d, first = units[enter]
                second = position(units[:enter], start)[s] + first + sum(x != "I" for x in units[enter + 1 : i]) * (-1 if d == "R" else 1)
                seqs = {"R": r, "Q": q}
                what = "Match" if seqs[p][pos[p]] == (seqs[s][second - 1].translate(COMPLEMENT) if d == "R" else seqs[s][second]) else "Substitution"
            else:
                what = {"I": "Insertion", "D": "Deletion"}[u]
            rows.append((1, part + what, None, None, None, None, None))
    merged = []
    for row in rows:
        if merged and merged[-1][1] == row[1] and row[1] not in (ops.ENTRANCE, ops.EXIT):
            merged[-1] = (merged[-1][0] + 1, *row[1:])
        else:
            merged.append(row)
    return [(pair, i, *row) for i, row in enumerate(merged)]


def test_equal_cost_ranges(spark):
    """Also with focus ranges, gaps beside and inside switches, several switches, both directions, and costs that fall."""
    rng = random.Random(8)
    for name, dirs in (("bench", "R"), ("sample", "RF")):
        costs = of_set(load_costs(spark), name)
        c, want, rows, pairs = tables(costs), {}, [], []
        for i in range(150):
            r, q, units, at = some_alignment(rng, dirs)
            if cost_of(units, r, q, c, at) == float("inf"):
                continue
            pairs.append((f"p{i}", r, q, *at))
            rows += as_rows(f"p{i}", units, r, q, dict(zip("RQ", at)))
            want |= {(f"p{i}", k + 1): x for k, x in enumerate(by_hand(units, r, q, c, at))}
        p = spark.createDataFrame(pairs, "pair_id string, r_seq string, q_seq string, r_start int, q_start int")
        o = spark.createDataFrame(rows, OPS)
        # the cost of all of them first, as the oracle and the library see it
        assert ops.verify_ops(ops.flatten_ops(o), p).count() == 0
        found = shifts.equal_cost_ranges(o, p, costs)
        got = {(x.pair_id, x.ts_idx): tuple(x)[2:] for x in found.collect()}
        assert got == want and len(got) > 60
        assert sum(x != (0, 0, 0, 0) for x in got.values()) > 20
        text = ops.cigar(shifts.with_ranges(o, found)).where(F.col("cigar").contains("[-]")).count()
        assert text == 0


def test_costs_of_switches_in_focus_ranges(spark):
    rng = random.Random(9)
    costs = of_set(load_costs(spark), "bench")
    c, rows, pairs, want = tables(costs), [], [], {}
    for i in range(60):
        r, q, units, at = some_alignment(rng)
        pairs.append((f"p{i}", r, q, *at))
        rows += as_rows(f"p{i}", units, r, q, dict(zip("RQ", at)))
        cost = cost_of(units, r, q, c, at)
        want[f"p{i}"] = None if cost == float("inf") else cost
    p = spark.createDataFrame(pairs, "pair_id string, r_seq string, q_seq string, r_start int, q_start int")
    got = {x.pair_id: x.cost for x in ops.alignment_cost(spark.createDataFrame(rows, OPS), p, costs).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 20
