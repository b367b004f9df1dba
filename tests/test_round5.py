"""Tables, costs and k-mers of many pairs in one pass of vectors."""

import random
import time

from helixtab.operators import anchors, relax, tables
from helixtab.sources.costs import load_costs, of_set


def by_hand(a, b, subst, open_, extend, match):
    far = 1 << 40
    last = [(0, far, far)] + [(far, open_ + (j - 1) * extend, far) for j in range(1, len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [(far, far, min(min(last[0][:2]) + open_, last[0][2] + extend))]
        for j in range(1, len(b) + 1):
            m = min(last[j - 1]) + (match if a[i - 1] == b[j - 1] else subst)
            row.append((m, min(min(row[-1][0], row[-1][2]) + open_, row[-1][1] + extend), min(min(last[j][:2]) + open_, last[j][2] + extend)))
        last = row
    return min(last[-1])


def test_gap_affine_costs_of_any_characters(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ACÄ\x7f一\U0001f9ec\0G", k=rng.randrange(12))), "".join(rng.choices("ACÄÖ\x7f丁一\U0001f9ecG", k=rng.randrange(14)))) for i in range(200)] + [(200, None, "A"), (201, "C" * 99, "G" * 98)]
    pairs = spark.createDataFrame(rows, "pair_id long, r_seq string, q_seq string")
    for c in ((2, 3, 1, 0), (4, 1, 2, 0), (2, 2, 2, -1), (1, 5, 5, 3)):
        got = {r.pair_id: r.cost for r in relax.gap_affine_costs(pairs, *c).collect()}
        assert got == {i: None if a is None else by_hand(a, b, *c) for i, a, b in rows}


def test_gap_affine_costs_in_little_time(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ACGT", k=40)), "".join(rng.choices("ACGT", k=40))) for i in range(40_000)]
    pairs = spark.createDataFrame(rows, "pair_id long, r_seq string, q_seq string").repartition(8).cache()
    pairs.count()
    began = time.time()
    assert relax.gap_affine_costs(pairs, 2, 3, 1).where("cost is null").count() == 0
    assert time.time() - began < 15


def test_tables_without_states(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ACGT", k=rng.randrange(30))), "".join(rng.choices("ACGT", k=rng.randrange(30)))) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id long, r_seq string, q_seq string")
    costs = of_set(load_costs(spark), "bench")
    for backwards in (False, True):
        whole = tables.gap_affine_table(pairs, costs, backwards)
        assert sorted(whole.select("pair_id", "i", "j", "cost").collect()) == sorted(tables.gap_affine_table(pairs, costs, backwards, states=False).collect())
        assert whole.count() == sum((len(a) + 1) * (len(b) + 1) for _, a, b in rows)


def test_kmers_in_one_pass(spark):
    rows = [(1, "ACGTÄACG", "GGTTA", 1, 7, 0, 5), (2, "AC", None, 0, 2, 0, 0), (3, "ACGTA", "TTTTTT", 0, 5, 2, 4)]
    pairs = spark.createDataFrame(rows, "pair_id int, r_seq string, q_seq string, r_start int, r_limit int, q_start int, q_limit int")
    found = anchors.kmers(pairs, 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + found._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 1
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = set()
    for i, r, q, *at in rows:
        for side, s, lo, hi in (("R", r, *at[:2]), ("Q", q, *at[2:])):
            if s is not None:
                want |= {(i, side, "F", x, s[x : x + 3]) for x in range(lo, hi - 2)}
                want |= {(i, side, "C", len(s) - x, back(s)[x : x + 3]) for x in range(len(s) - 2)}
    got = found.where("pair_id <> 1 or side = 'Q' or strand = 'F'").collect()
    assert sorted(map(tuple, got)) == sorted(w for w in want if (w[0], w[1], w[2]) != (1, "R", "C"))
