"""Golden rows of the pair operators."""

import random

import pytest
from pyspark.sql import functions as F

from helixtab.functions import seq
from helixtab.operators import anchors, bounds, costs, edges, ops, relax, tables
from helixtab.operators.api import AlignJob
from helixtab.queries import ts_ops
from helixtab.sources.costs import load_costs, of_set
from helixtab.sources.fasta import check_records, make_pairs, read_fasta, read_results, write_results


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pair_id long, r_seq string, q_seq string")


def test_anchors(spark):
    found = {(r.kind, r.x, r.y) for r in anchors.all_anchors(pairs(spark, ("ACAC", "ACGT")), 2).collect()}
    assert found == {("P", 0, 0), ("P", 2, 0), ("S12", 2, 2), ("S12", 4, 2), ("S21", 4, 0), ("S21", 4, 2), ("S22", 4, 0), ("S22", 3, 1), ("S22", 2, 2)}


def test_blocks(spark):
    found, rejected = anchors.block_seeds(pairs(spark, ("ACTTGGAAAA", "TACTGGAAAAACT"), ("AC", "ACGT")), 3)
    assert {(r.r_lo, r.r_hi, r.q_lo, r.q_hi) for r in found.collect()} == {(0, 3, 1, 4), (0, 3, 10, 13), (3, 6, 3, 6), (6, 10, 6, 10), (6, 10, 7, 11)}
    assert [r.pair_id for r in rejected.collect()] == [1]


@pytest.mark.parametrize(("r", "q", "c", "want"), [("ACGT", "ACGTT", (2, 3, 1, 0), 3), ("CGCCGTGTTC", "CGGTGTTAAC", (2, 3, 1, 0), 8), ("A" * 20, "T" * 20, (3, 3, 1, 0), 44), ("AGT", "GTCC", (2, 4, 1, 0), 9), ("", "AC", (2, 3, 1, 0), 4), ("", "", (2, 3, 1, 0), 0)])
def test_gap_affine(spark, r, q, c, want):
    assert relax.gap_affine_costs(pairs(spark, (r, q)), *c).first().cost == want


def test_buckets_and_complement(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 9)], "n int")
    assert [r.b for r in df.select(seq.length_bucket(F.col("n"), F.lit(1)).alias("b")).collect()] == [1, 2, 4, 8, 16]
    one = spark.createDataFrame([("ACGTN",)], "s string")
    assert one.select(seq.revcomp(seq.revcomp(F.col("s"))).alias("s")).first().s == "ACGTN"


def test_ranges(spark):
    good, bad = seq.embedded_range(pairs(spark, ("ACCA|GGAA|TTGG", "AGCA|GGAA|TAGG"), ("AC|GT", "AC")))
    r = good.first()
    assert (r.r_seq, r.r_start, r.r_limit, r.q_start, r.q_limit) == ("ACCAGGAATTGG", 4, 8, 4, 8)
    assert [x.pair_id for x in bad.collect()] == [1]


def test_explicit_ranges(spark):
    rows = [("R1..3Q0..2", None), ("R3..1", None), ("Q0..5", None), ("R1..2", 1), ("nonsense", None), (None, 2), (None, 9), ("R4..4", None)]
    df = spark.createDataFrame([(i, "ACGT", "AC", s, v) for i, (s, v) in enumerate(rows)], "pair_id int, r_seq string, q_seq string, spec string, r_start int").withColumns({c: F.lit(None).cast("int") for c in ("r_limit", "q_start", "q_limit")})
    good, bad = seq.explicit_range(df, "spec")
    assert {r.pair_id: (r.r_start, r.r_limit, r.q_start, r.q_limit) for r in good.collect()} == {0: (1, 3, 0, 2), 5: (2, 4, 0, 2), 7: (4, 4, 0, 2)}
    assert {r.pair_id for r in bad.collect()} == {1, 2, 3, 4, 6}


def test_switch_costs_and_cigar(spark):
    r = "ACGT" * 10 + "AACCGGTTACGATCGATTAC" + "GGGGGCCCCCAAAAATTTTT" + "ACGT" * 10
    q = r[:60] + r[40:60][::-1].translate(str.maketrans("ACGT", "TGCA")) + r[80:]
    p = pairs(spark, (r, q))
    assert ops.alignment_cost(ts_ops(p), p, of_set(load_costs(spark), "bench")).first().cost == 2
    assert ops.cigar(ts_ops(p)).first().cigar == "60=[TSQRR:[-]:[-]:0:20=:20]40="
    assert ops.verify_ops(ops.flatten_ops(ts_ops(p)), p).count() == 0


def test_step_functions(spark):
    assert all(r.increasing and r.v_shaped in (None, True) for r in costs.check_step(load_costs(spark)["step_fn"]).collect())
    shortest = {r.cost_set: r.first_finite for r in costs.step_domain(load_costs(spark)["step_fn"]).where("name = 'Length'").collect()}
    assert shortest == {"sample": 5, "bench": 10, "experiments": 10}


def test_fasta_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_bytes(b">r one two\nAC\r\nG>T\n>q\rACGT\n")
    (tmp_path / "in" / "b.fa").write_text(">x\nA\n")
    found = read_fasta(spark, str(tmp_path / "in"))
    good, bad = check_records(found, 2)
    assert [b.records for b in bad.collect()] == [1]
    p = make_pairs(good).first()
    assert (p.r_name, p.r_seq, p.q_name, p.q_seq) == ("r", "ACG>T", "q", "ACGT")
    write_results(spark.createDataFrame([(1, "WithTarget", 2.0)], "pair_id long, type string, cost double"), str(tmp_path / "out"))
    assert read_results(spark, str(tmp_path / "out")).first().runtime == 0.0


def test_align_job(spark):
    got = {r.pair_id: (r.type, r.cost) for r in AlignJob(spark, "bench").run(pairs(spark, ("ACGT", "ACGTT"), ("AAAA", "TTTT")), cost_limit=5).collect()}
    assert got == {0: ("WithTarget", 3.0), 1: ("WithoutTarget", 5.0)}
    job = AlignJob(spark, "sample")
    p = pairs(spark, ("ACNGT", "ACTGTT"), ("AA#", "AAA"))
    assert {r.pair_id: (r.type, r.cost) for r in job.run(p).collect()} == {0: ("WithTarget", 3.0), 1: ("WithoutTarget", None)}
    assert {r.pair_id: r.cigar for r in job.cigar(p).collect()} == {0: "2=1X2=1I"}
    assert job.stats(p).first().pair_id == 0
    with pytest.raises(ValueError):
        AlignJob(spark, "bench", "somewhere")


def test_parsed_ops(spark):
    rows = spark.createDataFrame([(1, 0, 3, "PrimaryMatch"), (1, 1, 1, "Nonsense"), (2, 0, 0, "PrimaryDeletion"), (2, 1, 1, None)], "pair_id long, op_idx int, n int, kind string")
    good, bad = ops.parse_ops(rows)
    assert [r.kind for r in good.collect()] == ["PrimaryMatch"] and sorted((r.pair_id, r.op_idx) for r in bad.collect()) == [(1, 1), (2, 0), (2, 1)]


def test_gap_costs():
    """Golden matrices: k = 1, 2, and the jumps; F is a gap that no way is over."""
    far = bounds.NEVER
    assert bounds.gap_costs(2, 1, (2, 3, 1)).tolist() == [[far, 3, 4], [3, 2, 5], [4, 5, 4]]
    assert bounds.gap_costs(4, 2, (2, 3, 1)).tolist() == [[far, 3, 4, 5, 6], [3, 2, 3, 4, 5], [4, 3, 2, 3, 4], [5, 4, 3, 2, 5], [6, 5, 4, 5, 4]]
    six = bounds.gap_costs(6, 3, (2, 3, 1)).tolist()
    assert six[5] == [7, 6, 5, 4, 3, 2, 5] and six[6] == [8, 7, 6, 5, 4, 5, 4]
    jumps = bounds.jump_costs(2, 1, (2, 3, 1), (4, 6, 2)).tolist()
    assert ([2 + x for x in jumps], jumps) == ([2, 4, 6], [0, 2, 4])


def test_chains(spark):
    """Two anchors with a gap between them, lengths that differ, and none at all; against all paths by brute force."""
    p = pairs(spark, ("ACGTTGCATT", "ACGTAGCATT"), ("ACGTTGCATT", "ACGTTGCATTGG"), ("AAAAAAAA", "CCCCCCCC"))
    a = anchors.primary_anchors(anchors.kmers(p, 4))
    found = edges.all_edges(edges.primary_edges(a, 4, 6), edges.diagonal_shortcuts(a), edges.terminal_edges(a, p, 4))
    rows = found.collect()
    table = relax.chain_table(found)
    got = {r.pair_id: r.cost for r in table.where("kind = 'End'").collect()}

    def least(pair, node):
        if node[0] == "Start":
            return 0
        return min((least(pair, (e.from_kind, e.from_x, e.from_y)) + e.cost for e in rows if e.pair_id == pair and (e.to_kind, e.to_x, e.to_y) == node), default=1 << 40)

    assert got == {0: least(0, ("End", 10, 10)), 1: least(1, ("End", 10, 12)), 2: least(2, ("End", 8, 8))} and got[0] == 2 and got[1] == 4 and got[2] == int(bounds.gap_costs(8, 4, (2, 3, 1))[8, 8])
    links = relax.chain_links(table)
    mine = sorted((r.link, r.kind, r.cost_to_end) for r in links.where("pair_id = 0").collect())
    assert mine[0] == (0, "Start", 2) and mine[-1][1:] == ("End", 0)
    at = relax.chain_cost_at(spark.createDataFrame([(0, 0, 0), (0, 5, 5), (0, 11, 0), (9, 1, 1)], "pair_id long, r int, q int"), links)
    assert {(r.pair_id, r.r): r.cost_to_end for r in at.collect()} == {(0, 0): 2, (0, 5): 0, (0, 11): 0, (9, 1): 0}


def test_chain_with_switch(spark):
    """A planted inverted copy: the chain through the switch costs the base cost only, and not if its span is out of
    the limits."""
    r = "ACCATGCAGTTCGATTACGGCATCCGAA" + "TTGACCTGAAGTCGCCATAA" + "CGTACCAGTCTAGGCTAACTGGATCCATTG"
    q = r[:28] + r[28:48][::-1].translate(str.maketrans("ACGT", "TGCA")) + r[48:]
    p = pairs(spark, (r, q))
    a = relax._kept(anchors.all_anchors(p, 6))
    base = of_set(load_costs(spark), "bench")["base_cost"]
    found = edges.all_edges(edges.primary_edges(a, 6, 24), edges.diagonal_shortcuts(a), edges.terminal_edges(a, p, 6, base), edges.secondary_edges(a, 6, 6), edges.jump12_edges(a, 6, base, 6), edges.jump34_edges(a, 6, 6))
    assert relax.chain_ts(found, 6, 10, 199).first().cost == 2 and relax.chain_ts(found, 6, 100, 199).first().cost > 2


def plain_costs(spark, match, subst, open_, extend):
    own = of_set(load_costs(spark), "bench")
    cost = F.when(F.col("c1") == F.col("c2"), match).otherwise(subst).cast("bigint")
    return own | {"subst": own["subst"].withColumn("cost", cost), "gaps": own["gaps"].withColumn("open", F.lit(open_).cast("bigint")).withColumn("extend", F.lit(extend).cast("bigint"))}


@pytest.mark.parametrize(("r", "q", "span", "c", "cost", "cigar"), [("ACGT", "ACGTT", None, (0, 2, 3, 1), 3, "4=1I"), ("ACGCCGTGTTCT", "ACGGTGTTAACT", (1, 11), (0, 2, 3, 1), 8, "2=2D5=2I1="), ("AGT", "GTCC", None, (0, 2, 4, 1), 9, "1D2=2I"), ("A" * 20, "T" * 20, None, (0, 3, 3, 1), 44, None), ("", "AC", None, (0, 2, 3, 1), 4, "2I"), ("", "", None, (0, 2, 3, 1), 0, None)])
def test_alignment(spark, r, q, span, c, cost, cigar):
    p = pairs(spark, (r, q))
    if span:
        p = p.withColumns({f"{s}_{e}": F.lit(v) for s in "rq" for e, v in zip(("start", "limit"), span)})
    own = plain_costs(spark, *c)
    last = tables.gap_affine_table(p, own).orderBy(F.desc("i"), F.desc("j")).first()
    first = tables.gap_affine_table(p, own, backwards=True).orderBy("i", "j").first()
    assert last.cost == first.cost == cost
    if cigar:
        assert ops.cigar(tables.gap_affine_align(p, own)).first().cigar == cigar


def test_alignment_by_character(spark):
    """Costs that differ by character, forwards and backwards, against all alignments by brute force; several pairs of
    other lengths in one batch."""
    own = of_set(load_costs(spark), "bench")
    weight = lambda c: F.ascii(c) % 7
    own = own | {"subst": own["subst"].withColumn("cost", F.when(F.col("c1") == F.col("c2"), 0).otherwise(weight("c1") + 2 * weight("c2")).cast("bigint")), "gaps": own["gaps"].withColumn("open", (weight("c") + 3).cast("bigint")).withColumn("extend", (weight("c") % 3 + 1).cast("bigint"))}
    texts = [("ACGTA", "GTTAC"), ("", "ACG"), ("TTGA", "A"), ("GATTACA", "GCATGC")]
    w = lambda x: ord(x) % 7

    def least(a, b, state=None):
        if not a and not b:
            return 0
        found = []
        if a and b:
            found.append((0 if a[0] == b[0] else w(a[0]) + 2 * w(b[0])) + least(a[1:], b[1:]))
        for x, rest, kind in ((b, (a, b[1:]), "I"), (a, (a[1:], b), "D")):
            if x:
                found.append((w(x[0]) % 3 + 1 if state == kind else w(x[0]) + 3) + least(*rest, kind))
        return min(found)

    p = pairs(spark, *texts)
    fwd = {(r.pair_id, r.i, r.j): r.cost for r in tables.gap_affine_table(p, own).collect()}
    bwd = {(r.pair_id, r.i, r.j): r.cost for r in tables.gap_affine_table(p, own, backwards=True).collect()}
    for k, (a, b) in enumerate(texts):
        assert all(fwd[k, i, j] == least(a[:i], b[:j]) and bwd[k, i, j] == least(a[i:], b[j:]) for i in range(len(a) + 1) for j in range(len(b) + 1))


def test_single_switch(spark):
    """The planted switch, its points, and a pair without one."""
    r = "ACCATGCAGTTCGATTACGGCATCCGAA" + "TTGACCTGAAGTCGCCATAA" + "CGTACCAGTCTAGGCTAACTGGATCCATTG"
    q = r[:48] + r[28:48][::-1].translate(str.maketrans("ACGT", "TGCA")) + r[68:]
    p = pairs(spark, (r, q), ("ACGT", "ACGA")).withColumns({f"{s}_{e}": F.when(F.col("pair_id") == 0, F.lit(v)).otherwise(o) for s in "rq" for e, v, o in (("start", 40, 0), ("limit", 72, 4))})
    found = {x.pair_id: x for x in tables.call_single_ts(p, of_set(load_costs(spark), "bench"), 8).collect()}
    f = found[0]
    assert f.ts_cost == 2 < f.no_ts_cost and f.sp4_q - f.sp1_q == f.length == f.gap == f.sp4_r - f.sp1_r
    inner = {"R": r, "Q": q}[f.s][f.sp2 - f.length : f.sp2][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert inner == {"R": r, "Q": q}[f.p][f.sp1_q : f.sp4_q] and f.first_offset == f.sp2 - f.sp1_q
    assert found[1].ts_cost is None and found[1].no_ts_cost == 2


def test_percentile_of_ranges(spark):
    """The element at floor(p * n) of every group by hand: ties, one hot value, many values in few ranges, nulls, NaN, a null
    group, an empty table."""
    from math import floor

    from helixtab.operators import stats

    rng = random.Random(5)
    rows = [(g, float(rng.choice([7, rng.randrange(40), rng.gauss(0, 1e6)])), rng.choice([None, 1.0, -0.0, 0.0, 2.5])) for g in ["a"] * 900 + [None] * 333 + ["b"] * 5]
    rows += [("c", None, None), ("c", 3.0, None), ("d", float("nan"), 1.0), ("d", 1.0, 1.0), ("e", None, None)]
    df = spark.createDataFrame(rows, "g string, cost double, runtime double")
    for p in (0.0, 0.3, 0.9, 1.0):
        for ranges in (1, 3, 256):
            got = {r.g: (r.cost, r.runtime) for r in stats.summarise_percentile(df, p, ("g",), ranges=ranges).collect()}
            assert set(got) == {"a", "b", "c", "d", None}
            for g, values in got.items():
                for i, value in enumerate(values):
                    own = sorted((r[i + 1] for r in rows if r[0] == g and r[i + 1] is not None), key=lambda x: (x != x, x))
                    want = own[min(floor(p * len(own)), len(own) - 1)] if own else None
                    assert value == want or (value != value and want != want)
    own = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])
    whole = stats.summarise_percentile(df.where("not isnan(cost)"), 0.5).collect()
    assert len(whole) == 1 and whole[0].cost == own[len(own) // 2]
    assert stats.summarise_percentile(df.limit(0), 0.5).count() == 0
