"""Anchors in one pass, long and oddly shaped alignments, switches against all of them, and whole jobs."""

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtab.operators import anchors, ops, tables
from helixtab.operators.api import AlignJob, align_pairs
from helixtab.sources.costs import load_costs, of_set
from helixtab.sources.fasta import check_records, make_pairs, read_fasta
from tests.test_shifts import cost_of
from tests.test_shifts import tables as dictionaries

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def mutated(rng, s, rate):
    out = []
    for c in s:
        x = rng.random()
        if x < rate:
            out.append(rng.choice("ACGT"))
        elif x < 1.5 * rate:
            out.append(c + "".join(rng.choices("ACGT", k=rng.randrange(1, 6))))
        elif x > 2 * rate:
            out.append(c)
    return "".join(out)


def test_anchors_in_one_pass(spark):
    """The same as joins of k-mers, with ranges, other letters, k from 1 to 64, short and null sequences."""
    rng = random.Random(2)
    rows = [(f"p{i}", "".join(rng.choices("ACGTN", [3, 3, 1, 1, 0.2], k=rng.randrange(0, 60))), "".join(rng.choices("ACGT", [3, 3, 1, 1], k=rng.randrange(0, 60)))) for i in range(60)]
    rows += [("same", "ACGT" * 30, "ACGT" * 30), ("null", None, "ACGT"), ("lower", "acgtRYK" * 5, "acgtRYK" * 5)]
    df = spark.createDataFrame([(i, r, q, 3 if i == "p7" else None, 20 if i == "p7" else None) for i, r, q in rows], "pair_id string, r_seq string, q_seq string, r_start int, q_limit int")
    df = df.withColumns({"q_start": F.lit(None).cast("int"), "r_limit": F.lit(None).cast("int")})
    for k in (1, 3, 8, 33, 64):
        km = anchors.kmers(df.where("r_seq is not null"), k)
        want = sorted(map(tuple, anchors.primary_anchors(km).unionByName(anchors.secondary_anchors(km)).collect()))
        assert sorted(map(tuple, anchors.pair_anchors(df, k).collect())) == want


def test_kmer_names_by_doubling():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=200)) * 2, "", "AB", "".join(rng.choices("ABC", k=90))]
    for k in (1, 2, 3, 13, 21, 40, 64):
        names = anchors.kmer_names(k, *texts)
        flat = [(int(n), t[i : i + k]) for t, ns in zip(texts, names) for i, n in enumerate(ns)]
        assert [len(n) for n in names] == [max(len(t) - k + 1, 0) for t in texts]
        assert len({n for n, _ in flat}) == len({w for _, w in flat}) == len(set(flat))


def plain_cost(a, b, c, state=None):
    """Least costs by a table of cells, from the ends back."""
    best = {}
    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            for s in "MID":
                ways = [] if i < len(a) or j < len(b) else [0]
                if i < len(a) and j < len(b):
                    ways.append(int(c.subst[ord(a[i]), ord(b[j])]) + best[i + 1, j + 1, "M"])
                if j < len(b):
                    ways.append(int((c.extend if s == "I" else c.open)[ord(b[j])]) + best[i, j + 1, "I"])
                if i < len(a):
                    ways.append(int((c.extend if s == "D" else c.open)[ord(a[i])]) + best[i + 1, j, "D"])
                best[i, j, s] = min(ways)
    return best[0, 0, "M"]


def weights(spark, rng):
    c = tables.Costs.of(of_set(load_costs(spark), "bench"))
    c.subst[:], c.open[:], c.extend[:] = rng.integers(1, 9, (128, 128)), rng.integers(3, 9, 128), rng.integers(1, 4, 128)
    np.fill_diagonal(c.subst, 0)
    return c


def path_cost(a, b, path, c):
    i = j = total = 0
    for n, kind in path:
        for at in range(n):
            if kind.endswith(("Match", "Substitution")):
                assert (a[i] == b[j]) == kind.endswith("Match")
                total, i, j = total + int(c.subst[ord(a[i]), ord(b[j])]), i + 1, j + 1
            elif kind.endswith("Insertion"):
                total, j = total + int((c.extend if at else c.open)[ord(b[j])]), j + 1
            else:
                total, i = total + int((c.extend if at else c.open)[ord(a[i])]), i + 1
    assert (i, j) == (len(a), len(b))
    return total


@pytest.mark.parametrize("band", [1, 32])
def test_solve(spark, monkeypatch, band):
    """Mixed shapes in one call, costs by character, bands that must widen, ways that go back over kept rows."""
    monkeypatch.setattr(tables, "BAND", band)
    rng, c = random.Random(4), weights(spark, np.random.default_rng(4))
    texts = [("", ""), ("A", ""), ("", "ACG"), ("A" * 30, "T"), ("ACGT" * 8, "TGCA" * 9)]
    for _ in range(60):
        a = "".join(rng.choices("ACGT", k=rng.randrange(45)))
        b = mutated(rng, a, 0.1) if rng.random() < 0.6 else "".join(rng.choices("ACGT", k=rng.randrange(45)))
        texts.append((a, b[10:] + b[:10] if rng.random() < 0.2 else b))
    found = tables.solve([a for a, _ in texts], [b for _, b in texts], c, trace=True)
    for (a, b), (cost, path) in zip(texts, found):
        assert cost == plain_cost(a, b, c) == path_cost(a, b, path, c)
    assert [x for x, _ in tables.solve([a for a, _ in texts], [b for _, b in texts], c)] == [x for x, _ in found]


def test_long_pairs_in_little_memory(spark, monkeypatch):
    """5,000 by 5,000: a banded alignment is that of all diagonals, and unlike sequences keep few rows. 60,000 by 1 and
    1 by 60,000 in one batch, which padded to one shape would be 3.6 billion cells."""
    c, rng = tables.Costs.of(of_set(load_costs(spark), "bench")), random.Random(6)
    a = "".join(rng.choices("ACGT", k=5000))
    b = mutated(rng, a, 0.02)
    cost, path = tables.solve([a], [b], c, trace=True)[0]
    assert path_cost(a, b, path, c) == cost < 1000
    monkeypatch.setattr(tables, "BAND", 10_000)
    assert tables.solve([a[:1500]], [b[:1500]], c, trace=True) == tables.solve([a[:1500]], [b[:1500]], c, trace=True)
    whole = tables.solve([a[:1500]], [b[:1500]], c, trace=True)[0]
    monkeypatch.setattr(tables, "BAND", 32)
    assert tables.solve([a[:1500]], [b[:1500]], c, trace=True)[0] == whole
    far = "".join(rng.choices("ACGT", k=5000))
    cost, path = tables.solve([a], [far], c, trace=True)[0]
    assert path_cost(a, far, path, c) == cost > 2000
    odd = tables.solve(["ACGTTT" * 10_000, "A"], ["G", "ACGTTT" * 10_000], c, trace=True)
    # 59,999 gap characters; two gaps around the match cost one opening more
    assert [x for x, _ in odd] == [3 + 59_998 + 2, 3 + 59_998]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2_000_000


def all_switches(r, q, ranges, c, fwd, bwd):
    """The least cost of a reverse switch without errors inside, over all of them."""
    (r0, r1, q0, q1), best = ranges, None
    seqs = {"R": (r, r0, r1), "Q": (q, q0, q1)}
    finite = lambda name, x: next(v for lo, hi, v in c.steps[name] if lo <= x < hi)
    for p in "RQ":
        (own, lo, hi), (_, o_lo, o_hi) = seqs[p], seqs["Q" if p == "R" else "R"]
        cell = lambda t, d, e, p=p: int(t[d, e] if p == "R" else t[e, d])
        for s in "RQ":
            other = seqs[s][0]
            for d in range(lo, hi):
                for a in range(1, len(other) + 1):
                    n = 0
                    while d + n < hi and a - n > 0 and own[d + n] == other[a - n - 1].translate(COMPLEMENT):
                        n += 1
                        for e in range(o_lo, o_hi + 1):
                            sp1 = d if s == p else e
                            start = cell(fwd, d - lo, e - o_lo) + c.base[p, s] + finite("RRQQOffset" if s == p else "RQQROffset", a - sp1) + finite("Length", n)
                            if start >= tables.INFINITE:
                                continue
                            for f in range(o_lo, o_hi + 1):
                                cost = start + finite("LengthDifference", f - e - n) + finite("ReverseAntiPrimaryGap", f - e) + cell(bwd, d + n - lo, f - o_lo)
                                if cost < tables.INFINITE and (best is None or (cost, -n) < best):
                                    best = (cost, -n)
    return best


def test_switches_against_all(spark):
    """200 random pairs with focus ranges, half with a planted switch of five bases and more: the least cost, and of equal
    ones the greatest length; the operations cost what the call says."""
    rng, costs, rows = random.Random(12), of_set(load_costs(spark), "sample"), []
    c = tables.Costs.of(costs)
    for i in range(200):
        r = "".join(rng.choices("ACGT", k=rng.randrange(8, 24)))
        q = mutated(rng, r, 0.05)
        if i % 2 and len(r) > 14:
            at, to, n = rng.randrange(len(r) - 7), rng.randrange(len(r) - 7), rng.randrange(5, 8)
            q = r[:at] + r[to : to + n][::-1].translate(COMPLEMENT) + r[at + n :]
        lo, q_lo = rng.randrange(3), rng.randrange(3)
        rows.append((f"pair {i}", r, q, lo, len(r) - rng.randrange(3), min(q_lo, len(q)), max(len(q) - rng.randrange(3), min(q_lo, len(q)))))
    p = spark.createDataFrame(rows, "pair_id string, r_seq string, q_seq string, r_start int, r_limit int, q_start int, q_limit int")
    got = {x.pair_id: x for x in tables.call_single_ts(p, costs).collect()}
    for name, r, q, r0, r1, q0, q1 in rows:
        fwd, bwd = (tables._grid([r[r0:r1]], [q[q0:q1]], c, back)[0] for back in (False, True))
        best = all_switches(r, q, (r0, r1, q0, q1), c, fwd, bwd)
        x = got[name]
        assert (x.ts_cost, x.length and -x.length) == (best or (None, None)), name
    assert sum(x.ts_cost is not None and x.ts_cost < x.no_ts_cost for x in got.values()) > 20
    cost = {x.pair_id: x.cost for x in ops.alignment_cost(tables.align_with_switch(p, costs), p, costs).collect()}
    assert all(min(v for v in (x.ts_cost, x.no_ts_cost) if v is not None) == cost.get(x.pair_id, 0) for x in got.values())
    assert ops.verify_ops(ops.flatten_ops(tables.align_with_switch(p, costs)), p).count() == 0
    with pytest.raises(ValueError):
        tables.call_single_ts(p, costs, 8)


def test_fasta_to_cigar(spark, tmp_path):
    """The library's own pairs, whose ids are texts; a switch of six bases, which the set allows."""
    r = "ACCATGCAGTTCGATTACGGCATCCGAACTTGACCTGAAGTCGCCATAA"
    q = r[:20] + r[20:26][::-1].translate(COMPLEMENT) + r[26:]
    (tmp_path / "a.fa").write_text(f">r parent\n{r[:30]}\n{r[30:]}\n>q\n{q}\n")
    (tmp_path / "b.fa").write_text(">r\nACGT\n>q\nACGTT\n")
    p = make_pairs(check_records(read_fasta(spark, str(tmp_path)), 2)[0]).withColumn("pair_id", F.regexp_extract("pair_id", r"(\w+)\.fa$", 1))
    job = AlignJob(spark, "sample")
    got = {x.pair_id: x.cigar for x in job.cigar(p).collect()}
    assert got["b"] == "4=1I" and "[TS" in got["a"] and "[-]" not in got["a"]
    plain = AlignJob(spark, "sample", no_ts=True)
    assert "TS" not in {x.pair_id: x.cigar for x in plain.cigar(p).collect()}["a"]
    one, two = ({x.pair_id: x.cost for x in j.run(p).collect()} for j in (job, plain))
    assert one["a"] < two["a"] and one["b"] == two["b"] == 3
    assert {x.pair_id: (x.cost, x.template_switch_amount) for x in job.stats(p).collect()} == {"a": (one["a"], 1.0), "b": (3.0, 0.0)}
    assert {x.pair_id: x.type for x in align_pairs(p, cost_set="sample", no_ts=True, cost_limit=3).collect()} == {"a": "WithoutTarget", "b": "WithTarget"}


def test_fasta_in_splits(spark, tmp_path):
    """One file over many tasks gives the records in its order; all line ends; what is before the first record."""
    rng = random.Random(14)
    want = [(f"id{i}", f"of {i}" if i % 3 else "", "".join(rng.choices("ACGT>", k=rng.randrange(200)))) for i in range(400)]
    want = [(a, b, c.lstrip(">")) for a, b, c in want]
    text = "".join(f">{a} {b}\n" + "\n".join(c[k : k + 60].lstrip(">") if k else c[:60] for k in range(0, len(c), 60)) + "\n" for a, b, c in want)
    want = [(a, b, c[:60] + "".join(c[k : k + 60].lstrip(">") for k in range(60, len(c), 60))) for a, b, c in want]
    (tmp_path / "many").mkdir()
    for name, end in (("n", "\n"), ("rn", "\r\n"), ("r", "\r")):
        (tmp_path / "many" / f"{name}.fa").write_bytes(("  \n" if name == "rn" else "").encode() + text.replace("\n", end).encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = read_fasta(spark, str(tmp_path / "many"))
        assert spark.read.option("lineSep", "\n>").text(str(tmp_path / "many")).rdd.getNumPartitions() > 10
        got: dict[str, list] = {}
        for r in found.collect():
            got.setdefault(r.file.rpartition("/")[2], []).append((r.rec_idx, r.id, r.comment, r.seq))
        assert set(got) == {"n.fa", "rn.fa", "r.fa"}
        for rows in got.values():
            assert [x[0] for x in sorted(rows)] == list(range(400)) and [tuple(x[1:]) for x in sorted(rows)] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.fa").write_text("hello\n>a\nACGT\n")
    with pytest.raises(Exception, match="before the first record"):
        read_fasta(spark, str(tmp_path / "bad")).collect()


def test_null_and_empty_sequences(spark):
    p = spark.createDataFrame([("n", None, "ACGT"), ("e", "", ""), ("g", "", "AC"), ("b", "ACGT", None), ("clash", "A", "A")], "pair_id string, r_seq string, q_seq string").withColumn("a", F.lit("x"))
    for no_ts in (False, True):
        job = AlignJob(spark, "bench", no_ts=no_ts)
        assert {x.pair_id: (x.status, x.cost) for x in job.run(p).collect()} == {"n": ("NoTarget", None), "b": ("NoTarget", None), "e": ("FoundTarget", 0.0), "g": ("FoundTarget", 4.0), "clash": ("FoundTarget", 0.0)}
        assert {x.pair_id for x in job.alignments(p).collect()} == {"g", "clash"}
    assert AlignJob(spark, "bench").run(p.limit(0)).count() == 0


def test_oracle_of_costs(spark):
    """The tests' own cost of an alignment is the library's."""
    c = dictionaries(of_set(load_costs(spark), "bench"))
    r, q = "ACGTACGTTTACGGGACCATTACG", "ACGTACGATTACGGGACCATTAC"
    assert cost_of(["M"] * 23 + ["D"], r, q, c, (0, 0)) == 2 * sum(x != y for x, y in zip(r[:23], q)) + 3
