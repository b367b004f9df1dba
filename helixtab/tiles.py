"""Queries over pairs of varied lengths that cover all letters of all documents, and the same in SQL where SQL can.

A document's letters, mapped to ACGT, are cut into tiles of 50 to 190 bases, the last one shorter; none is left out. The
query of a tile has single bases deleted, changed and inserted, and, from 80 bases on, an inverted copy of 18 bases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtab.functions import seq
from helixtab.operators import anchors as an
from helixtab.operators import chains, columns, relax, shifts, tables
from helixtab.operators import costs as co
from helixtab.operators import edges as ed
from helixtab.operators import ops as op
from helixtab.sources.costs import SETS, load_costs, of_set
from helixtab.sources.fasta import check_records, make_pairs

K, QUERIES, ORACLE_SQL = 10, {}, {}  # type: int, dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]

TILES = """letters as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as s, 50 + 20 * (coalesce(doc_id, 0) % 8) as w from documents),
places as (select *, unnest(range(0, cast((length(s) + w - 1) // w as integer))) as t from letters),
refs as (select coalesce(cast(doc_id as varchar), '') || '/' || t as pair_id, substr(s, cast(t * w + 1 as bigint), w) as r_seq from places),
near as (select *, regexp_replace(regexp_replace(regexp_replace(r_seq, '([ACGT]{36})[ACGT]', '\\1', 'g'), '([ACGT]{22})A', '\\1C', 'g'), '([ACGT]{52})', '\\1GT', 'g') as m from refs),
pairs as (select pair_id, r_seq, case when length(m) >= 80 then substr(m, 1, 40) || translate(reverse(substr(m, 11, 18)), 'ACGT', 'TGCA') || substr(m, 59) else m end as q_seq from near)"""


def tiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", letters.alias("s")).where("length(s) > 0").withColumn("w", (50 + 20 * (F.coalesce("doc_id", F.lit(0)) % 8)).cast("int"))
    cut = docs.withColumn("t", F.explode(F.sequence(F.lit(0), (F.ceil(F.length("s") / F.col("w")) - 1).cast("int"))))
    refs = cut.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("t").cast("string")).alias("pair_id"), F.substr("s", F.col("t") * F.col("w") + 1, F.col("w")).alias("r_seq"))
    m = F.regexp_replace(F.regexp_replace(F.regexp_replace("r_seq", "([ACGT]{36})[ACGT]", "$1"), "([ACGT]{22})A", "$1C"), "([ACGT]{52})", "$1GT")
    planted = F.concat(F.substring("m", 1, 40), seq.revcomp(F.substring("m", 11, 18), "dna"), F.substr("m", F.lit(59)))
    return refs.withColumn("m", m).select("pair_id", "r_seq", F.when(F.length("m") >= 80, planted).otherwise(F.col("m")).alias("q_seq"))


def query(name: str, sql: str | None = None, heavy: bool = False):
    """heavy: a pair takes long or becomes many rows, so the pairs are dealt out anew; a part grows no larger with the table."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(seq.dealt(tiles_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet").count() // 512) if heavy else tiles_of(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _costs(p: DataFrame, name: str = "bench") -> dict[str, DataFrame]:
    return of_set(load_costs(p.sparkSession), name)


def _uniform(p: DataFrame, cost: int) -> dict[str, DataFrame]:
    """The bench set with one cost for all edits."""
    own, one = _costs(p), F.lit(cost).cast("bigint")
    return own | {"subst": own["subst"].withColumn("cost", F.when(F.col("c1") == F.col("c2"), 0).otherwise(cost).cast("bigint")), "gaps": own["gaps"].withColumn("open", one).withColumn("extend", one)}


@query("c1_whole_edit_cost", f"with {TILES} select pair_id, cast(2 * levenshtein(r_seq, q_seq) as bigint) as cost from pairs")
def _c1(p):
    return relax.edit_cost(p, 2)


@query("c2_whole_cost", f"with {TILES} select pair_id, cast(2 * levenshtein(r_seq, q_seq) as bigint) as cost from pairs", heavy=True)
def _c2(p):
    return tables.gap_affine_cost(p, _uniform(p, 2))


@query("c3_whole_align", f"with {TILES} select pair_id, cast(2 * levenshtein(r_seq, q_seq) as bigint) as cost, cast(length(r_seq) as bigint) as r_length, cast(length(q_seq) as bigint) as q_length from pairs", heavy=True)
def _c3(p):
    """The alignment's edits cost what the distance is, and its operations cover both sequences."""
    n = lambda *kinds: F.sum(F.when(F.col("kind").isin(*[f"Primary{k}" for k in kinds]), F.col("n")).otherwise(0)).cast("bigint")
    return tables.gap_affine_align(p, _uniform(p, 2)).groupBy("pair_id").agg((2 * n("Substitution", "Insertion", "Deletion")).alias("cost"), n("Match", "Substitution", "Deletion").alias("r_length"), n("Match", "Substitution", "Insertion").alias("q_length"))


@query("c4_whole_switches", heavy=True)
def _c4(p):
    return tables.call_single_ts(p, _costs(p, "experiments"))


@query("w9_equal_cost_ranges", heavy=True)
def _w9(p):
    costs = _costs(p, "experiments")
    return shifts.equal_cost_ranges(relax._kept(tables.align_with_switch(p, costs)), p, costs)


@query("a5_whole_cigar", heavy=True)
def _a5(p):
    costs = _costs(p, "experiments")
    ops = relax._kept(tables.align_with_switch(p, costs))
    return op.cigar(shifts.with_ranges(ops, shifts.equal_cost_ranges(ops, p, costs)))


@query("c6_chain_cost", heavy=True)
def _c6(p):
    return chains.chain_pairs(p, _costs(p), K).select("pair_id", "cost")


@query("c6_c8_chain_links_and_cost_at", heavy=True)
def _c8(p):
    points = p.select("pair_id", F.explode(F.sequence(F.lit(0), F.length("r_seq"), F.lit(10))).alias("r")).withColumn("q", F.col("r"))
    return relax.chain_cost_at(points, chains.links_of(chains.chain_pairs(p, _costs(p), K)))


@query("c7_chain_ts", heavy=True)
def _c7(p):
    return chains.links_of(chains.chain_pairs(p, _costs(p), K, ts=True))


@query("c9_chain_ops", heavy=True)
def _c9(p):
    return chains.chain_ops(p, _costs(p), K, ts=True)


@query("w13_merge_columns", heavy=True)
def _w13(p):
    """The tile as hub of two members: its query, and its query without its first half."""
    own = lambda n, q, start: p.select(F.concat("pair_id", F.lit(n)).alias("pair_id"), F.col("pair_id").alias("hub_id"), "r_seq", q.alias("q_seq"), start.alias("r_start"), F.lit(0).alias("q_start"))
    half = (F.length("r_seq") / 2).cast("int")
    both = own("/whole", F.col("q_seq"), F.lit(0)).unionByName(own("/half", F.substr("q_seq", (F.length("q_seq") / 2).cast("int") + 1), half))
    return columns.merge_columns(tables.gap_affine_align(both, _costs(p)), both)


@query("j2_whole_primary_anchors", f"with {TILES}, k as materialized (select pair_id, side, i as pos, substr(s, i + 1, {K}) as kmer from (select pair_id, side, s, unnest(range(0, length(s) - {K - 1})) as i from (select pair_id, 1 as side, r_seq as s from pairs union all select pair_id, 2, q_seq from pairs) where length(s) >= {K})), a as materialized (select pair_id, kmer, pos as x from k where side = 1), b as materialized (select pair_id, kmer, pos as y from k where side = 2) select pair_id, 'P' as kind, cast(x as integer) as x, cast(y as integer) as y from a join b using (pair_id, kmer)")
def _j2(p):
    return an.pair_anchors(p, K, ("P",))


@query("p6_default_range", f"with {TILES} select pair_id, 0 as r_start, length(r_seq) as r_limit, 0 as q_start, length(q_seq) as q_limit from pairs")
def _p6(p):
    return seq.default_range(p).select("pair_id", *[F.col(c).cast("bigint" if c.endswith("limit") else "int").alias(c) for c in ("r_start", "r_limit", "q_start", "q_limit")])


_STEPS = f"""anchored as (select pair_id, length(r_seq) as n, length(q_seq) as m from pairs)"""


@query("p13_anchor_gaps", f"with {TILES}, {_STEPS} select pair_id, 'P' as kind, n // 2 - {K} as gap1, m // 2 - {K} as gap2 from anchored where n // 2 >= {K} and m // 2 >= {K}")
def _p13(p):
    """From an anchor at the start of both sequences to one in their middles."""
    rows = p.select("pair_id", F.lit("P").alias("kind"), F.lit(0).alias("from_x"), F.lit(0).alias("from_y"), F.expr("length(r_seq) div 2").alias("to_x"), F.expr("length(q_seq) div 2").alias("to_y"))
    return ed.anchor_gaps(rows, K).select("pair_id", "kind", F.col("gap1").cast("bigint").alias("gap1"), F.col("gap2").cast("bigint").alias("gap2"))


@query("p14_ts_span", f"with {TILES}, {_STEPS} select pair_id, greatest(n - (n // 3 - {K}), m // 2 + {K} - m // 4) as span from anchored")
def _p14(p):
    rows = p.select("pair_id", F.length("r_seq").alias("n"), F.length("q_seq").alias("m"))
    return rows.select("pair_id", ed.ts_span(F.col("n"), F.expr("m div 4"), F.expr("n div 3"), F.expr("m div 2"), K).cast("bigint").alias("span"))


_LENGTH = ", ".join(f"({lo}, {hi}, {'null' if c is None else c})" for (lo, c), (hi, _) in zip(SETS["sample"]["length"], [*SETS["sample"]["length"][1:], (1 << 40, None)]))


@query("a9_step_min", f"with {TILES}, {_STEPS}, f(lo, hi, cost) as (values {_LENGTH}) select pair_id, min(cast(cost as bigint)) as least from anchored join f on f.lo < n // 8 + 4 and n // 16 < f.hi group by pair_id")
def _a9(p):
    """The least length cost of a switch between a sixteenth and an eighth of the tile, and three bases more."""
    rows = p.select("pair_id", F.expr("length(r_seq) div 16").alias("lo"), F.expr("length(r_seq) div 8 + 4").alias("hi"))
    return co.step_min(rows, "lo", "hi", _costs(p, "sample")["step_fn"], "Length", "least").select("pair_id", "least")


@query("s2_s3_records_and_pairs", f"with {TILES} select pair_id, 'r' as r_name, r_seq, 'q' as q_name, q_seq from pairs where length(q_seq) % 5 <> 0")
def _s3(p):
    """Records of a file for each tile; files of tiles whose query's length is a multiple of five have one record too many, and are
    rejected by their count."""
    record = lambda i, name, s: F.struct(F.lit(i).alias("rec_idx"), F.lit(name).alias("id"), F.lit("").alias("comment"), s.alias("seq"))
    extra = F.when(F.length("q_seq") % 5 == 0, F.array(record(2, "x", F.lit("A")))).otherwise(F.array())
    files = p.select(F.col("pair_id").alias("file"), F.explode(F.concat(F.array(record(0, "r", F.col("r_seq")), record(1, "q", F.col("q_seq"))), extra)).alias("x")).select("file", "x.*")
    return make_pairs(check_records(files, 2)[0])
