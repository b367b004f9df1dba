"""Queries over pairs that are derived from the documents table, and the same in SQL.

A document's letters, mapped to ACGT, give a reference of 120 bases; in the query, bases 61 to 80 are the reverse
complement of bases 41 to 60.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtab import tiles
from helixtab.functions import seq
from helixtab.operators import anchors as an
from helixtab.operators import bounds
from helixtab.operators import costs as co
from helixtab.operators import edges as ed
from helixtab.operators import ops as op
from helixtab.operators import relax, stats, tables
from helixtab.sources.costs import _rows, load_costs, of_set

#: k-mer length, and the longest gap of an edge (as in the SQL).
K, GAP = 8, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PAIRS = """letters as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents),
refs as (select doc_id, substr(seq, 1, 120) as r_seq from letters where length(seq) >= 200),
pairs as (select doc_id as pair_id, r_seq, substr(r_seq, 1, 60) || translate(reverse(substr(r_seq, 41, 20)), 'ACGT', 'TGCA') || substr(r_seq, 81, 40) as q_seq from refs)"""
_KMERS = f"""{_PAIRS},
fwd as materialized (select pair_id, side, pos, substr(s, pos + 1, {K}) as kmer from (select pair_id, 'R' as side, r_seq as s, unnest(range(0, 120 - {K} + 1)) as pos from pairs union all select pair_id, 'Q', q_seq, unnest(range(0, 120 - {K} + 1)) from pairs)),
rc as materialized (select pair_id, side, 120 - i as pos, substr(s, i + 1, {K}) as kmer from (select pair_id, 'R' as side, translate(reverse(r_seq), 'ACGT', 'TGCA') as s, unnest(range(0, 120 - {K} + 1)) as i from pairs union all select pair_id, 'Q', translate(reverse(q_seq), 'ACGT', 'TGCA'), unnest(range(0, 120 - {K} + 1)) from pairs)),
anchors as materialized (select pair_id, 'P' as kind, a.pos as x, b.pos as y from fwd a join fwd b using (pair_id, kmer) where a.side = 'R' and b.side = 'Q'
 union all select pair_id, 'S' || (case when a.side = 'R' then '1' else '2' end) || (case when b.side = 'R' then '1' else '2' end), a.pos, b.pos from rc a join fwd b using (pair_id, kmer))"""
_FLAT = f"""{_PAIRS},
flat as (select pair_id, i as op_idx, case when substr(r_seq, i + 1, 1) = substr(q_seq, i + 1, 1) then 'PrimaryMatch' else 'PrimarySubstitution' end as kind from (select *, unnest(range(0, 120)) as i from pairs)),
isl as (select *, op_idx - row_number() over (partition by pair_id, kind order by op_idx) as island from flat),
runs as (select pair_id, kind, min(op_idx) as lo, count(*) as n from isl group by pair_id, kind, island),
ops as (select pair_id, row_number() over (partition by pair_id order by lo) - 1 as op_idx, n, kind from runs)"""


def _literal(table: str) -> str:
    """A cost table as VALUES."""
    names = {"base_cost": "cost_set, p, s, dir, cost", "step_fn": "cost_set, name, lo, hi, cost", "subst": "cost_set, tbl, c1, c2, cost", "gaps": "cost_set, tbl, c, open, extend"}[table]
    one = lambda v: "cast(null as bigint)" if v is None else f"'{v}'" if isinstance(v, str) else f"cast({v} as bigint)"
    return f"{table}({names}) as (values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in _rows()[table]) + ")"


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's first letters are mostly among its first 400 characters; where they aren't, all of it is looked at. Exploded, they
    are found once, not anew for each use of a sequence."""
    letters = lambda text: F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    first = letters(F.substring("text", 1, 400))
    enough = F.when(F.length(first) >= 200, first).otherwise(letters("text"))
    refs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pair_id"), F.explode(F.array(enough)).alias("s")).where("length(s) >= 200").select("pair_id", F.substring("s", 1, 120).alias("r_seq"))
    return refs.withColumn("q_seq", F.concat(F.substring("r_seq", 1, 60), seq.revcomp(F.substring("r_seq", 41, 20), "dna"), F.substring("r_seq", 81, 40)))


def ts_ops(pairs: DataFrame) -> DataFrame:
    """The planted switch as operations."""
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    row = lambda i, n, kind, off=none, p=text, s=text, d=text, gap=none: F.struct(F.lit(i).alias("op_idx"), F.lit(n).alias("n"), F.lit(kind).alias("kind"), off.alias("first_offset"), p.alias("p"), s.alias("s"), d.alias("dir"), gap.alias("gap"))
    rows = [row(0, 60, "PrimaryMatch"), row(1, 1, op.ENTRANCE, F.lit(0), F.lit("Q"), F.lit("R"), F.lit("R")), row(2, 20, "SecondaryMatch"), row(3, 1, op.EXIT, gap=F.lit(20)), row(4, 40, "PrimaryMatch")]
    return pairs.select("pair_id", F.explode(F.array(*rows)).alias("o")).select("pair_id", "o.*")


def flat_ops(pairs: DataFrame) -> DataFrame:
    """The pair without a switch, base against base."""
    rows = pairs.withColumn("op_idx", F.explode(F.sequence(F.lit(0), F.lit(119))))
    kind = F.when(F.substr("r_seq", F.col("op_idx") + 1, F.lit(1)) == F.substr("q_seq", F.col("op_idx") + 1, F.lit(1)), "PrimaryMatch").otherwise("PrimarySubstitution")
    empty = {c: F.lit(None).cast(t) for c, t in (("first_offset", "int"), ("p", "string"), ("s", "string"), ("dir", "string"), ("gap", "int"))}
    return rows.select("pair_id", "op_idx", F.lit(1).alias("n"), kind.alias("kind"), *[v.alias(c) for c, v in empty.items()])


def query(name: str, sql: str | None = None, rows: bool = False):
    """rows: a pair becomes many rows that meet by pair again, so the pairs themselves are dealt out by pair_id first, in
    parts that grow no larger with the table."""

    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(seq.dealt(pairs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet").count() // 4096) if rows else pairs_of(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _anchors(p: DataFrame) -> DataFrame:
    return an.all_anchors(p, K)


@query("p1_normalise", f"with {_PAIRS} select pair_id, upper(translate(lower(r_seq), 'a', '')) as seq from pairs")
def _p1(p):
    return p.select("pair_id", seq.normalise(F.lower("r_seq"), "a").alias("seq"))


@query("p2_alphabet_check", f"with {_PAIRS} select pair_id, regexp_extract(r_seq, '[^ACG]', 0) as bad_char from pairs where r_seq like '%T%'")
def _p2(p):
    return seq.check_alphabet(p.withColumn("seq", F.translate("r_seq", "T", "Z")), ["seq"], "dna")[1].select("pair_id", F.translate("bad_char", "Z", "T").alias("bad_char"))


@query("p3_revcomp", f"with {_PAIRS} select pair_id, reverse(translate(q_seq, 'ACGT', 'TGCA')) as rc from pairs")
def _p3(p):
    return p.select("pair_id", seq.revcomp(F.col("q_seq"), "dna").alias("rc"))


@query("p4_embedded_range", f"with {_PAIRS} select pair_id, r_seq, 50 as r_start, 90 as r_limit, 50 as q_start, 90 as q_limit from pairs")
def _p4(p):
    piped = p.withColumns({f"{s}_seq": F.concat(F.substring(f"{s}_seq", 1, 50), F.lit("|"), F.substring(f"{s}_seq", 51, 40), F.lit("|"), F.substring(f"{s}_seq", 91, 30)) for s in "rq"})
    return seq.embedded_range(piped)[0].select("pair_id", "r_seq", "r_start", "r_limit", "q_start", "q_limit")


@query("p5_explicit_range", f"with {_PAIRS} select pair_id, cast(pair_id % 40 as integer) as r_start, cast(pair_id % 40 + 50 as integer) as r_limit, 0 as q_start, 120 as q_limit from pairs")
def _p5(p):
    spec = F.concat(F.lit("R "), (F.col("pair_id") % 40).cast("string"), F.lit(".."), (F.col("pair_id") % 40 + 50).cast("string"))
    empty = {f"{s}_{e}": F.lit(None).cast("int") for s in "rq" for e in ("start", "limit")}
    return seq.explicit_range(p.withColumn("spec", spec).withColumns(empty), "spec")[0].select("pair_id", "r_start", "r_limit", "q_start", "q_limit")


@query("p7_bases", f"with {_PAIRS} select pair_id, 'R' as side, i as pos, substr(r_seq, i + 1, 1) as base from (select *, unnest(range(0, 120)) as i from pairs) union all select pair_id, 'Q', i, substr(q_seq, i + 1, 1) from (select *, unnest(range(0, 120)) as i from pairs)")
def _p7(p):
    return seq.bases(p)


@query("p8_p9_k_and_bucket", f"with {_PAIRS} select pair_id, greatest(cast(ceil(log2(120 + pair_id % 90)) as integer) - 3, 2) as k, cast(pow(2, ceil(log2(greatest(1 + pair_id % 50, 1)))) as bigint) as bucket from pairs")
def _p8(p):
    n = (F.col("pair_id") % 90).cast("int")
    return p.select("pair_id", seq.infer_k(F.length("r_seq"), n).alias("k"), seq.length_bucket((F.col("pair_id") % 50 + 1).cast("int"), F.lit(1)).alias("bucket"))


@query("j1_kmers", f"with {_KMERS} select pair_id, side, 'F' as strand, pos, kmer from fwd union all select pair_id, side, 'C', pos, kmer from rc")
def _j1(p):
    return an.kmers(p, K)


@query("j2_primary_anchors", f"with {_KMERS} select * from anchors where kind = 'P'")
def _j2(p):
    return an.pair_anchors(p, K, ("P",))


@query("j3_secondary_anchors", f"with {_KMERS} select * from anchors where kind <> 'P'")
def _j3(p):
    return an.pair_anchors(p, K, an.KINDS[1:])


@query("u1_all_anchors", f"with {_KMERS} select * from anchors")
def _u1(p):
    return _anchors(p)


@query("j4_ts_seeds", f"with {_KMERS.replace(f'- {K} + 1', '- 12 + 1').replace(f', {K}) as kmer', ', 12) as kmer')} select pair_id, case when substr(kind, 3, 1) = '1' then 'R' else 'Q' end as p, case when substr(kind, 2, 1) = '1' then 'R' else 'Q' end as s, x, y from anchors where kind <> 'P'")
def _j4(p):
    return an.ts_seeds(p, 12)


_CANDS = "cands as (select pair_id, 'Q' as p, 'R' as s, 60 as x, 60 as y, 2 as cost from pairs union all select pair_id, 'R', 'R', 30, 70, 2 from pairs)"


def _cands(p):
    row = lambda a, b, x, y: F.struct(F.lit(a).alias("p"), F.lit(b).alias("s"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2).alias("cost"))
    return p.select("pair_id", F.explode(F.array(row("Q", "R", 60, 60), row("R", "R", 30, 70))).alias("c")).select("pair_id", "c.*")


@query("j5_filter_entrances", f"with {_KMERS}, {_CANDS} select c.* from cands c where exists (select 1 from anchors a where a.pair_id = c.pair_id and a.x = c.x and a.y = c.y and a.kind = 'S' || (case when c.s = 'R' then '1' else '2' end) || (case when c.p = 'R' then '1' else '2' end))")
def _j5(p):
    return an.filter_entrances(_cands(p), an.ts_seeds(p, K), "filter")


@query("j5_price_entrances", f"with {_KMERS}, {_CANDS} select pair_id, p, s, x, y, cost + (case when exists (select 1 from anchors a where a.pair_id = c.pair_id and a.x = c.x and a.y = c.y and a.kind = 'S' || (case when c.s = 'R' then '1' else '2' end) || (case when c.p = 'R' then '1' else '2' end)) then 0 else 3 end) as cost from cands c")
def _j5p(p):
    return an.filter_entrances(_cands(p), an.ts_seeds(p, K), "price", 3)


_BLOCKS = f"{_PAIRS}, blocks as (select pair_id, a.i * 10 as r_lo, a.i * 10 + 10 as r_hi, b.i as q_lo, b.i + 10 as q_hi from (select *, unnest(range(0, 12)) as i from pairs) a join (select pair_id as q_id, q_seq as qs, unnest(range(0, 111)) as i from pairs) b on a.pair_id = b.q_id and substr(a.r_seq, a.i * 10 + 1, 10) = substr(b.qs, b.i + 1, 10))"


@query("j6_block_seeds", f"with {_BLOCKS} select * from blocks")
def _j6(p):
    return an.block_seeds(p, 10)[0]


@query("j7_lookup_anchors", f"with {_KMERS} select * from anchors where kind = 'P' and x = y and x % 7 = 0")
def _j7(p):
    coords = p.select("pair_id", F.lit("P").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(119), F.lit(7))).alias("x")).withColumn("y", F.col("x"))
    return an.lookup_anchors(coords, _anchors(p)).select("pair_id", "kind", "x", "y")


@query("w8_match_runs", f"with {_KMERS}, l as (select *, case when kind = 'P' then y - x else x + y end as line from anchors), i as (select *, y - row_number() over (partition by pair_id, kind, line order by y) as island from l) select pair_id, kind, arg_min(x, y) as x, min(y) as y, count(*) + {K - 1} as length from i group by pair_id, kind, line, island")
def _w8(p):
    return an.match_runs(_anchors(p), K)


@query("t1_order_anchors", f"with {_KMERS} select *, row_number() over (partition by pair_id, kind order by least(x, y), x, y) - 1 as idx from anchors")
def _t1(p):
    return an.order_anchors(_anchors(p))


@query("a6_anchor_counts", f"with {_KMERS} select pair_id, " + ", ".join(f"count(*) filter (kind = '{k}') as n_{k.lower()}" for k in an.KINDS) + " from anchors group by pair_id")
def _a6(p):
    return an.anchor_counts(_anchors(p))


_PR, _SE = "(select * from anchors where kind = 'P')", "(select * from anchors where kind <> 'P')"
_ROWS = lambda name, columns, rows: f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"
_GAPS = lambda name, n, costs: _ROWS(name, "gap1, gap2, cost", [(a, b, c) for (a, b), c in np.ndenumerate(bounds.gap_costs(n, K, costs)) if c < bounds.NEVER])
_JUMPS = lambda n: _ROWS("jumps", "gap, cost", list(enumerate(bounds.jump_costs(n, K, bounds.PRIMARY, bounds.SECONDARY))))
_BOUNDS = ", ".join([_GAPS("pgaps", GAP, bounds.PRIMARY), _GAPS("sgaps", GAP, bounds.SECONDARY), _JUMPS(GAP)])
_NEXT = lambda a, b, on, cost: f"select a.pair_id, a.kind as from_kind, a.x as from_x, a.y as from_y, b.kind as to_kind, b.x as to_x, b.y as to_y, cast({cost} as bigint) as cost from {a} a join {b} b on a.pair_id = b.pair_id and {on}"
# equi-joins: each anchor with each gap it may have, and then with what lies there
_SIDES = "(values ('1'), ('2')) s(side)"
_ON = lambda c, side: f"(case when {side} = '1' then {c}.x else {c}.y end)"
_J8 = _NEXT(f"(select c.*, x + {K} + gap1 as at_x, y + {K} + gap2 as at_y, cost from {_PR} c, pgaps)", _PR, "b.x = a.at_x and b.y = a.at_y", "a.cost") + " union all " + _NEXT(_PR, _PR, "b.x = a.x + 1 and b.y = a.y + 1", "0")
_J9 = _NEXT(f"(select c.*, x - {K} - gap1 as at_x, y + {K} + gap2 as at_y, cost from {_SE} c, sgaps)", _SE, "a.kind = b.kind and b.x = a.at_x and b.y = a.at_y", "a.cost") + " union all " + _NEXT(_SE, _SE, "a.kind = b.kind and b.x = a.x - 1 and b.y = a.y + 1", "0")
_J10 = _NEXT(f"(select c.*, side, {_ON('c', 'side')} + {K} + gap as at_y, cost from {_PR} c, jumps, {_SIDES})", f"(select *, substr(kind, 3, 1) as side from {_SE})", "b.side = a.side and b.y = a.at_y", "2 + a.cost")
_J11 = _NEXT(f"(select c.*, substr(kind, 3, 1) as side, y + {K} + gap as at_y, cost from {_SE} c, jumps)", f"(select c.*, side, {_ON('c', 'side')} as start_y from {_PR} c, {_SIDES})", "b.side = a.side and b.start_y = a.at_y", "a.cost")
_J12 = f"""select pair_id, 'Start' as from_kind, 0 as from_x, 0 as from_y, kind as to_kind, x as to_x, y as to_y, cast(case when x = 0 and y = 0 then 0 else g.cost end as bigint) as cost from {_PR} left join pgaps g on g.gap1 = x and g.gap2 = y where (x = 0 and y = 0) or g.cost is not null
 union all select pair_id, kind, x, y, 'End', 120, 120, cast(case when x = 120 - {K} and y = 120 - {K} then 0 else g.cost end as bigint) from {_PR} left join pgaps g on g.gap1 = 120 - {K} - x and g.gap2 = 120 - {K} - y where (x = 120 - {K} and y = 120 - {K}) or g.cost is not null
 union all select pair_id, 'Start', 0, 0, 'End', 120, 120, cast(g.cost as bigint) from pairs join pgaps g on g.gap1 = 120 and g.gap2 = 120
 union all select pair_id, 'Start', 0, 0, kind, x, y, cast(2 + j.cost as bigint) from {_SE} join jumps j on j.gap = y
 union all select pair_id, kind, x, y, 'End', 120, 120, cast(j.cost as bigint) from {_SE} join jumps j on j.gap = 120 - {K} - y"""


@query("j8_primary_edges", f"with {_KMERS}, {_BOUNDS} {_J8}")
def _j8(p):
    return ed.pair_edges(p, K, GAP, ("primary",))


@query("j9_secondary_edges", f"with {_KMERS}, {_BOUNDS} {_J9}")
def _j9(p):
    return ed.pair_edges(p, K, GAP, ("secondary",))


@query("j10_jump12_edges", f"with {_KMERS}, {_BOUNDS} {_J10}")
def _j10(p):
    return ed.pair_edges(p, K, GAP, ("jump12",), of_set(load_costs(p.sparkSession), "bench")["base_cost"])


@query("j11_jump34_edges", f"with {_KMERS}, {_BOUNDS} {_J11}")
def _j11(p):
    return ed.pair_edges(p, K, GAP, ("jump34",))


@query("j12_terminal_edges", f"with {_KMERS}, {_GAPS('pgaps', 120, bounds.PRIMARY)}, {_JUMPS(120)} {_J12}")
def _j12(p):
    return ed.pair_edges(p, K, GAP, ("terminal",), of_set(load_costs(p.sparkSession), "bench")["base_cost"])


@query("j13_block_edges", f"with {_BLOCKS} select a.pair_id, a.r_lo as from_r_lo, a.r_hi as from_r_hi, a.q_lo as from_q_lo, a.q_hi as from_q_hi, b.r_lo as to_r_lo, b.r_hi as to_r_hi, b.q_lo as to_q_lo, b.q_hi as to_q_hi from blocks a join blocks b on a.pair_id = b.pair_id and b.r_lo >= a.r_hi and b.q_lo - a.q_hi between 0 and 30")
def _j13(p):
    return ed.pair_block_edges(p, 10, 30)


@query("u2_all_edges", f"with {_KMERS}, {_BOUNDS}, e as ({_J8} union all {_J9} union all {_J10} union all {_J11}) select pair_id, from_kind, from_x, from_y, to_kind, to_x, to_y, min(cost) as cost from e group by all")
def _u2(p):
    return ed.pair_edges(p, K, GAP, base_cost=of_set(load_costs(p.sparkSession), "bench")["base_cost"])


@query("t2_top_successors", f"with {_KMERS}, {_BOUNDS}, e as ({_J8}), r as (select *, row_number() over (partition by pair_id, from_kind, from_x, from_y order by cost, to_kind, to_x, to_y) as n, rank() over (partition by pair_id, from_kind, from_x, from_y order by cost) as k from e) select pair_id, from_kind, from_x, from_y, to_kind, to_x, to_y, cost from r where n <= 3 or k = 1")
def _t2(p):
    return ed.pair_edges(p, K, GAP, ("primary",), top=3)


@query("c1_edit_cost", f"with {_PAIRS} select pair_id, cast(2 * levenshtein(r_seq, q_seq) as bigint) as cost from pairs")
def _c1(p):
    return relax.edit_cost(p, 2)


@query("c2_gap_affine_uniform", f"with {_PAIRS} select pair_id, cast(2 * levenshtein(substr(r_seq, 51, 40), substr(q_seq, 51, 40)) as bigint) as cost from pairs")
def _c2(p):
    return relax.gap_affine_costs(p.withColumns({f"{s}_{e}": F.lit(v) for s in "rq" for e, v in (("start", 50), ("limit", 90))}), 2, 2, 2)


@query("c2_gap_affine")
def _c2a(p):
    return relax.gap_affine_costs(p.withColumns({f"{s}_{e}": F.lit(v) for s in "rq" for e, v in (("start", 50), ("limit", 90))}), 2, 3, 1)


def _focus(p: DataFrame) -> DataFrame:
    return p.withColumns({f"{s}_{e}": F.lit(v) for s in "rq" for e, v in (("start", 50), ("limit", 90))})


def _uniform(spark: SparkSession, cost: int) -> dict[str, DataFrame]:
    """The bench set with one cost for all edits."""
    own = of_set(load_costs(spark), "bench")
    same = F.when(F.col("c1") == F.col("c2"), 0).otherwise(cost).cast("bigint")
    return own | {"subst": own["subst"].withColumn("cost", same), "gaps": own["gaps"].withColumn("open", F.lit(cost).cast("bigint")).withColumn("extend", F.lit(cost).cast("bigint"))}


@query("c2_table", f"with {_PAIRS} select pair_id, cast(50 + i as integer) as i, cast(50 + j as integer) as j, cast(2 * levenshtein(substr(r_seq, 51, i), substr(q_seq, 51, j)) as bigint) as cost from pairs, range(0, 41) x(i), range(0, 41) y(j)")
def _c2t(p):
    return tables.gap_affine_table(_focus(p), _uniform(p.sparkSession, 2), states=False)


@query("c2_table_backwards", f"with {_PAIRS} select pair_id, cast(50 + i as integer) as i, cast(50 + j as integer) as j, cast(2 * levenshtein(substr(r_seq, 51 + i, 40 - i), substr(q_seq, 51 + j, 40 - j)) as bigint) as cost from pairs, range(0, 41) x(i), range(0, 41) y(j)")
def _c2b(p):
    return tables.gap_affine_table(_focus(p), _uniform(p.sparkSession, 2), backwards=True, states=False)


@query("c3_align", f"with {_PAIRS} select pair_id, cast(2 * levenshtein(substr(r_seq, 51, 40), substr(q_seq, 51, 40)) as bigint) as cost, cast(40 as bigint) as r_length, cast(40 as bigint) as q_length from pairs")
def _c3(p):
    """The alignment's edits cost what the table says, and its operations cover both ranges."""
    n = lambda *kinds: F.sum(F.when(F.col("kind").isin(*[f"Primary{k}" for k in kinds]), F.col("n")).otherwise(0)).cast("bigint")
    found = tables.gap_affine_align(_focus(p), _uniform(p.sparkSession, 2))
    return found.groupBy("pair_id").agg((2 * n("Substitution", "Insertion", "Deletion")).alias("cost"), n("Match", "Substitution", "Deletion").alias("r_length"), n("Match", "Substitution", "Insertion").alias("q_length"))


@query("c4_single_ts", f"with {_PAIRS} select pair_id, cast(2 as bigint) as ts_cost from pairs")
def _c4(p):
    """The planted switch costs the base cost alone, and no switch costs less."""
    return tables.call_single_ts(_focus(p), of_set(load_costs(p.sparkSession), "bench")).select("pair_id", "ts_cost")


@query("a4_compact_ops", f"with {_FLAT} select pair_id, op_idx, n, kind from ops", rows=True)
def _a4(p):
    return op.compact_ops(flat_ops(p)).select("pair_id", "op_idx", "n", "kind")


@query("a5_cigar", f"with {_FLAT} select pair_id, string_agg(n || (case when kind = 'PrimaryMatch' then '=' else 'X' end), '' order by op_idx) as cigar from ops group by pair_id union all select pair_id, '60=[TSQRR:[-]:[-]:0:20=:20]40=' from pairs", rows=True)
def _a5(p):
    return op.cigar(op.compact_ops(flat_ops(p))).unionByName(op.cigar(ts_ops(p)))


@query("s6_nest_explode", f"with {_FLAT} select pair_id, op_idx, n, kind from ops", rows=True)
def _s6(p):
    return op.explode_ops(op.nest_ops(op.compact_ops(flat_ops(p)))).select("pair_id", "op_idx", "n", "kind")


@query("p10_p11_invert_reverse", f"with {_PAIRS}, o(i, n, k, p, s, d) as (values (4, 60, 'PrimaryMatch', null, null, null), (3, 1, '{op.ENTRANCE}', 'R', 'Q', 'F'), (2, 20, 'SecondaryMatch', null, null, null), (1, 1, '{op.EXIT}', null, null, null), (0, 40, 'PrimaryMatch', null, null, null)) select pair_id, i as op_idx, n, k as kind, p, s, d as dir from pairs, o", rows=True)
def _p10(p):
    return op.reverse_ops(op.invert_ops(ts_ops(p))).select("pair_id", "op_idx", "n", "kind", "p", "s", "dir")


@query("p12_op_info", f"with {_FLAT} select pair_id, op_idx, true as repeatable, 1 as stream_length, 1 as dr, 1 as dq from ops", rows=True)
def _p12(p):
    return op.op_info(op.compact_ops(flat_ops(p))).select("pair_id", "op_idx", "repeatable", "stream_length", "dr", "dq")


@query("w1_flatten_ops", f"with {_FLAT} select pair_id, op_idx, kind from flat", rows=True)
def _w1(p):
    return op.flatten_ops(op.compact_ops(flat_ops(p))).select("pair_id", "op_idx", "kind")


@query("w2_track_coords", f"with {_PAIRS}, o(i, rb, qb, ra, qa) as (values (0, 0, 0, 60, 60), (1, 60, 60, 60, 60), (2, 60, 60, 60, 80), (3, 60, 80, 80, 80), (4, 80, 80, 120, 120)) select pair_id, i as op_idx, rb as r_before, qb as q_before, ra as r_after, qa as q_after from pairs, o", rows=True)
def _w2(p):
    return op.track_coords(ts_ops(p)).select("pair_id", "op_idx", "r_before", "q_before", "r_after", "q_after")


@query("w3_track_secondary", f"with {_PAIRS} select pair_id, 61 + i as op_idx, 60 - i as s_before, 59 - i as s_after from (select pair_id, unnest(range(0, 20)) as i from pairs)", rows=True)
def _w3(p):
    return op.track_secondary(op.flatten_ops(ts_ops(p))).where("kind = 'SecondaryMatch'").select("pair_id", "op_idx", "s_before", "s_after")


@query("w4_switches", f"with {_PAIRS} select pair_id, 1 as ts_idx, 'Q' as p, 'R' as s, 'R' as dir, 0 as first_offset, 60 as sp1_r, 60 as sp1_q, 60 as sp2, 40 as sp3, 80 as sp4_r, 80 as sp4_q, 20 as length, 20 as gap, 0 as difference, '20=' as inner_cigar from pairs", rows=True)
def _w4(p):
    return op.switches(ts_ops(p))


_X = "(select pair_id, 2 * count(*) filter (kind = 'PrimarySubstitution') as cost from flat group by pair_id)"


@query("w5_alignment_cost", f"with {_FLAT} select pair_id, cast(cost as bigint) as cost, 'no_ts' as mode from {_X} union all select pair_id, 2, 'ts' from pairs", rows=True)
def _w5(p):
    costs = of_set(load_costs(p.sparkSession), "bench")
    return op.alignment_cost(op.compact_ops(flat_ops(p)), p, costs).withColumn("mode", F.lit("no_ts")).unionByName(op.alignment_cost(ts_ops(p), p, costs).withColumn("mode", F.lit("ts")))


@query("w6_verify_ops", f"with {_FLAT} select pair_id, op_idx, 'PrimaryMatch' as kind, substr(r_seq, op_idx + 1, 1) as c1, substr(q_seq, op_idx + 1, 1) as c2 from flat join pairs using (pair_id) where kind = 'PrimarySubstitution'", rows=True)
def _w6(p):
    wrong = flat_ops(p).withColumn("kind", F.lit("PrimaryMatch"))
    return op.verify_ops(wrong, p).unionByName(op.verify_ops(op.flatten_ops(ts_ops(p)), p))


@query("w7_ts_context", f"with {_PAIRS} select pair_id, 1 as ts_idx, 'up' as side, 0 as op_idx, 60 as n, 'PrimaryMatch' as kind from pairs union all select pair_id, 1, 'down', 4, 40, 'PrimaryMatch' from pairs", rows=True)
def _w7(p):
    return op.ts_context(ts_ops(p))


@query("w10_extend_range", f"with {_FLAT} select pair_id, coalesce(min(op_idx) filter (kind = 'PrimarySubstitution'), 120) - 30 as steps from flat where op_idx >= 30 group by pair_id")
def _w10(p):
    own = p.withColumn("r", F.lit(30)).withColumn("q", F.lit(30))
    return op.extend_range(own, of_set(load_costs(p.sparkSession), "bench")["subst"], "r", "q", right=True)


@query("w11_gapped_columns", f"with {_FLAT} select pair_id, op_idx as col, substr(r_seq, op_idx + 1, 1) as r_base, substr(q_seq, op_idx + 1, 1) as q_base, kind = 'PrimarySubstitution' as mismatch from flat join pairs using (pair_id)", rows=True)
def _w11(p):
    return op.gapped_columns(op.compact_ops(flat_ops(p)), p).drop("r_before", "q_before")


@query("w12_limit_context", f"with {_PAIRS} select pair_id, i as col from (select pair_id, unnest(range(50, 70)) as i from pairs)", rows=True)
def _w12(p):
    return op.columns_near_switches(ts_ops(p), p, 10).select("pair_id", "col")


@query("a1_alignment_stats", f"with {_PAIRS} select pair_id, 'WithTarget' as type, 'FoundTarget' as status, 2.0::double as cost, 4.0::double / 240 as cost_per_base, 1.0::double as template_switch_amount, 0 as reference_offset, 0 as query_offset from pairs", rows=True)
def _a1(p):
    return stats.alignment_stats(ts_ops(p), op.alignment_cost(ts_ops(p), p, of_set(load_costs(p.sparkSession), "bench")), p)


def _no_ts(p):
    return p.select("pair_id", (2 * F.levenshtein("r_seq", "q_seq")).cast("double").alias("cost"))


@query("a2_summarise", f"with {_PAIRS}, r as (select pair_id % 5 as g, cast(2 * levenshtein(r_seq, q_seq) as double) as cost from pairs) select g, min(cost) as cost_min, max(cost) as cost_max, sum(cost) as cost_sum, avg(cost) as cost_mean from r group by g")
def _a2(p):
    return stats.summarise(_no_ts(p).withColumn("g", F.col("pair_id") % 5), ("g",))


@query("a3_percentile", f"with {_PAIRS}, r as (select pair_id % 5 as g, cast(2 * levenshtein(r_seq, q_seq) as double) as cost from pairs), n as (select *, row_number() over (partition by g order by cost) - 1 as i, count(*) over (partition by g) as n from r) select g, cost from n where i = least(cast(floor(0.9 * n) as bigint), n - 1)")
def _a3(p):
    return stats.summarise_percentile(_no_ts(p).withColumn("g", F.col("pair_id") % 5), 0.9, ("g",))


@query("a10_ts_length", f"with {_PAIRS} select pair_id, cast(20 as bigint) as ts_length from pairs", rows=True)
def _a10(p):
    return op.ts_total_length(ts_ops(p))


@query("a11_descendant_mode", f"with {_PAIRS} select pair_id, true as single_descendant from pairs", rows=True)
def _a11(p):
    return op.descendant_mode(op.switches(ts_ops(p)))


@query("j17_compare_no_ts", f"with {_PAIRS}, r as (select pair_id, cast(2 as double) as cost, cast(2 * levenshtein(r_seq, q_seq) as double) as no_ts_cost from pairs where pair_id % 7 <> 0), s as (select pair_id, cost, no_ts_cost from r union all select pair_id, null, cast(2 * levenshtein(r_seq, q_seq) as double) from pairs where pair_id % 7 = 0) select pair_id, cost, no_ts_cost, no_ts_cost - cost as saving, case when cost < no_ts_cost then 'ts' when cost > no_ts_cost then 'no_ts' when cost = no_ts_cost then 'equal' end as cheaper, pair_id % 7 = 0 as ts_missing, false as no_ts_missing, false as no_ts_without_target from s")
def _j17(p):
    return stats.compare_no_ts(p.where("pair_id % 7 != 0").select("pair_id", F.lit(2.0).alias("cost")), _no_ts(p))


@query("j18_reject_impure", f"with {_FLAT} select pair_id, op_idx, n, kind from ops where pair_id % 3 <> 0", rows=True)
def _j18(p):
    mixed = op.compact_ops(flat_ops(p)).unionByName(ts_ops(p.where("pair_id % 3 = 0")).withColumn("op_idx", F.col("op_idx") + 1000))
    return stats.reject_impure(mixed)[0].select("pair_id", "op_idx", "n", "kind")


@query("t3_best_per_pair", f"with {_FLAT} select pair_id, case when cost < 2 then cost else 2 end as cost, case when cost < 2 then 0 else 20 end as ts_length from {_X}", rows=True)
def _t3(p):
    costs = of_set(load_costs(p.sparkSession), "bench")
    plain = op.alignment_cost(op.compact_ops(flat_ops(p)), p, costs).withColumn("ts_length", F.lit(0).cast("bigint"))
    return stats.best_per_pair(plain.unionByName(op.alignment_cost(ts_ops(p), p, costs).join(op.ts_total_length(ts_ops(p)), "pair_id")))


@query("t4_cost_limit", f"with {_PAIRS}, r as (select pair_id, cast(2 * levenshtein(r_seq, q_seq) as double) as cost from pairs) select pair_id, case when cost > 20 then 'WithoutTarget' else 'WithTarget' end as type, case when cost > 20 then 'ExceededCostLimit' else 'FoundTarget' end as status, least(cost, 20) as cost from r")
def _t4(p):
    return stats.apply_cost_limit(_no_ts(p).withColumn("type", F.lit("WithTarget")).withColumn("status", F.lit("FoundTarget")).select("pair_id", "type", "status", "cost"), 20)


@query("j14_eval_step", f"with {_PAIRS}, {_literal('step_fn')} select pair_id, f.cost as length_cost from (select pair_id, pair_id % 150 as x from pairs) join step_fn f on f.cost_set = 'sample' and f.name = 'Length' and x >= f.lo and x < f.hi")
def _j14(p):
    rows = p.select("pair_id", (F.col("pair_id") % 150).alias("x"))
    return co.eval_step(rows, "x", of_set(load_costs(p.sparkSession), "sample")["step_fn"], "Length", "length_cost").drop("x")


@query("j15_eval_edit", f"with {_FLAT}, {_literal('subst')} select pair_id, op_idx, s.cost from flat join pairs using (pair_id) join subst s on s.cost_set = 'bench' and s.tbl = 'secondary' and s.c1 = substr(r_seq, op_idx + 1, 1) and s.c2 = substr(q_seq, op_idx + 1, 1)", rows=True)
def _j15(p):
    costs = of_set(load_costs(p.sparkSession), "bench")
    rows = op.unit_bases(flat_ops(p), p).select("pair_id", "op_idx", F.lit("M").alias("kind"), "c1", "c2", F.lit(True).alias("first"))
    return co.eval_edit(rows, costs["subst"], costs["gaps"], "secondary").select("pair_id", "op_idx", "cost")


@query("j16_ts_costs", f"with {_PAIRS} select pair_id, cast(2 as bigint) as base_c, cast(0 as bigint) as offset_c, cast(0 as bigint) as length_c, cast(0 as bigint) as difference_c, cast(0 as bigint) as gap_c, cast(2 as bigint) as ts_cost from pairs", rows=True)
def _j16(p):
    costs = of_set(load_costs(p.sparkSession), "bench")
    return co.ts_costs(op.switches(ts_ops(p)), costs["base_cost"], costs["step_fn"]).select("pair_id", "base_c", "offset_c", "length_c", "difference_c", "gap_c", "ts_cost")

QUERIES |= tiles.QUERIES
ORACLE_SQL |= tiles.ORACLE_SQL
