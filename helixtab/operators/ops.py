"""Alignments as rows: pair_id, op_idx, n, kind, first_offset, p, s, dir, gap. Window functions follow the operations
along each pair; a pair's alignment is as long as its sequences, so partitions by pair_id are small. Where characters are needed,
alignments are followed beside their sequences (see follow)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixtab.functions.seq import ALPHABETS
from helixtab.operators.follow import ENTRANCE, EXIT, OP, UNKNOWN, Prices, Units, follow, texts_of
from helixtab.operators.tables import INFINITE

KINDS = [f"{part}{what}" for part in ("Primary", "Secondary") for what in ("Match", "Substitution", "Insertion", "Deletion")] + [ENTRANCE, EXIT]


def _along():
    return Window.partitionBy("pair_id").orderBy("op_idx")


def explode_ops(results: DataFrame) -> DataFrame:
    """One row for each element of alignment (array of structs)."""
    return results.select("pair_id", F.posexplode("alignment").alias("op_idx", "_o")).select("pair_id", "op_idx", *[f"_o.{c}" for c in OP[1:]])


def nest_ops(ops: DataFrame) -> DataFrame:
    """pair_id, alignment: the rows in order as an array of structs."""
    nested = ops.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(*OP))).alias("_a"))
    return nested.select("pair_id", F.transform("_a", lambda o: F.struct(*[o[c].alias(c) for c in OP[1:]])).alias("alignment"))


def _swapped(c: str) -> Column:
    return F.when(F.col(c) == "R", "Q").when(F.col(c) == "Q", "R")


def invert_ops(ops: DataFrame) -> DataFrame:
    """The alignment with the sequences' roles swapped."""
    kind = F.when(F.col("kind").endswith("Insertion"), F.regexp_replace("kind", "Insertion$", "Deletion")).otherwise(F.regexp_replace("kind", "Deletion$", "Insertion"))
    return ops.withColumns({"kind": kind, "p": _swapped("p"), "s": _swapped("s"), "dir": F.when(F.col("dir") == "R", "F").when(F.col("dir") == "F", "R")})


def reverse_ops(ops: DataFrame) -> DataFrame:
    return ops.withColumn("op_idx", F.max("op_idx").over(Window.partitionBy("pair_id")) - F.col("op_idx"))


def op_info(ops: DataFrame) -> DataFrame:
    """repeatable, is_entrance, is_exit, stream_length and, for primary kinds, the steps dr and dq."""
    k = F.col("kind")
    ts = k.isin(ENTRANCE, EXIT)
    primary = k.startswith("Primary")
    both = k.endswith("Match") | k.endswith("Substitution")
    return ops.withColumns({"repeatable": ~ts, "is_entrance": k == ENTRANCE, "is_exit": k == EXIT, "stream_length": F.when(ts, 0).otherwise(1), "dr": F.when(primary & (both | k.endswith("Deletion")), 1).otherwise(0), "dq": F.when(primary & (both | k.endswith("Insertion")), 1).otherwise(0)})


def parse_ops(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations of a known kind and a count of at least one, the others)."""
    fine = F.coalesce(F.col("kind").isin(*KINDS) & (F.col("n") >= 1), F.lit(False))
    return ops.where(fine), ops.where(~fine)


def flatten_ops(ops: DataFrame) -> DataFrame:
    """One row for each unit, with op_idx counted anew; entrances and exits are one whatever their count."""
    units = ops.withColumn("_u", F.explode(F.sequence(F.lit(1), F.when(F.col("kind").isin(ENTRANCE, EXIT), 1).otherwise(F.col("n")))))
    return units.withColumn("op_idx", F.row_number().over(Window.partitionBy("pair_id").orderBy("op_idx", "_u")) - 1).withColumn("n", F.lit(1)).drop("_u")


def compact_ops(flat: DataFrame) -> DataFrame:
    """Neighbouring equal operations as one, op_idx counted anew."""
    same = [F.col(c).eqNullSafe(F.lag(c).over(_along())) for c in OP[2:]]
    starts = flat.withColumn("_new", F.when(same[0] & same[1] & same[2] & same[3] & same[4] & same[5] & F.lag("op_idx").over(_along()).isNotNull(), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(_along()))
    out = starts.groupBy("pair_id", "_island").agg(F.sum("n").cast("int").alias("n"), *[F.first(c).alias(c) for c in OP[2:]])
    return out.select("pair_id", (F.col("_island") - 1).cast("int").alias("op_idx"), *OP[1:])


def _in_ts(ops: DataFrame) -> DataFrame:
    """With the running number of the template switch (0 before the first), and its entrance's p, s, dir and
    first_offset on the operations inside it, its exit included."""
    entered = F.count_if(F.col("kind") == ENTRANCE).over(_along().rowsBetween(Window.unboundedPreceding, 0))
    left = F.count_if(F.col("kind") == EXIT).over(_along().rowsBetween(Window.unboundedPreceding, -1))
    out = ops.withColumn("ts_idx", entered).withColumn("_in", F.col("ts_idx") > F.coalesce(left, F.lit(0)))
    for c in ("p", "s", "dir", "first_offset"):
        out = out.withColumn(f"ts_{c}", F.when(F.col("_in"), F.last(c, ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, 0))))
    return out.drop("_in")


def track_coords(ops: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """r_before, q_before, r_after, q_after of each operation. Inside a template switch the primary sequence moves;
    its exit moves the other one by the gap. starts: pair_id, r_start, q_start (else 0)."""
    k, n = F.col("kind"), F.col("n")
    inner = k.startswith("Secondary") & ~k.endswith("Deletion")
    step = lambda seq, gap_kind: F.when(k.startswith("Primary") & ~k.endswith(gap_kind), n).when(inner & (F.col("ts_p") == seq), n).when((k == EXIT) & (F.col("ts_p") != seq), F.col("gap")).otherwise(0)
    rows = _in_ts(ops).withColumn("_r", step("R", "Insertion")).withColumn("_q", step("Q", "Deletion"))
    if starts is not None:
        rows = rows.join(starts.select("pair_id", "r_start", "q_start"), "pair_id")
    else:
        rows = rows.withColumn("r_start", F.lit(0)).withColumn("q_start", F.lit(0))
    upto = _along().rowsBetween(Window.unboundedPreceding, 0)
    for s in "rq":
        after = F.sum(f"_{s}").over(upto) + F.col(f"{s}_start")
        rows = rows.withColumn(f"{s}_after", after).withColumn(f"{s}_before", F.col(f"{s}_after") - F.col(f"_{s}"))
    return rows.drop("_r", "_q", "r_start", "q_start")


def starts_of(pairs: DataFrame) -> DataFrame | None:
    """Where the pairs' focus ranges start, if they have any."""
    if not {"r_start", "q_start"} <= set(pairs.columns):
        return None
    return pairs.select("pair_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("r_start", "q_start")])


def track_secondary(flat: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Flat operations with s_before and s_after inside template switches: from the secondary sequence's position plus
    first_offset, one to the right (forward) or left (reverse) with each match, substitution and deletion."""
    rows = track_coords(flat, starts)
    start = F.when(F.col("kind") == ENTRANCE, F.when(F.col("s") == "R", F.col("r_before")).otherwise(F.col("q_before")) + F.col("first_offset"))
    at = F.last(start, ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, 0))
    moves = F.when(F.col("kind").startswith("Secondary") & ~F.col("kind").endswith("Insertion"), F.when(F.col("ts_dir") == "R", -1).otherwise(1)).otherwise(0)
    inside = F.col("ts_p").isNotNull()
    run = Window.partitionBy("pair_id", "ts_idx").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_m", F.when(inside, moves).otherwise(0)).withColumn("_start", at)
    rows = rows.withColumn("s_after", F.when(inside, F.col("_start") + F.sum("_m").over(run))).withColumn("s_before", F.col("s_after") - F.col("_m"))
    return rows.drop("_m", "_start")


def switches(ops: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """One row for each template switch: its four switch points, length (primary characters inside), gap, difference
    and the CIGAR of its inside."""
    rows = track_coords(ops, starts).where("ts_p is not null")
    k, inner = F.col("kind"), F.col("kind").startswith("Secondary")
    enter = lambda c: F.max(F.when(k == ENTRANCE, F.col(c)))
    leave = lambda c: F.max(F.when(k == EXIT, F.col(c)))
    moved = F.coalesce(F.sum(F.when(inner & ~k.endswith("Insertion"), F.col("n"))), F.lit(0))
    inside = F.array_sort(F.collect_list(F.when(inner, F.struct("op_idx", F.concat(F.col("n").cast("string"), letter(k)).alias("c")))))
    out = rows.groupBy("pair_id", "ts_idx").agg(
        *[enter(f"ts_{c}").alias(c) for c in ("p", "s", "dir")], enter("first_offset").alias("first_offset"), enter("r_before").alias("sp1_r"), enter("q_before").alias("sp1_q"), leave("r_after").alias("sp4_r"), leave("q_after").alias("sp4_q"),
        F.coalesce(F.sum(F.when(inner & ~k.endswith("Deletion"), F.col("n"))), F.lit(0)).alias("length"), leave("gap").alias("gap"), moved.alias("_moved"), F.array_join(F.transform(inside, lambda x: x["c"]), "").alias("inner_cigar"),
    )
    sp2 = F.when(F.col("s") == "R", F.col("sp1_r")).otherwise(F.col("sp1_q")) + F.col("first_offset")
    out = out.withColumn("sp2", sp2).withColumn("sp3", F.col("sp2") + F.when(F.col("dir") == "R", -F.col("_moved")).otherwise(F.col("_moved"))).withColumn("difference", F.col("gap") - F.col("length"))
    return out.select("pair_id", "ts_idx", "p", "s", "dir", "first_offset", "sp1_r", "sp1_q", "sp2", "sp3", "sp4_r", "sp4_q", "length", "gap", "difference", "inner_cigar")


def letter(kind: Column) -> Column:
    return F.when(kind.endswith("Match"), "=").when(kind.endswith("Substitution"), "X").when(kind.endswith("Insertion"), "I").when(kind.endswith("Deletion"), "D")


def cigar(ops: DataFrame) -> DataFrame:
    """pair_id, cigar. A switch whose equal-cost range (ecr) isn't known prints [-]:[-]."""
    k, unknown = F.col("kind"), F.lit("[-]:[-]")
    part = lambda a, b: F.concat(F.lit("["), F.col(f"ecr.{a}").cast("string"), F.lit(","), F.col(f"ecr.{b}").cast("string"), F.lit("]"))
    known = F.coalesce(F.concat(part("min_start", "max_start"), F.lit(":"), part("min_end", "max_end")), unknown) if "ecr" in ops.columns else unknown
    text = F.when(k == ENTRANCE, F.concat(F.lit("[TS"), F.col("p"), F.col("s"), F.col("dir"), F.lit(":"), known, F.lit(":"), F.col("first_offset").cast("string"), F.lit(":"))).when(k == EXIT, F.concat(F.lit(":"), F.col("gap").cast("string"), F.lit("]"))).otherwise(F.concat(F.col("n").cast("string"), letter(k)))
    lists = ops.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("op_idx", text.alias("c")))).alias("x"))
    return lists.select("pair_id", F.array_join(F.transform("x", lambda x: x["c"]), "").alias("cigar"))


def _char(seq: str, at: Column) -> Column:
    return F.substr(F.col(seq), at + 1, F.lit(1))


def unit_bases(flat: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flat operations with c1, c2: the reference and query character they compare; inside a switch the secondary
    (complemented if reverse) and the primary one."""
    rows = track_secondary(flat, starts_of(pairs)).join(pairs.select("pair_id", "r_seq", "q_seq"), "pair_id")
    outside = F.col("kind").startswith("Primary")
    second_at = F.when(F.col("ts_dir") == "R", F.col("s_before") - 1).otherwise(F.col("s_before"))
    second = F.when(F.col("ts_s") == "R", _char("r_seq", second_at)).otherwise(_char("q_seq", second_at))
    second = F.when(F.col("ts_dir") == "R", F.translate(second, *ALPHABETS["dna-n"])).otherwise(second)
    first = F.when(F.col("ts_p") == "R", _char("r_seq", F.col("r_before"))).otherwise(_char("q_seq", F.col("q_before")))
    ts = F.col("kind").isin(ENTRANCE, EXIT)
    return rows.withColumns({"c1": F.when(ts, None).when(outside, _char("r_seq", F.col("r_before"))).otherwise(second), "c2": F.when(ts, None).when(outside, _char("q_seq", F.col("q_before"))).otherwise(first)})


def verify_ops(flat: DataFrame, pairs: DataFrame) -> DataFrame:
    """The units that lie: matches of unequal, substitutions of equal characters."""

    def found(u: Units, ids: pa.Array) -> pa.RecordBatch:
        wrong = ((u.match & (u.c1 != u.c2)) | (u.subst & (u.c1 == u.c2))) & (u.c1 != UNKNOWN) & (u.c2 != UNKNOWN)
        own = np.flatnonzero(wrong)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(u.pair[own])), pa.array(u.op_idx[own], to_arrow_type(op_idx)), u.names(own), texts_of(u.c1[own]), texts_of(u.c2[own])], ["pair_id", "op_idx", "kind", "c1", "c2"])

    op_idx = flat.schema["op_idx"].dataType
    return follow(flat, pairs, f"op_idx {op_idx.simpleString()}, kind string, c1 string, c2 string", found, whole=False)


def alignment_cost(ops: DataFrame, pairs: DataFrame, costs: dict[str, DataFrame]) -> DataFrame:
    """pair_id, cost: operations, and the base, offset, gap, length and difference costs of switches. NULL: infinite.
    costs: tables of one cost set."""
    prices = Prices(costs)

    def found(u: Units, ids: pa.Array) -> pa.RecordBatch:
        own = np.flatnonzero(u.known & ~u.entrance & ~u.exit)
        pair, cost = (np.concatenate(v) for v in zip((u.pair[own], prices.units(u)[own]), prices.switches(u)))
        total, far = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        np.add.at(total, pair, np.where(cost < INFINITE, cost, 0))
        far[pair[cost >= INFINITE]] = True
        has = np.unique(pair)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(has)), pa.array(total[has], mask=far[has])], ["pair_id", "cost"])

    return follow(ops, pairs, "cost long", found)


def ts_context(ops: DataFrame, least: int = 20) -> DataFrame:
    """For each switch, the operations before it and after it up to `least` units (the last one whole); what comes after
    stops at the next switch. side: up or down."""
    rows = _in_ts(ops).withColumn("units", F.when(F.col("kind").isin(ENTRANCE, EXIT), 0).otherwise(F.col("n")))
    own = rows.groupBy("pair_id", "ts_idx").agg(F.min(F.when(F.col("kind") == ENTRANCE, F.col("op_idx"))).alias("a"), F.max(F.when(F.col("kind") == EXIT, F.col("op_idx"))).alias("b")).where("ts_idx > 0").withColumnRenamed("ts_idx", "of_ts")
    near = own.join(rows, "pair_id").withColumn("side", F.when(F.col("op_idx") < F.col("a"), "up").when((F.col("op_idx") > F.col("b")) & (F.col("ts_idx") == F.col("of_ts")), "down")).where("side is not null")
    before = Window.partitionBy("pair_id", "of_ts", "side").orderBy(F.abs(F.col("op_idx") - F.col("a"))).rowsBetween(Window.unboundedPreceding, -1)
    return near.withColumn("_sum", F.coalesce(F.sum("units").over(before), F.lit(0))).where(F.col("_sum") < least).select("pair_id", F.col("of_ts").alias("ts_idx"), "side", "op_idx", "n", "kind")


def ts_total_length(ops: DataFrame) -> DataFrame:
    inner = F.col("kind").startswith("Secondary") & ~F.col("kind").endswith("Deletion")
    return ops.groupBy("pair_id").agg(F.coalesce(F.sum(F.when(inner, F.col("n"))), F.lit(0)).alias("ts_length"))


def descendant_mode(found: DataFrame) -> DataFrame:
    """If all switches of a pair have the same primary."""
    return found.groupBy("pair_id").agg((F.count_distinct("p") <= 1).alias("single_descendant"))


def extend_range(pairs: DataFrame, subst: DataFrame, r_from: str, q_from: str, right: bool, limit: int = 1 << 30) -> DataFrame:
    """pair_id, steps: how many character pairs the alignment grows to the left (or right) of the positions r_from and
    q_from while its cost doesn't rise."""
    room = F.least(F.length("r_seq") - F.col(r_from), F.length("q_seq") - F.col(q_from)) if right else F.least(F.col(r_from), F.col(q_from))
    at = lambda c: F.col(c) + F.col("i") - 1 if right else F.col(c) - F.col("i")
    rows = pairs.withColumn("_room", F.least(room, F.lit(limit))).withColumn("i", F.explode(F.sequence(F.lit(0), "_room")))
    rows = rows.withColumn("c1", F.when(F.col("i") > 0, _char("r_seq", at(r_from)))).withColumn("c2", F.when(F.col("i") > 0, _char("q_seq", at(q_from))))
    rows = rows.join(F.broadcast(subst.where("tbl = 'primary'").select("c1", "c2", "cost")), ["c1", "c2"], "left")
    stop = F.min(F.when((F.col("i") > 0) & ((F.col("cost") > 0) | F.col("cost").isNull()), F.col("i")))
    return rows.groupBy("pair_id").agg(F.coalesce(stop - 1, F.max("i")).alias("steps"))


def _columns(u: Units, ids: pa.Array, own: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Those of the columns outside template switches that are chosen."""
    col = u.before(u.primary.astype(np.int64))
    gap = ord("-")
    bases = [texts_of(np.where(at, gap, c)[own]) for at, c in ((u.insertion, u.c1), (u.deletion, u.c2))]
    found = [ids.take(pa.array(u.pair[own])), pa.array(col[own], pa.int32()), *bases, pa.array(u.subst[own]), pa.array(u.r_before[own]), pa.array(u.q_before[own])]
    return pa.RecordBatch.from_arrays(found, names)


_COLUMNS = ["pair_id", "col", "r_base", "q_base", "mismatch", "r_before", "q_before"]
_TYPES = "col int, r_base string, q_base string, mismatch boolean, r_before long, q_before long"


def gapped_columns(ops: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, col, r_base, q_base ('-' for a gap), mismatch: the columns outside template switches."""
    return follow(ops, pairs, _TYPES, lambda u, ids: _columns(u, ids, np.flatnonzero(u.primary), _COLUMNS))


def columns_near_switches(ops: DataFrame, pairs: DataFrame, z: int = 0) -> DataFrame:
    """limit_context() of gapped_columns() and switches(), in one pass."""

    def found(u: Units, ids: pa.Array) -> pa.RecordBatch:
        near = u.primary.copy()
        for before, after in ((u.r_before, u.r_after), (u.q_before, u.q_after)):
            lo, hi = np.full(len(ids), INFINITE), np.full(len(ids), -INFINITE)
            entered, left = u.entrance & u.inside, u.exit & u.inside
            np.minimum.at(lo, u.pair[entered], before[entered])
            np.maximum.at(hi, u.pair[left], after[left])
            near &= (before >= lo[u.pair] - z) & (before < hi[u.pair] + z)
        return _columns(u, ids, np.flatnonzero(near), _COLUMNS)

    return follow(ops, pairs, _TYPES, found)


def limit_context(columns: DataFrame, found: DataFrame, z: int = 0) -> DataFrame:
    """Columns within z bases of the pair's first and last switch point; none of a pair without a switch if z is 0."""
    points = lambda s: [f"sp1_{s}", f"sp4_{s}"]
    span = found.groupBy("pair_id").agg(*[f(F.col(c)).alias(f"{n}_{s}") for s in "rq" for n, f, c in (("lo", F.min, points(s)[0]), ("hi", F.max, points(s)[1]))])
    got = columns.join(span, "pair_id")
    return got.where(f"r_before >= lo_r - {z} and r_before < hi_r + {z} and q_before >= lo_q - {z} and q_before < hi_q + {z}").select(columns.columns)
