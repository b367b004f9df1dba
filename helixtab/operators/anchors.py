"""Seeds of pairs: k-mer tables and their equi-joins on pair_id and k-mer, and the same pair by pair in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtab.functions.seq import ALPHABETS, default_range, revcomp

KINDS = ("P", "S11", "S12", "S21", "S22")


def _pieces(texts: list[str], los: np.ndarray, ns: np.ndarray, k: int) -> pa.Array:
    """The k-mers of the texts that start at los and the ns - 1 places after it, text by text."""
    if not all(map(str.isascii, texts)):
        return pa.array([t[lo + i : lo + i + k] for t, lo, n in zip(texts, los.tolist(), ns.tolist()) for i in range(n)], pa.string())
    begins = np.cumsum([0, *map(len, texts)])[:-1] + los
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.repeat(begins, ns) + np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
    cells = data[at[:, None] + np.arange(k)] if len(at) else data[:0]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cells)))


def kmers(pairs: DataFrame, k: int) -> DataFrame:
    """k-mers of both sequences: forward ones of the focus range, reverse-complement ones of the whole sequence. A pair's are
    made from its row in one pass."""
    if not 1 <= k <= 64:
        raise ValueError("k must be from 1 to 64")
    p = default_range(pairs)
    fields = [x for s in "rq" for x in (F.col(f"{s}_seq"), revcomp(F.col(f"{s}_seq")).alias(f"{s}_back"), F.col(f"{s}_start").cast("int"), F.col(f"{s}_limit").cast("int"))]
    rows = p.select("pair_id", *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a part's rows are about 500 to a pair
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for s in "rq":
                for strand, column in (("F", f"{s}_seq"), ("C", f"{s}_back")):
                    texts, lo, hi = (batch.column(c).to_pylist() for c in (column, f"{s}_start", f"{s}_limit"))
                    own = np.array([i for i, t in enumerate(texts) if t is not None and (strand == "C" or (lo[i] is not None and hi[i] is not None))], np.int64)
                    kept = [texts[i] for i in own]
                    sizes = np.array([len(t) for t in kept], np.int64)
                    first = np.zeros(len(own), np.int64) if strand == "C" else np.array([lo[i] for i in own], np.int64)
                    last = sizes if strand == "C" else np.array([hi[i] for i in own], np.int64)
                    n = np.maximum(last - k - first + 1, 0)
                    if not n.sum():
                        continue
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    # a reverse-complement k-mer's place is its right end on the forward strand
                    pos = np.repeat(sizes, n) - step if strand == "C" else np.repeat(first, n) + step
                    name = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(step), np.int32)), pa.array([x])).cast(pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(own, n))), name(s.upper()), name(strand), pa.array(pos.astype(np.int32)), _pieces(kept, first, n, k)], ["pair_id", "side", "strand", "pos", "kmer"])

    return rows.mapInArrow(run, f"pair_id {rows.schema['pair_id'].dataType.simpleString()}, side string, strand string, pos int, kmer string")


def primary_anchors(km: DataFrame) -> DataFrame:
    """kind P; x, y: starts of equal k-mers in reference and query."""
    own = lambda s, c: km.where((F.col("side") == s) & (F.col("strand") == "F")).select("pair_id", "kmer", F.col("pos").alias(c))
    return own("R", "x").join(own("Q", "y"), ["pair_id", "kmer"]).select("pair_id", F.lit("P").alias("kind"), "x", "y")


def secondary_anchors(km: DataFrame) -> DataFrame:
    """kinds S<ancestor><descendant>; x: right end on the ancestor, y: start on the descendant, for a k-mer that
    equals the reverse complement before x."""
    number = lambda c: F.when(F.col(c) == "R", "1").otherwise("2")
    anc = km.where("strand = 'C'").select("pair_id", "kmer", F.col("side").alias("a"), F.col("pos").alias("x"))
    des = km.where("strand = 'F'").select("pair_id", "kmer", F.col("side").alias("d"), F.col("pos").alias("y"))
    return anc.join(des, ["pair_id", "kmer"]).select("pair_id", F.concat(F.lit("S"), number("a"), number("d")).alias("kind"), "x", "y")


def _alphabet_codes(*texts: str) -> tuple[list[np.ndarray], int]:
    """The texts as numbers from 0, and how many there are."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    letters, codes = np.unique(np.concatenate(points), return_inverse=True)
    return np.split(codes.astype(np.int64), np.cumsum([len(p) for p in points])[:-1]), len(letters)


def kmer_names(k: int, *texts: str) -> list[np.ndarray]:
    """Each text's k-mers in order as numbers; equal ones, also of different texts, have equal numbers. Packed into 63 bits
    where they fit, else named anew with each doubling of their length."""
    codes, letters = _alphabet_codes(*texts)
    bits = max((letters - 1).bit_length(), 1)
    if bits * k < 64:
        out = []
        for c in codes:
            n = len(c) - k + 1
            name = np.zeros(max(n, 0), np.int64)
            for i in range(k if n > 0 else 0):
                name = (name << bits) | c[i : i + n]
            out.append(name)
        return out
    cuts, size, whole = np.cumsum([len(c) for c in codes]), 1, np.concatenate(codes)
    done, parts = 0, None  # names of the first `done` characters
    while True:
        if k & size:
            shifted = whole[done:] if done else whole
            parts = shifted if parts is None else np.unique(parts[: len(shifted)] * len(shifted) + shifted[: len(parts)], return_inverse=True)[1]
            done += size
        size *= 2
        if size > k:
            break
        whole = np.unique(whole[: -(size // 2)] * len(whole) + whole[size // 2 :], return_inverse=True)[1] if len(whole) > size // 2 else whole[:0]
    # those that cross from one text to the next are left out
    return [parts[lo : max(hi - k + 1, lo)] for lo, hi in zip([0, *cuts[:-1]], cuts)]


def equal_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] = b[j]: a merge with b in order."""
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    lo, hi = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]]


_COMPLEMENT = str.maketrans(*ALPHABETS["dna-n"])


def anchors_of(r: str, q: str, k: int, ranges: tuple[int, int, int, int], kinds: tuple[str, ...] = KINDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """kind to (x, y) of a pair's anchors. ranges: r_start, r_limit, q_start, q_limit, which hold for primary and
    descendant k-mers."""
    back = [t.translate(_COMPLEMENT)[::-1] for t in (r, q)] if set(kinds) != {"P"} else []
    names = kmer_names(k, r, q, *back)
    forward, start = {}, {}
    for side, name, lo, hi in (("1", names[0], *ranges[:2]), ("2", names[1], *ranges[2:])):
        start[side] = max(lo, 0)
        forward[side] = name[start[side] : max(hi - k + 1, start[side])]
    out = {}
    for kind in kinds:
        if kind == "P":
            x, y = equal_places(forward["1"], forward["2"])
            out[kind] = x + start["1"], y + start["2"]
        else:
            anc = names[2 if kind[1] == "1" else 3]
            i, y = equal_places(anc, forward[kind[2]])
            out[kind] = len(r if kind[1] == "1" else q) - i, y + start[kind[2]]
    return out


#: Anchors that inverted_repeats holds at once of several pairs.
HELD = 1 << 20


def inverted_repeats(r: list[str], q: list[str], k: int, ranges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, kind, x, y) of the secondary anchors of many pairs, some pairs after the others; kind is the place in S11, S12, S21,
    S22, and ranges has a pair's r_start, r_limit, q_start, q_limit in a row (see anchors_of). Pairs are looked at together:
    sequences are one text each side, and a pair's k-mers are those that don't leave its part of it."""
    whole = ["".join(t) for t in (r, q)]
    names = kmer_names(k, *whole, *[t.translate(_COMPLEMENT)[::-1] for t in whole])
    sizes = [np.array([len(x) for x in t], np.int64) for t in (r, q)]

    def places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(hi - lo, 0)
        pair = np.repeat(np.arange(len(n)), n)
        return pair, np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + lo[pair]

    descendants, ancestors = [], []
    for side, size in enumerate(sizes):
        start = np.cumsum(size) - size
        pair, y = places(np.maximum(ranges[:, 2 * side], 0), np.minimum(ranges[:, 2 * side + 1], size) - k + 1)
        descendants.append((pair, np.full(len(pair), side), y, names[side][start[pair] + y]))
        pair, x = places(np.full(len(size), k), size + 1)
        ancestors.append((pair, np.full(len(pair), side), x, names[2 + side][len(whole[side]) - start[pair] - x]))
    (d_pair, d_side, y, d_name), (a_pair, a_side, x, a_name) = (tuple(map(np.concatenate, zip(*v))) for v in (descendants, ancestors))
    width = max(int(d_name.max(initial=0)), int(a_name.max(initial=0))) + 1
    if width * len(r) >= 1 << 62:
        both = np.unique(np.concatenate([d_name, a_name]), return_inverse=True)[1]
        d_name, a_name, width = both[: len(d_name)], both[len(d_name) :], len(both) + 1
    d_key, a_key = d_pair * width + d_name, a_pair * width + a_name
    order, a_order = np.argsort(d_key, kind="stable"), np.argsort(a_key, kind="stable")
    ordered, a_key = d_key[order], a_key[a_order]
    lo, n = (first := np.searchsorted(ordered, a_key, "left")), np.searchsorted(ordered, a_key, "right") - first
    met = np.flatnonzero(n)
    lo, n, a_order = lo[met], n[met], a_order[met]
    # by pair, as the keys are; a pair stays whole
    last = np.flatnonzero(np.diff(a_pair[a_order], append=-1))
    upto = np.cumsum(n)[last] if len(last) else last
    cuts = last[np.flatnonzero(np.diff(upto // HELD, append=-1))] + 1
    for one, end in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
        m = n[one:end]
        i = np.repeat(a_order[one:end], m)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[one:end], m)]
        yield a_pair[i], 2 * a_side[i] + d_side[j], x[i], y[j]


def pair_anchors(pairs: DataFrame, k: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """pair_id, kind, x, y of all anchors, pair by pair and without a shuffle: both sides' k-mers are numbered in one row,
    and equal ones are found by a merge. The same as joins of kmers(). Pairs with a null sequence have none."""
    if not 1 <= k <= 64:
        raise ValueError("k must be from 1 to 64")
    p = default_range(pairs).where("r_seq is not null and q_seq is not null")
    rows = p.select("pair_id", "r_seq", "q_seq", *[F.col(c).cast("int").alias(c) for c in ("r_start", "r_limit", "q_start", "q_limit")])
    id_type = rows.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kind, xs, ys, held = [], [], [], [], 0
            for i, (r, q, *ranges) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 7)))):
                for n, (x, y) in enumerate(anchors_of(r, q, k, tuple(ranges), kinds).values()):
                    at.append(np.full(len(x), i))
                    kind.append(np.full(len(x), n))
                    xs.append(x)
                    ys.append(y)
                    held += len(x)
                if held > 1 << 18 or i == b.num_rows - 1:
                    names = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(kind), pa.int32()), pa.array(list(kinds))).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), names, pa.array(np.concatenate(xs), pa.int32()), pa.array(np.concatenate(ys), pa.int32())], ["pair_id", "kind", "x", "y"])
                    at, kind, xs, ys, held = [], [], [], [], 0

    return rows.mapInArrow(run, f"pair_id {id_type}, kind string, x int, y int")


def all_anchors(pairs: DataFrame, k: int) -> DataFrame:
    return pair_anchors(pairs, k)


def ts_seeds(pairs: DataFrame, min_length: int) -> DataFrame:
    """p, s (descendant and ancestor sequence), x, y: where min_length characters are a reverse complement."""
    whole = pairs.select("pair_id", "r_seq", "q_seq")
    name = lambda i: F.when(F.substr("kind", F.lit(i), F.lit(1)) == "1", "R").otherwise("Q")
    return pair_anchors(whole, min_length, KINDS[1:]).select("pair_id", name(3).alias("p"), name(2).alias("s"), "x", "y")


def filter_entrances(cands: DataFrame, seeds: DataFrame, mode: str, min_non_match: int = 0) -> DataFrame:
    """Template-switch entrances (p, s, x, y, cost) with a seed; or all, with a surcharge on those without."""
    on = ["pair_id", "p", "s", "x", "y"]
    if mode == "filter":
        return cands.join(seeds, on, "left_semi")
    if mode != "price":
        raise ValueError("mode must be filter or price")
    found = cands.join(seeds.select(*on, F.lit(True).alias("_seed")).distinct(), on, "left")
    return found.withColumn("cost", F.when(F.col("_seed").isNull(), F.col("cost") + min_non_match).otherwise(F.col("cost"))).drop("_seed")


def block_seeds(pairs: DataFrame, b: int) -> tuple[DataFrame, DataFrame]:
    """r_lo, r_hi, q_lo, q_hi: every place in the query where a block of the reference occurs. The reference is cut
    into blocks of b, the rest goes to the last one. Rejected: pairs with a sequence shorter than b."""
    n = F.length("r_seq")
    fits = F.coalesce((n >= b) & (F.length("q_seq") >= b), F.lit(False))
    good = pairs.where(fits)
    cut = good.select("pair_id", "r_seq", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / b).cast("int") - 1)).alias("i"))
    blocks = cut.select("pair_id", (F.col("i") * b).alias("r_lo"), F.when(F.col("i") == F.floor(F.col("n") / b) - 1, F.col("n")).otherwise((F.col("i") + 1) * b).cast("int").alias("r_hi"), "r_seq")
    blocks = blocks.withColumn("kmer", F.substr("r_seq", F.col("r_lo") + 1, F.col("r_hi") - F.col("r_lo"))).drop("r_seq")
    lengths = good.select("pair_id", "q_seq", F.length("q_seq").alias("m"), F.explode(F.array_distinct(F.array(F.lit(b), (b + n % b).cast("int")))).alias("w")).where("m >= w")
    places = lengths.select("pair_id", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("w"))).alias("q_lo"), "w", "q_seq").select("pair_id", "q_lo", (F.col("q_lo") + F.col("w")).alias("q_hi"), F.substr("q_seq", F.col("q_lo") + 1, F.col("w")).alias("kmer"))
    return blocks.join(places, ["pair_id", "kmer"]).select("pair_id", "r_lo", "r_hi", "q_lo", "q_hi"), pairs.where(~fits)


def lookup_anchors(coords: DataFrame, anchors: DataFrame) -> DataFrame:
    return anchors.join(coords.select("pair_id", "kind", "x", "y").distinct(), ["pair_id", "kind", "x", "y"])


def match_runs(anchors: DataFrame, k: int) -> DataFrame:
    """Anchors that are diagonal neighbours, as one run: x, y of the first and the run's length in characters."""
    line = F.when(F.col("kind") == "P", F.col("y") - F.col("x")).otherwise(F.col("x") + F.col("y"))
    by = Window.partitionBy("pair_id", "kind", "line").orderBy("y")
    rows = anchors.withColumn("line", line).withColumn("island", F.col("y") - F.row_number().over(by))
    runs = rows.groupBy("pair_id", "kind", "line", "island").agg(F.min_by("x", "y").alias("x"), F.min("y").alias("y"), (F.count("*") + k - 1).alias("length"))
    return runs.select("pair_id", "kind", "x", "y", "length")


def order_anchors(anchors: DataFrame) -> DataFrame:
    """idx (from 0) of each anchor of its pair and kind, by (min(x, y), x, y)."""
    by = Window.partitionBy("pair_id", "kind").orderBy(F.least("x", "y"), "x", "y")
    return anchors.withColumn("idx", F.row_number().over(by) - 1)


def anchor_counts(anchors: DataFrame) -> DataFrame:
    """A column for each kind."""
    return anchors.groupBy("pair_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS])
