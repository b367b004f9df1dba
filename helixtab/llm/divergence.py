"""How far the sources of a language are from each other, and what marks each of them: triangular discrimination of
smoothed term shares, on run-length columns.

The vocabulary of a language is sorted by its counts in all sources, so that each source's column of counts falls into
runs. A column is run-length encoded; for two sources the run boundaries are intersected, and what a stretch of equal
counts contributes is multiplied by its length.

Nulls: a null text, lang or source is ''. Repeated rows are rows like others; other columns are ignored. A language
without kept terms has value 0 for all pairs of its sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtab.llm.shared import LOWER, SMALL_ROWS, written

SCALE = 1_000_000_000
#: Bytes that are no part of a term become blanks; A-Z becomes a-z.
_TERMS = bytes(LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Distinct terms of a task that are counted before they are passed on.
COUNTED = 500_000
#: Terms whose columns are encoded together.
CHUNK = 8_192


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (rows with the term), combined within tasks; and a row without a term for each
    (lang, source), whatever its texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, rows) in counts.items():
                found = [None, *count]
                whole = [pa.array([x] * len(found), pa.binary()) for x in (lang, source)]
                numbers = [pa.array([0, *(c[t] for t in count)], pa.int64()) for c in (count, rows)]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(found, pa.binary()), *numbers], ["lang", "source", "term", "count", "docs"])
            counts.clear()

        held = 0
        for b in batches:
            for lang, source, data in zip(*(c.to_pylist() for c in b.columns)):
                count, rows = counts.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(count), terms(data)
                count.update(own)
                rows.update(set(own))
                held += len(count) - before
                if held >= COUNTED:
                    yield from out()
                    held = 0
        yield from out()

    text = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang binary, source binary, term binary, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "count", "docs")


def _share(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """p of each count, exactly: products go beyond 64 bits, so distinct counts are taken as Python's integers."""
    distinct, of = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * size) for c in distinct], np.int64)[of]


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _language(lang: str, vectors: list, names: list[bytes], groups: dict[int, int], top: int) -> Iterator[tuple]:
    """Parts of one language's chunk of sorted terms: (lang, a, b, None, value) for groups a < b, and (lang, a, None,
    term, value) for what may be among the group's `top` terms."""
    n, size = len(names), groups[-2]
    at, gno, count = (np.array(x, np.int64) for x in zip(*[(i, g, c) for i, v in enumerate(vectors) for g, c in v]))
    whole = np.bincount(at, count, n) if count.sum() < 1 << 52 else np.array([sum(c for _, c in v) for v in vectors])
    lang_p = _share(whole.astype(np.int64), groups[-1], size)
    ends, shares = {}, {}
    order = np.lexsort((at, gno))
    at, gno, count = at[order], gno[order], count[order]
    mine = np.searchsorted(gno, sorted(g for g in groups if g >= 0))
    for g, lo, hi in zip(sorted(g for g in groups if g >= 0), mine, [*mine[1:], len(gno)]):
        column = np.zeros(n, np.int64)
        column[at[lo:hi]] = count[lo:hi]
        ends[g] = np.concatenate((np.flatnonzero(np.diff(column)) + 1, [n]))
        shares[g] = _share(column[ends[g] - 1], groups[g], size)
        present = at[lo:hi]
        p, q = _share(count[lo:hi], groups[g], size), lang_p[present]
        value = _f(p, q)
        above = np.flatnonzero(p > q)
        if len(above) > top:  # all that are as high as the last of the top ones
            above = above[value[above] >= np.partition(value[above], -top)[-top]]
        yield from ((lang, g, None, names[present[i]], int(value[i])) for i in above)
    known = sorted(ends)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            cuts = np.union1d(ends[a], ends[b])
            p, q = shares[a][np.searchsorted(ends[a], cuts)], shares[b][np.searchsorted(ends[b], cuts)]
            # a sum of at most 8,192 values that are 2 * 10^9 at most
            yield lang, a, b, None, int((_f(p, q) * np.diff(cuts, prepend=0)).sum())


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its divergence from each other source of it
    (part pair), and its `top` marking terms, which are more frequent in it than in the language (part term)."""
    counts = written(term_counts(docs), "divergence-counts")
    # numbers of groups: the smallest come first in the order of columns, so that long runs of zero stay together
    by = Window.partitionBy("lang").orderBy("n_terms", "source")
    sizes = counts.groupBy("lang", "source").agg(F.count("term").alias("n_terms"))
    groups = written(sizes.select("lang", "source", (F.row_number().over(by) - 1).alias("g")), "divergence-groups")
    small = F.broadcast(groups) if groups.count() <= SMALL_ROWS else groups
    numbered = counts.where("term is not null").join(small, ["lang", "source"])
    vector = F.array_sort(F.collect_list(F.struct("g", "count")))
    kept = written(numbered.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector.alias("vector")).where(F.col("docs") >= least_docs).select("lang", "term", "vector"), "divergence-terms")
    each = kept.select("lang", F.explode("vector").alias("x")).groupBy("lang", "x.g").agg(F.sum("x.count").alias("n"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    # one row a language: each group's total, under -1 the language's, under -2 the number of kept terms
    totals = groups.join(each, ["lang", "g"], "left").groupBy("lang").agg(F.collect_list(F.struct("g", F.coalesce("n", F.lit(0)).alias("n"))).alias("ns"), F.sum("n").alias("n"))
    totals = totals.join(size, "lang").select("lang", F.concat("ns", F.array(F.struct(F.lit(-1).alias("g"), F.col("n").alias("n")), F.struct(F.lit(-2).alias("g"), F.col("v").alias("n")))).alias("totals"))
    columns = ["lang", "vector", "term"]
    ordered = kept.repartitionByRange(*columns).sortWithinPartitions(*columns)
    totals = written(totals, "divergence-totals")
    if groups.count() > SMALL_ROWS:
        raise ValueError(f"over {SMALL_ROWS} sources: their pairs are the result, and its columns are held by each task")
    groups_of = {r["lang"]: {x["g"]: x["n"] for x in r["totals"]} for r in totals.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                b = whole.slice(start, CHUNK)
                langs, names, vectors = (b.column(c).to_pylist() for c in ("lang", "term", "vector"))
                cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
                found = [x for lo, hi in zip(cuts, cuts[1:]) if lo < hi for x in _language(langs[lo], [[(e["g"], e["count"]) for e in v] for v in vectors[lo:hi]], names[lo:hi], groups_of[langs[lo]], top)]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["lang", "a", "b", "term", "value"])

    parts = written(ordered.mapInArrow(run, "lang string, a int, b int, term string, value long"), "divergence-parts")
    one = parts.where("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = one.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    name = lambda c, n: groups.select("lang", F.col("source").alias(n), F.col("g").alias(c))
    # every pair of sources of a language, terms or none
    pairs = name("a", "source").join(name("b", "item"), "lang").where("a != b").join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    marks = parts.where("term is not null").select("lang", "a", F.col("term").alias("item"), "value").join(name("a", "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(marks).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
