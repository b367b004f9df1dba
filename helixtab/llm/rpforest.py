"""Near copies among vectors by a forest of random-projection trees with spill.

A tree splits its vectors by their projections on a random direction, again and again; those within the spill of a split
go to both sides. Vectors are compared within leaves, links are verified by the whole cosine in double precision, and
their groups are the connected components.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows
without a vec_id. Shorter vectors are filled up with zeros. Rows with one vec_id are one node of the groups; of equal
vectors each is a row of its own and links with the others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtab.llm.shared import join_small, written
from helixtab.llm.simhash import components

#: Trees; the rows of a leaf that isn't split any more; rows that are compared with one another at once.
TREES, LEAF, BLOCK = 4, 1_024, 2_048
#: Half the width of the band that goes to both sides, as a share of the largest distance of a link.
SPILL = 0.05
#: Vectors that the trees' upper levels are fitted on, and numbers they may hold.
SAMPLE, SAMPLE_NUMBERS = 32_768, 1 << 22
#: A side with more than this share of its node's rows is no progress, so crowds as narrow as links are long stay whole;
#: directions that are tried for a node.
PROGRESS, TRIES = 0.7, 4


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, key (a digest of the vector, 128 bits), vec (its numbers, in four bytes each if that is exact, else in eight),
    both null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.array(v if v is not None and None not in v else [], np.float64)
                top = np.abs(x).max(initial=0)
                if vec_id is None or not 0 < top < np.inf:  # NaN fails, too
                    out.append((vec_id, None, None))
                    continue
                x = np.trim_zeros(x, "b")
                short = x.astype(np.float32) if top < 1e30 else x
                data = b"f" + short.tobytes() if (short == x).all() and short.dtype == np.float32 else b"d" + x.tobytes()
                out.append((vec_id, hashlib.blake2b(data, digest_size=16).digest(), data))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], ["vec_id", "key", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, key binary, vec binary")


def _matrix(data: list[bytes], width: int = 0) -> np.ndarray:
    """Unit vectors as rows, in double precision, filled up with zeros to the longest or to width."""
    rows = [np.frombuffer(x, "f4" if x[:1] == b"f" else "f8", offset=1) for x in data]
    out = np.zeros((len(rows), width or max(map(len, rows), default=0)))
    for o, r in zip(out, rows):
        o[: len(r)] = r
    out /= np.maximum(np.abs(out).max(1, initial=0, keepdims=True), 1e-323)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-323)


def direction(tree: int, node: int, attempt: int, width: int) -> np.ndarray:
    """The unit direction of a node's split: the same wherever it is drawn."""
    x = np.random.default_rng([tree, node, attempt]).standard_normal(width)
    return x / np.linalg.norm(x)


def plant(sample: np.ndarray, rows: int, margin: float, trees: int, leaf: int, width: int) -> list[dict[int, tuple[int, float]]]:
    """For each tree its splits: node (root 1, children 2 n and 2 n + 1) to (attempt, median). A node is split while it
    stands for more than `leaf` of the rows, by at least 32 of the sample, and one of TRIES directions parts them."""
    out = []
    for t in range(trees):
        splits, todo = {}, [(1, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            if len(own) * rows <= leaf * len(sample) or len(own) < 32:
                continue
            for attempt in range(TRIES):
                at = sample[own] @ direction(t, node, attempt, width)
                mid = float(np.median(at))
                left, right = own[at <= mid + margin], own[at > mid - margin]
                if max(len(left), len(right)) <= PROGRESS * len(own):
                    splits[node] = (attempt, mid)
                    todo += [(2 * node, left), (2 * node + 1, right)]
                    break
        out.append(splits)
    return out


def _leaves(x: np.ndarray, forest: list[dict[int, tuple[int, float]]], margin: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(tree, leaf, rows of x) of all leaves that have rows."""
    for t, splits in enumerate(forest):
        todo = [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node not in splits:
                yield t, node, own
                continue
            attempt, mid = splits[node]
            at = x[own] @ direction(t, node, attempt, x.shape[1])
            todo += [(side, rows) for side, rows in ((2 * node, own[at <= mid + margin]), (2 * node + 1, own[at > mid - margin])) if len(rows)]


def _deeper(placed: DataFrame, classes: DataFrame, margin: float, leaf: int, width: int) -> DataFrame:
    """placed (key, tree, leaf) with the leaves that have too many rows split further, level by level: medians of the
    projections come from Spark, so no node's rows meet in one task. Nodes that no direction parts stay as they are."""
    done, attempt = placed.sparkSession.createDataFrame([], "key binary, tree int, leaf long"), 0
    while True:
        size = placed.groupBy("tree", "leaf").agg(F.count("*").alias("rows"))
        large = written(size.where(F.col("rows") > 2 * leaf), "forest-large")
        if large.isEmpty():
            return done.unionByName(placed)
        split = join_small(placed, large, ["tree", "leaf"]).join(classes.select("key", "vec"), "key")

        def project(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                x, nodes = _matrix(b.column("vec").to_pylist(), width), list(zip(b.column("tree").to_pylist(), b.column("leaf").to_pylist()))
                if len(known) > 4_096:
                    known.clear()
                for n in nodes:
                    if n not in known:
                        known[n] = direction(*n, TRIES + attempt, width)
                at = np.array([r @ known[n] for r, n in zip(x, nodes)])
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("tree"), b.column("leaf"), b.column("rows"), pa.array(at, pa.float64())], ["key", "tree", "leaf", "rows", "at"])

        at = written(split.select("key", "tree", "leaf", "rows", "vec").mapInArrow(project, "key binary, tree int, leaf long, rows long, at double"), "forest-at")
        mid = at.groupBy("tree", "leaf").agg(F.percentile_approx("at", 0.5, 1_000).alias("mid"))
        sides = join_small(at, written(mid, "forest-mid"), ["tree", "leaf"])
        left, right = F.col("at") <= F.col("mid") + margin, F.col("at") > F.col("mid") - margin
        sizes = sides.groupBy("tree", "leaf").agg((F.greatest(F.count_if(left), F.count_if(right)) <= PROGRESS * F.max("rows")).alias("parts"))
        sides = join_small(sides, written(sizes, "forest-sizes"), ["tree", "leaf"])
        child = F.explode(F.array_compact(F.array(F.when(left, 2 * F.col("leaf")), F.when(right, 2 * F.col("leaf") + 1))))
        below = sides.where("parts").select("key", "tree", child.alias("leaf"))
        small = join_small(placed, large.drop("rows"), ["tree", "leaf"], "left_anti").select("key", "tree", "leaf")
        stuck = sides.where("not parts").select("key", "tree", "leaf")
        done, placed = written(done.unionByName(small).unionByName(stuck), "forest-done"), written(below, "forest-below")
        attempt += 1


def _cores(placed: DataFrame, classes: DataFrame, threshold: float, leaf: int, width: int) -> DataFrame:
    """key, core: vectors of a crowded leaf of the first tree that are within half a link's angle of the leaf's mean.
    All of one core link with one another, for angles obey the triangle inequality; so they needn't be compared."""
    size = placed.where("tree = 0").groupBy("leaf").agg(F.count("*").alias("rows"))
    crowded = written(size.where(F.col("rows") > 2 * leaf), "forest-crowded")
    if crowded.isEmpty():
        return placed.sparkSession.createDataFrame([], "key binary, core long")
    own = written(join_small(placed.where("tree = 0").select("key", "leaf"), crowded.select("leaf"), ["leaf"]).groupBy("key").agg(F.min("leaf").alias("leaf")).join(classes.select("key", "vec"), "key"), "forest-crowds")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, leaves = _matrix(b.column("vec").to_pylist(), width), np.array(b.column("leaf").to_pylist())
            for n in np.unique(leaves):
                yield pa.RecordBatch.from_arrays([pa.array([int(n)] * width), pa.array(range(width), pa.int32()), pa.array(x[leaves == n].sum(0))], ["leaf", "i", "x"])

    mean = own.mapInArrow(sums, "leaf long, i int, x double").groupBy("leaf", "i").agg(F.sum("x").alias("x")).groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = _matrix(b.column("vec").to_pylist(), width), np.array(b.column("mean").to_pylist(), np.float64).reshape(b.num_rows, width)
            cos = np.einsum("ij,ij->i", x, m) / np.maximum(np.linalg.norm(m, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("leaf")], ["key", "core"]).filter(pa.array(cos >= half))

    return written(join_small(own, written(mean, "forest-mean"), ["leaf"]).select("key", "leaf", "vec", "mean").mapInArrow(near, "key binary, core long"), "forest-cores")


def _union(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each one reaches, from a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = linked[front].any(0) & (root < 0)
    return root


def near_groups(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links (other rows whose cosine is at least the threshold, among those that share a leaf), component_id
    (the smallest vec_id that links reach, its own included) of every row.

    A pair is counted in the first leaf that it shares. A crowded leaf, which no direction parts, is compared by blocks
    of BLOCK rows, each two of them in a task of their own, but for blocks of one core (see _cores), whose links are
    known."""
    spark = vectors.sparkSession
    units = written(unit_vectors(vectors), "forest-units")
    classes = units.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes, "forest-classes")
    numbers = (F.length("vec") - 1) / F.when(F.substr("vec", F.lit(1), F.lit(1)) == F.lit(b"f"), 4).otherwise(8)
    rows, width = classes.agg(F.count("*"), F.max(numbers.cast("int"))).first()
    width = width or 0
    margin = spill * float(np.sqrt(2 - 2 * threshold))
    drawn = [r["vec"] for r in classes.orderBy("key").limit(min(sample, SAMPLE_NUMBERS // max(width, 1))).select("vec").collect()]
    forest = spark.sparkContext.broadcast(plant(_matrix(drawn, width), rows, margin, trees, leaf, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = b.column(0)
                for t, node, own in _leaves(_matrix(b.column(1).to_pylist(), width), forest.value, margin):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(np.full(len(own), t, np.int32)), pa.array(np.full(len(own), node, np.int64))], ["key", "tree", "leaf"])

    placed = written(classes.select("key", "vec").mapInArrow(place, "key binary, tree int, leaf long"), "forest-placed")
    placed = written(_deeper(placed, classes, margin, leaf, width), "forest-leaves")
    cores = _cores(placed, classes, threshold, leaf, width)
    # a leaf's number tells its tree first; a vector's leaves go with it, to see which one two of them share first
    own = placed.select("key", (F.shiftleft(F.col("tree").cast("long"), 56) + F.col("leaf")).alias("leaf"))
    size = own.groupBy("leaf").agg(F.count("*").alias("rows")).where("rows > 1")
    members = join_small(own, written(size, "forest-sizes"), ["leaf"])
    lists = own.groupBy("key").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")).join(classes, "key").join(cores, "key", "left")
    members = members.join(lists, "key")
    # rows of one core that are many in a leaf lie in blocks of their own, which needn't be compared with one another
    whose = F.when(F.count("core").over(Window.partitionBy("leaf", "core")) > BLOCK, F.col("core")) if not cores.isEmpty() else F.lit(None).cast("long")
    crowded = written(members.where(F.col("rows") > BLOCK), "forest-members").withColumn("core_", whose)
    blocks = crowded.groupBy("leaf", "core_").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = blocks.select("leaf", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct("core_", b.alias("b")))).alias("o")).groupBy("leaf").agg(F.collect_list("o").alias("os"))
    crowded = crowded.join(blocks.select("leaf", F.col("core_").alias("_c"), "blocks"), ["leaf"]).where(F.col("core_").eqNullSafe(F.col("_c"))).join(each, "leaf")
    crowded = crowded.withColumn("block", F.struct("core_", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("b"))).withColumn("o", F.explode("os")).where(F.col("core_").isNull() | ~F.col("core_").eqNullSafe(F.col("o.core_")))
    columns = ["leaf", "i", "j", "first", "key", "node", "n", "vec", "leaves", "core"]
    name = lambda b: F.concat_ws("/", F.coalesce(F.col(f"{b}.core_").cast("string"), F.lit("-")), F.col(f"{b}.b").cast("string"))
    crowded = crowded.withColumn("i", F.least(name("block"), name("o"))).withColumn("j", F.greatest(name("block"), name("o"))).withColumn("first", name("block") == F.col("i")).select(columns)
    paired = members.where(F.col("rows") <= BLOCK).withColumn("i", F.lit("")).withColumn("j", F.lit("")).withColumn("first", F.lit(True)).select(columns).unionByName(crowded)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        got = {c: table.column(c).to_pylist() for c in columns[3:]}
        x, n, first, here = _matrix(got["vec"], width), np.array(got["n"], np.int64), np.array(got["first"]), key[0].as_py()
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if not first.all():
            linked &= first[:, None] != first[None, :]
        node = np.array(got["node"], np.int64)
        links, low = np.zeros(len(x), np.int64), node.copy()
        some = np.flatnonzero(linked.any(1))
        if len(some):
            linked = linked[np.ix_(some, some)]
            lists = [[v for v in got["leaves"][i] if v < here] for i in some]
            number = {v: c for c, v in enumerate(sorted({v for vs in lists for v in vs}))}
            shared = np.zeros((len(some), len(number)), np.float32)
            for row, vs in zip(shared, lists):
                row[[number[v] for v in vs]] = 1
            core = np.array([-1 if got["core"][i] is None else got["core"][i] for i in some])
            known = (shared @ shared.T > 0) | ((core[:, None] == core[None, :]) & (core[:, None] >= 0))
            links[some] = (linked & ~known) @ n[some]
            root, least = _union(linked), np.full(len(some), np.iinfo(np.int64).max)
            np.minimum.at(least, root, node[some])
            low[some] = least[root]
        return pa.table({"key": pa.array(got["key"], pa.binary()), "node": pa.array(node), "links": pa.array(links), "root": pa.array(low)})

    # a group's parts are small blocks of one leaf
    found = written(paired.groupBy("leaf", "i", "j").applyInArrow(compare, "key binary, node long, links long, root long"), "forest-found")
    core_size = cores.join(classes, "key").groupBy("core").agg(F.sum("n").alias("rows"), F.min("node").alias("low"))
    in_core = join_small(cores, written(core_size, "forest-core-sizes"), ["core"])
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(in_core.join(classes.select("key", "node"), "key").select(F.col("node").alias("a"), F.col("low").alias("b")).where("a != b"))
    # rows with one id are one node, whatever their vectors
    several = units.where("key is not null").groupBy("vec_id").agg((F.min("key") != F.max("key")).alias("several")).where("several").select("vec_id")
    twins = units.join(several, "vec_id").join(classes.select("key", "node"), "key").where("vec_id != node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    roots = components(edges.union(twins).distinct())
    per_class = classes.select("key", "node", "n").join(counts, "key", "left").join(in_core.select("key", "rows"), "key", "left").join(roots, "node", "left")
    per_class = per_class.select("key", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("rows") - F.col("n"), F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    out = units.select("vec_id", "key").join(per_class, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
