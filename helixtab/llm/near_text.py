"""Near copies of whole texts: SimHash candidates by multi-index hashing, each verified by its texts' shingles.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least SIMILARITY (fewer words:
the whole sequence is the one shingle; texts without words equal each other). Candidates come from SimHash fingerprints
of 256 bits over distinct two-word shingles, which a few edits in a text change less than longer ones.

Multi-index hashing: eight segments of 32 bits; each fingerprint enumerates its segment and those with one 0 made 1, and
texts that meet at such a key in any segment are candidates (all that differ by up to one bit in a segment, and half of
those that differ by two). The complete distance must be at most DISTANCE; then the shingles decide. A key is wide enough that
unrelated texts seldom meet.

One block that is cut, put in or replaced changes more two-word shingles than scattered edits at the same similarity. So
there are further segments of 32 bits, each a SimHash of few five-word shingles, those with the segment's least hashes
(SAMPLES says how many). It is the same in both texts if none of them is new, whatever else is, with a probability of
about the similarity to the power of their number; a single new one flips several bits, so these segments need no ball.

Groups need no pairs: every text at a key is first compared with the key's smallest text. What that links is one
component from then on, and only keys where several components meet are looked at again: there all pairs of different
components are compared. Keys of up to CROWD texts become pairs, some for each text; with more, all are compared block by block in
tasks that hold the blocks' fingerprints and texts: they return no pairs but the links that join components, fewer than they have
texts. Their work grows with the square of such a crowd, their memory and what they return don't. A task's texts are alike only if the rarest fifth of the shingles of each
shares one with the other's, so most of a crowd's pairs aren't compared at all.

Nulls: a null text is empty. Rows without an id take no part. Rows that share an id are one document, linked if
any of its texts is. Empty tables give empty results; extra columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtab.llm.shared import join_small, text_bytes, words, written
from helixtab.llm.simhash import components

SIMILARITY = (4, 5)
WORDS, FINE_WORDS = 5, 2
DISTANCE = 56
LANES = 4
#: Shingles in each of the sampled segments.
SAMPLES = (3,) * 4 + (5,) * 8
#: Texts at a key up to which their pairs are rows.
CROWD = 8
#: Texts of a crowd, and their bytes, that a task compares with as many others at once.
BLOCK, BLOCK_BYTES = 4096, 1 << 24
_CHUNK = 1 << 15
_FPS = [f"f{i}" for i in range(LANES)]
_SAMPLED = [f"s{i}" for i in range(len(SAMPLES) // 2)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(found: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words."""
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    size = min(size, n)
    own = h[: n - size + 1]
    for j in range(1, size):
        own = own * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j]
    return np.unique(_mix(own))


def wide_fingerprint(found: list[bytes]) -> np.ndarray:
    """SimHash of 64 * LANES bits over the distinct shingles of FINE_WORDS words, as LANES longs."""
    shingles = shingle_set(found, FINE_WORDS)
    counts = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(shingles), _CHUNK):
        for lane in range(LANES):
            h = _mix(shingles[at : at + _CHUNK] + np.uint64(lane * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            counts[lane] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), axis=1, bitorder="little").view(np.int64).ravel()


def sampled_segments(found: list[bytes]) -> np.ndarray:
    """32-bit SimHashes of samples of the distinct shingles of WORDS words, two in each long (no words: zeros)."""
    shingles = shingle_set(found, WORDS)
    segments = np.zeros((len(SAMPLES), 4), np.uint8)
    for i, size in enumerate(SAMPLES if len(shingles) else ()):
        h = _mix(shingles + np.uint64((i + LANES) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        least = np.partition(h, size - 1)[:size] if len(h) > size else h
        # the lower halves: the upper ones of the least are all small
        counts = np.unpackbits(least.astype(np.uint32).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(0, dtype=np.int64)
        segments[i] = np.packbits(2 * counts > len(least), bitorder="little")
    return segments.ravel().view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of at least SIMILARITY."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(a) + len(b) - shared)


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, t1 and t2 (128 bits that name the sequence of words), fingerprint, sampled segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                found = words(x.as_py())
                rows.append(np.concatenate((np.frombuffer(xxhash.xxh3_128_digest(b" ".join(found)), np.int64), wide_fingerprint(found), sampled_segments(found))))
            cells = np.array(rows, np.int64).reshape(-1, 2 + len(_FPS + _SAMPLED))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cells.T.copy())], ["doc_id", "t1", "t2", *_FPS, *_SAMPLED])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).where("doc_id is not null").mapInArrow(run, "doc_id long, t1 long, t2 long, " + ", ".join(f"{f} long" for f in _FPS + _SAMPLED))


def _entries(nodes: DataFrame) -> DataFrame:
    """(k, node): each text under its keys. A key's number is its segment's, then 32 bits."""
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])

    def half(column: str, s: int):
        return F.shiftrightunsigned(f"{column}{s // 2}", 32 * (s % 2)).bitwiseAND(0xFFFFFFFF)

    def ball(s: int):
        k = half("f", s)
        one = F.transform(F.filter(masks, lambda m: k.bitwiseAND(m) == 0), lambda m: k.bitwiseOR(m))
        return F.transform(F.concat(F.array(k), one), lambda x: x + (s << 32))

    sampled = F.array(*[half("s", s) + (s + 2 * LANES << 32) for s in range(len(SAMPLES))])
    return nodes.select("node", F.explode(F.concat(*[ball(s) for s in range(2 * LANES)], sampled)).alias("k"))


def _members(nodes: DataFrame) -> DataFrame:
    """k, node and leader (the key's smallest text), of keys where texts meet. There are some 150 keys a text, nearly all of
    them its own, so they are moved once and sorted; an aggregation would keep them all in memory and leave as many."""
    at = Window.partitionBy("k")
    met = _entries(nodes).select("k", "node", F.min("node").over(at).alias("leader"), F.max("node").over(at).alias("last"))
    return met.where("leader != last").select("k", "node", "leader")


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose complete fingerprints differ by at most DISTANCE bits."""
    side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(f).alias(c + f) for f in _FPS])
    apart = sum((F.bit_count(F.col("a" + f).bitwiseXOR(F.col("b" + f))) for f in _FPS), F.lit(0))
    return written(pairs.join(side("b"), "b").join(side("a"), "a").where(apart <= DISTANCE).select("a", "b"), "near-pairs")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, data: the different texts of each of the ids, which may repeat."""
    ids = written(ids.toDF("doc_id").distinct(), "near-ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))
    return written(join_small(own, ids, ["doc_id"], "left_semi").withColumn("h", F.xxhash64("data")).dropDuplicates(["doc_id", "h"]), "near-texts")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts are alike. Only the texts that are in a pair are moved."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b"))), docs)
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("data").alias("data_" + c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = b"", shingle_set([], WORDS)
        for batch in batches:
            kept = []
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x = x.as_py()
                if x != last:
                    last, first = x, shingle_set(words(x), WORDS)
                if alike(first, shingle_set(words(y.as_py()), WORDS)):
                    kept.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "data_a", "data_b")
    return written(both.mapInArrow(run, "a long, b long").distinct(), "near-links")


def _met(members: DataFrame, links: DataFrame) -> DataFrame:
    """k, node, part (its component by the links) and n (texts at the key), of keys where components meet."""
    parts = members.select("k", "node").join(components(links), "node", "left").select("k", "node", F.coalesce("root", "node").alias("part"))
    met = parts.groupBy("k").agg(F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("most")).where("least != most")
    return parts.join(met.select("k", "n"), "k")


def _compared(crowds: DataFrame, nodes: DataFrame) -> DataFrame:
    """The crowds without keys that no pair is compared at: those of balls where all texts have one value, not the key itself."""
    segment, at = F.shiftright("k", 32), F.col("k").bitwiseAND(0xFFFFFFFF)
    values = F.array(*[F.shiftrightunsigned(f"f{s // 2}", 32 * (s % 2)).bitwiseAND(0xFFFFFFFF) for s in range(2 * LANES)])
    value = F.when(segment < 2 * LANES, F.get(values, segment.cast("int"))).otherwise(at)
    valued = crowds.join(nodes.select("node", *_FPS), "node").select("k", value.alias("v"), at.alias("at"))
    keys = valued.groupBy("k").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.first("at").alias("at")).where("least != most or most = at")
    return crowds.join(keys.select("k"), "k", "left_semi")


class Shingled:
    """The shingles of a task's texts as numbers, the rarest of the task first, and which texts have each one in their prefix.
    Two texts that are alike share as much as SIMILARITY of either's shingles, so one of the few that are left and one more."""

    def __init__(self, texts: list[bytes]):
        found = [shingle_set(words(t), WORDS) for t in texts]
        self.size = np.array([len(f) for f in found], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        _, own, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        text, own = np.repeat(np.arange(len(found)), self.size), rank[own]
        self.numbers = own[np.lexsort((own, text))]
        self.prefix = np.where(self.size, self.size + 1 + -SIMILARITY[0] * self.size // SIMILARITY[1], 0)
        first = np.arange(len(own)) - np.repeat(self.start[:-1], self.size) < np.repeat(self.prefix, self.size)
        order = np.argsort(self.numbers[first], kind="stable")
        self.held_by = text[first][order]
        self.held = np.searchsorted(self.numbers[first][order], np.arange(len(times) + 1))
        self.seen = np.zeros(len(times), bool)

    def alike(self, x: int, others: np.ndarray, linked: Callable[[int], bool]) -> Iterator[int]:
        """Those of the other texts that are like x, unless they are linked by then."""
        at = self.start[x]
        rare = self.numbers[at : at + self.prefix[x]]
        meets = np.zeros(len(self.size), bool)
        for lo, hi in zip(self.held[rare].tolist(), self.held[rare + 1].tolist()):
            if hi > lo + 1:
                meets[self.held_by[lo:hi]] = True
        own = self.numbers[at : self.start[x + 1]]
        self.seen[own] = True
        for y in others[meets[others]].tolist():
            if not linked(y):
                shared = np.count_nonzero(self.seen[self.numbers[self.start[y] : self.start[y + 1]]])
                if SIMILARITY[1] * shared >= SIMILARITY[0] * (len(own) + self.size[y] - shared):
                    yield y
        self.seen[own] = False


def _crossed(crowds: DataFrame, nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) of different components at a key whose complete fingerprints differ by at most DISTANCE bits; with the
    texts (doc_id, data), those whose texts are alike, and of each task's no more than join its components. Each text of a key
    goes into a block of it, and each two blocks to a task."""
    blocks = F.ceil(F.col("n") / BLOCK)
    if texts is not None:
        sizes = texts.groupBy(F.col("doc_id").alias("node")).agg(F.sum(F.length("data")).alias("size"))
        crowds = crowds.join(crowds.join(sizes, "node").groupBy("k").agg(F.sum("size").alias("bytes")), "k")
        blocks = F.greatest(blocks, F.ceil(F.col("bytes") / BLOCK_BYTES))
    dealt = crowds.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part").join(nodes.select("node", *_FPS), "node")
    if texts is not None:
        rows = rows.join(texts.select(F.col("doc_id").alias("node"), "data"), "node")

    def run(table: pa.Table) -> pa.Table:
        k, i, j = (table[c][0].as_py() for c in ("k", "i", "j"))
        own, node, part = (table[c].to_numpy() for c in ("own", "node", "part"))
        prints = np.stack([table[f].to_numpy() for f in _FPS], 1).view(np.uint64)
        segment = k >> 32
        value = prints[:, segment // 2] >> np.uint64(32 * (segment % 2)) & np.uint64(0xFFFFFFFF) if segment < 2 * LANES else None
        right = np.flatnonzero(own == j)
        found = [np.zeros((2, 0), np.int64)]
        shingled, with_texts = None, "data" in table.column_names
        above: dict[int, int] = {}

        def root(p: int) -> int:
            while (q := above.get(p, p)) != p:
                above[p] = p = above.get(q, q)
            return p

        for left in np.array_split(np.flatnonzero(own == i), max(1, len(right) // 64)):
            apart = sum(np.bitwise_count(prints[left, f][:, None] ^ prints[right, f]).astype(np.int16) for f in range(LANES))
            near = (apart <= DISTANCE) & (part[left][:, None] != part[right])
            if i == j:
                near &= node[left][:, None] < node[right]
            if value is not None:
                # texts with one value meet at that key, too
                near &= (value[left][:, None] != value[right]) | (value[right] == (k & 0xFFFFFFFF))
            x, y = np.nonzero(near)
            if with_texts and len(x):
                shingled = shingled or Shingled(table["data"].to_pylist())
                cuts, joined = np.searchsorted(x, np.arange(len(left) + 1)), []
                for one, lo, hi in zip(range(len(left)), cuts.tolist(), cuts[1:].tolist()):
                    mine = part[left[one]]
                    for other in shingled.alike(left[one], right[y[lo:hi]], lambda o, mine=mine: root(mine) == root(part[o])) if hi > lo else ():
                        above[root(part[other])] = root(mine)
                        joined.append((one, other))
                x, y = np.array(joined, np.int64).reshape(-1, 2).T
                y = np.searchsorted(right, y)
            found.append(np.stack([np.minimum(node[left[x]], node[right[y]]), np.maximum(node[left[x]], node[right[y]])]))
        return pa.table(dict(zip("ab", map(pa.array, np.concatenate(found, 1)))))

    # small as they are, the blocks take long: they stay in as many tasks as there are partitions
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "i", "j")
    return rows.groupBy("k", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_texts(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that links reach, its own included), once for each id and text."""
    own = written(_prints(docs), "near-prints")
    first = written(own.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), *[F.first(f).alias(f) for f in _FPS + _SAMPLED]), "near-first")
    nodes = written(first.dropDuplicates(["node"]).select("node", *_FPS, *_SAMPLED), "near-nodes")
    members = written(_members(nodes), "near-members")

    tried = _near(members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes)
    links = _verified(tried, docs)

    rest = written(_met(members, links), "near-open")
    few, many = rest.where(F.col("n") <= CROWD).select("k", "node", "part"), rest.where(F.col("n") > CROWD)
    other = few.select("k", F.col("node").alias("other"), F.col("part").alias("other_part"))
    pairs = few.join(other, "k").where("node < other and part != other_part").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(_verified(_near(pairs, nodes), docs))
    if not many.isEmpty():
        crowds = written(_compared(_met(members.join(many.select("k").distinct(), "k", "left_semi"), links), nodes), "near-crowds")
        links = links.union(written(_crossed(crowds, nodes, _texts_of(crowds.select("node"), docs)), "near-crossed"))
    roots = components(links.unionByName(_same_id(own, first)))
    named = own.select("doc_id", "t1", "t2").join(first.select("t1", "t2", "node"), ["t1", "t2"])
    return named.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("component_id"))


def _same_id(own: DataFrame, first: DataFrame) -> DataFrame:
    """Links between the texts of rows that share an id."""
    texts = own.select("doc_id", "t1", "t2").join(first.select("t1", "t2", "node"), ["t1", "t2"])
    return texts.where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct().join(first.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")


def drop_near_texts(docs: DataFrame) -> DataFrame:
    """docs with one row for each group of near copies: that of the group's smallest doc_id. Of repeated rows with that id
    one stays. Rows without an id stay as they are."""
    keep = near_texts(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).union(docs.where("doc_id is null"))
