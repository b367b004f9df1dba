"""Class-based bigram language model: exchange clustering of words, class transitions and word emissions.

P(w | history) = P(class(w) | class of the word before) * P(w | class(w)). Transitions are class pair counts plus
0.01; emissions are (c(w) + 1) / (N_class + V_class + 1), so each class has one slot for its unknown words and the
probabilities of all words add up to 1 at most. A text's words are followed by one end token, which is also what
stands before its first word.

Units. Words that make up at least HEAD of the training tokens (1/HEAD at most, a proven bound) are units of their
own; every other word belongs to the unit of its last three bytes' hash, one of TAIL. Exchange clustering moves
units between classes, so every word gets its class from clustering, and the class of any word, however rare, is
found from a table of bounded size. Counts of all words, rare ones too, are exact over all training texts and
are joined where a text's score needs them.

Nulls: a null text is empty, just its end token. Rows with null or repeated ids are rows of their own. Without
training rows every word is unknown. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import WordHashes, text_bytes, words, written

HEAD, TAIL = 2.0**-21, 4096
CLASSES, SWEEPS = 64, 4
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
#: Tokens or distinct words that a task sums before it passes them on.
_TOKENS, WORDS_HELD = 2_000_000, 500_000


def tail_unit(word: bytes) -> int:
    return 1 + xxhash.xxh32_intdigest(word[-3:]) % TAIL


class Units(dict):
    """word -> its unit. Units: 0 is the end, then the TAIL tail units, then the head words."""

    def __init__(self, head: np.ndarray):
        super().__init__()
        self.head = dict(zip(head.tolist(), range(1 + TAIL, 1 + TAIL + len(head))))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = unit = self.head.get(xxhash.xxh64_intdigest(word)) or tail_unit(word)
        return unit

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


_units: dict[int, Units] = {}


def _units_of(head: np.ndarray) -> Units:
    """One for each worker, so that what it has looked up serves all its tasks with the same head."""
    key = xxhash.xxh64_intdigest(head.tobytes())
    if key not in _units:
        _units.clear()
        _units[key] = Units(head)
    return _units[key]


@dataclass
class Model:
    head: np.ndarray  # sorted hashes of the head words
    head_count: np.ndarray
    classes: np.ndarray  # of each unit
    transition: np.ndarray  # log10 of P(class | class before)
    class_tokens: np.ndarray
    class_words: np.ndarray  # distinct training words of each class
    n: int  # training tokens
    v: int  # distinct training tokens


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, counts, len(found)).astype(np.int64)


def _folded(parts: Iterator[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums equal keys of many small arrays, a bounded number of tokens at a time."""
    held, size = [], 0

    def out():
        keys, n = _summed(np.concatenate(held))
        for at in range(0, len(keys), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)].view(np.int64)), pa.array(n[at : at + (1 << 18)])], names)

    for p in parts:
        held.append(p)
        size += len(p)
        if size >= _TOKENS:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def word_counts(docs: DataFrame) -> DataFrame:
    """h (XXH64 of a word, lower-cased A-Z; END for the ends), t (the tail unit a word has unless it is in the head;
    0 for the ends), n: exact counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            n = len(held)
            tails = np.fromiter((tail_unit(w) if w else 0 for w in held), np.int32, n)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w else END for w in held), np.uint64, n)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(tails), pa.array(np.fromiter(held.values(), np.int64, n))], ["h", "t", "n"])

        for b in batches:
            for t in b.column(0):
                held.update(words(t.as_py()))
                held[b""] += 1
                if len(held) > WORDS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text_bytes().alias("data")).mapInArrow(run, "h long, t int, n long").groupBy("h", "t").agg(F.sum("n").alias("n"))


def unit_bigrams(docs: DataFrame, head: np.ndarray) -> DataFrame:
    """a, b (units that follow each other), n."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units_of(sent.value)

        def pairs():
            for b in batches:
                for t in b.column(0):
                    u = np.concatenate(([0], units.of(words(t.as_py())), [0]))
                    yield (u[:-1] << 32) | u[1:]

        yield from _folded(pairs(), ["ab", "n"])

    found = docs.select(text_bytes().alias("data")).mapInArrow(run, "ab long, n long").groupBy("ab").agg(F.sum("n").alias("n"))
    return found.select(F.shiftright("ab", 32).cast("int").alias("a"), F.col("ab").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), F.col("n"))


def _neighbours(bigrams: DataFrame) -> DataFrame:
    """unit; o0, n0: units that follow it and how often; o1, n1: units that it follows; odd: if the unit is, by which the
    table is parted. A unit's lists are no longer than the bounded number of units."""
    both = bigrams.select(F.explode(F.array(F.struct(F.col("a").alias("unit"), F.lit(0).alias("side"), F.col("b").alias("o"), "n"), F.struct(F.col("b").alias("unit"), F.lit(1).alias("side"), F.col("a").alias("o"), "n"))).alias("x")).select("x.*")
    lists = both.groupBy("unit").agg(*[F.collect_list(F.when(F.col("side") == s, F.struct("o", "n"))).alias(f"x{s}") for s in (0, 1)])
    return lists.select("unit", "x0.o", "x0.n", F.col("x1.o").alias("o1"), F.col("x1.n").alias("n1")).toDF("unit", "o0", "n0", "o1", "n1").withColumn("odd", F.col("unit") % 2)


def _context(units: pa.Array, counts: pa.Array, classes: np.ndarray, k: int) -> np.ndarray:
    """A row for each list: how often its units' classes occur."""
    size = np.diff(units.offsets.to_numpy())
    at = np.repeat(np.arange(len(size)), size)
    return np.bincount(at * k + classes[units.flatten().to_numpy()], counts.flatten().to_numpy(), len(size) * k).reshape(-1, k)


def _class_bigrams(near: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class pairs: k * k numbers."""
    sent = near.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total = sent.value, np.zeros(k * k)
        for b in batches:
            own = np.repeat(c[b.column(0).to_numpy()], np.diff(b.column(1).offsets.to_numpy()))
            total += np.bincount(own * k + c[b.column(1).flatten().to_numpy()], b.column(2).flatten().to_numpy(), k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], ["at", "n"])

    total = np.zeros(k * k)
    for r in near.select("unit", "o0", "n0").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    return total.reshape(k, k)


def exchange(near: DataFrame, unit_count: np.ndarray, k: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units. Starts with the most frequent units in classes of their own; in each half sweep, half
    of the units move to the class under which the log likelihood of their neighbours and of themselves is highest,
    given the class counts so far. The end keeps class 0 for itself."""
    n_units = len(unit_count)
    rank = np.empty(n_units, np.int64)
    rank[np.argsort(-unit_count, kind="stable")] = np.arange(n_units)
    classes = np.where(rank < k // 2, 1 + rank % (k - 1), 1 + (np.arange(n_units) * 2654435761 % 4294967296 >> 7) % (k - 1))
    classes[0] = 0
    for half in range(2 * sweeps):
        pair = _class_bigrams(near, classes, k) + 0.1
        after = np.log(pair / pair.sum(1, keepdims=True))  # [before, class]
        sent = near.sparkSession.sparkContext.broadcast((classes, after, np.log(np.bincount(classes, unit_count, k) + 0.1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, after, log_class = sent.value
            for b in batches:
                units = b.column(0).to_numpy()
                right, left = _context(b.column(1), b.column(2), c, k), _context(b.column(3), b.column(4), c, k)
                gain = right @ after.T + left @ after - left.sum(1, keepdims=True) * log_class
                gain[:, 0] = -np.inf
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gain.argmax(1).astype(np.int32))], ["unit", "c"])

        movable = near.where((F.col("odd") == half % 2) & (F.col("unit") > 0)).drop("odd")
        moved = movable.mapInArrow(run, "unit int, c int").toArrow()  # a number for each unit, bounded as they are
        classes = classes.copy()
        classes[moved["unit"].to_numpy()] = moved["c"].to_numpy()
    return classes


def fit(training: DataFrame, counts: DataFrame, head_share: float = HEAD, classes: int = CLASSES, sweeps: int = SWEEPS) -> Model:
    """The model of the training texts; counts: word_counts() of them, written."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # at most 1 / head_share words can make up so large a share: a proven bound
    top = counts.where((F.col("n") >= max(2, n * head_share)) & (F.col("h") != F.lit(int(np.uint64(END).view(np.int64))))).toArrow()
    head, head_count = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(head)
    head, head_count = head[order], head_count[order]
    bigrams = written(unit_bigrams(training, head), "brown-bigrams")
    n_units = 1 + TAIL + len(head)
    unit_count = np.zeros(n_units, np.int64)
    per_unit = bigrams.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    unit_count[per_unit["b"].to_numpy()] = per_unit["n"].to_numpy()
    near = written(_neighbours(bigrams), "brown-near", "odd")
    of = exchange(near, unit_count, classes, sweeps) if n else np.minimum(np.arange(n_units), 1)
    pair = _class_bigrams(near, of, classes) + 0.01
    kinds = np.ones(n_units, np.int64)  # distinct words of each unit
    kinds[1 : 1 + TAIL] = 0
    rare = counts.where((F.col("n") < max(2, n * head_share)) & (F.col("t") > 0)).groupBy("t").count().toArrow()
    kinds[rare["t"].to_numpy()] = rare["count"].to_numpy()
    return Model(head, head_count, of, np.log10(pair / pair.sum(1, keepdims=True)), np.bincount(of, unit_count, classes), np.bincount(of, kinds, classes), int(n), int(v))


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row; scores are log10 probabilities of the whole text.

    A task has all it needs but the counts of words outside the head: it returns a row for each text, with what does
    not depend on them, and a row for each of the text's distinct other words. Their counts are joined and all is
    summed by text. No such word is frequent, so no key of the join is hot.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "text_hash", "h", "m", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        units, hashes = _units_of(m.head), WordHashes()
        slots = np.log10(m.n + m.v + 1)
        room = np.log10(m.class_tokens + m.class_words + 1)
        unit_log = np.log10(np.concatenate(([m.class_tokens[0]], np.zeros(TAIL), m.head_count)) + 1.0)
        known = np.concatenate(([m.n > 0], np.zeros(TAIL, bool), np.ones(len(m.head), bool)))
        for b in batches:
            texts, tails = [], []
            for data in b.column(1):
                data = data.as_py()
                w = words(data)
                u = np.concatenate(([0], units.of(w), [0]))
                c, u = m.classes[u], u[1:]
                total = float(unit_log[u].sum())
                at = np.flatnonzero((u > 0) & (u <= TAIL))
                h, times = np.unique(hashes.of([w[i] for i in at]), return_counts=True)
                key = xxhash.xxh64_intdigest(data)
                texts.append((key, len(u), int(known[u].sum()), total - len(u) * slots, total + float((m.transition[c[:-1], c[1:]] - room[c[1:]]).sum())))
                tails.append((h, times))
            n = np.array([len(h) for h, _ in tails])
            cols = list(zip(*texts)) or [[]] * 5
            keys = np.array(cols[0], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array(keys), pa.array(np.zeros(len(keys), np.int64)), *[pa.array(cols[i], pa.int64()) for i in (1, 2)], *[pa.array(cols[i], pa.float64()) for i in (3, 4)]], names)
            if n.sum():
                at = np.repeat(np.arange(len(n)), n)
                zero = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(keys[at]), pa.array(np.concatenate([h for h, _ in tails]).view(np.int64)), pa.array(np.concatenate([t for _, t in tails])), pa.array(zero), pa.array(zero), pa.array(zero.astype(float)), pa.array(zero.astype(float))], names)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(run, "doc_id long, text_hash long, h long, m long, n_tokens long, n_known long, base double, score double")
    c = F.coalesce("n", F.lit(0))
    more = F.col("m") * F.log10(c + 1.0)
    summed = parts.join(counts.select("h", "n"), "h", "left").groupBy("doc_id", "text_hash").agg(
        F.sum((F.col("n_tokens") > 0).cast("long")).alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(c > 0, F.col("m")).otherwise(0)).alias("n_known"), F.sum(F.col("base") + more).alias("base"), F.sum(F.col("score") + more).alias("score")
    )  # repeated rows: summed as one, then dealt out again
    each = summed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", *[F.expr(f"{x} div rows").alias(x) for x in ("n_tokens", "n_known")], (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))
