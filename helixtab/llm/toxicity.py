"""Toxicity scores by a factorization machine over hashed terms.

Terms: the words (runs of letters, lower case) of a text and their first 3 to 5 characters, each hashed to one
of 2^22 slots, at levels: a term that occurs once, twice, three or five times in a text is a term each. The machine has
a weight and a small vector for each slot that training texts tie to the label, for or against it, and for the COMMON
slots that most of them have, whatever their labels. So pairs of terms (an insult and a group, each of which clean texts
have too) add what single weights miss. Not learned: pairs of terms that are both rare and neutral on their own.

Nulls: a null text is empty and scores the prior. Labels that are null, and those without a document, are not
learned from; repeated rows count as they come. No labelled row, or one class only: every score is 0.0.
Empty tables give empty results. Extra columns are carried along by score(), and ignored otherwise; one with the name of
the score is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import written

SLOTS, LEVELS = 1 << 22, (1, 2, 3, 5)
#: A slot's least texts and least gain in log likelihood by the label; below it, counts this telling come up by chance.
MIN_TEXTS, MIN_GAIN = 3, 6.0
#: Slots of the most texts that are in the machine in any case.
COMMON = 300
#: Words whose slots a worker remembers, about 1 kB each.
WORDS_HELD = 80_000
WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> set[int]:
    """Hashes of a word and of its first 3, 4 and 5 characters."""
    return {xxhash.xxh32_intdigest(t.encode()) for t in ["=" + word, *[word[:k] for k in (3, 4, 5) if len(word) >= k]]}


def slot(term: int, level: int) -> int:
    return (term * 2654435761 + level * 40503) % (1 << 32) >> 10


#: What each level adds to a term's hash (see slot).
_STEPS = tuple((n, n * 40503) for n in LEVELS)


class Selected(dict):
    """word -> its terms with the levels that the model knows and their positions among its sorted slots; without
    slots, every level at its slot. Words share their first characters, so what those give is remembered apart."""

    def __init__(self, slots: np.ndarray | None):
        super().__init__()
        self.at = None if slots is None else {int(s): i for i, s in enumerate(slots)}
        self.starts: dict[str, tuple[int, tuple]] = {}
        self.full = 0

    def _levels(self, term: int) -> tuple:
        if self.at is None:
            return tuple((n, slot(term, n)) for n in LEVELS)
        x, at = term * 2654435761, self.at
        return tuple([(n, i) for n, step in _STEPS if (i := at.get((x + step & 0xFFFFFFFF) >> 10)) is not None])

    def _start(self, start: str) -> tuple[int, tuple]:
        if len(self.starts) >= WORDS_HELD:
            self.starts.clear()
        term = xxhash.xxh32_intdigest(start.encode())
        self.starts[start] = found = (term, self._levels(term))
        return found

    def __missing__(self, word: str) -> tuple:
        # words without a known term are small
        if self.full >= WORDS_HELD or len(self) >= 4 * WORDS_HELD:
            self.clear()
            self.full = 0
        term = xxhash.xxh32_intdigest(("=" + word).encode())
        known, starts = {term: self._levels(term)}, self.starts
        for k in (3, 4, 5):
            if len(word) < k:
                break
            term, own = starts.get(word[:k]) or self._start(word[:k])
            known[term] = own
        self[word] = found = tuple([x for x in known.items() if x[1]])
        self.full += bool(found)
        return found

    def of(self, text: str) -> list[int]:
        """Positions of the (term, level) pairs of a text: a term that occurs n times is at all levels up to n."""
        counts: dict[int, int] = {}
        levels: dict[int, tuple] = {}
        for w, n in Counter(WORD.findall(text.lower())).items():
            for t, own in self[w]:
                counts[t] = counts.get(t, 0) + n
                levels[t] = own
        return sorted({i for t, n in counts.items() for least, i in levels[t] if n >= least})


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over a text's selected terms."""

    slots: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: list[int]) -> float:
        if not at:
            return self.bias
        v = self.v[at]
        return float(self.bias + self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, at: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at), -40, 40))))


def _train(slots: np.ndarray, flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, rank: int, epochs: int, keep: float = 0.7, decay: float = 1e-4, seed: int = 11) -> Machine:
    """flat: the rows' positions one after another. Adagrad on the logistic loss, classes weighted by the square root of their rarity. Terms are left out by chance,
    so that each learns to speak for itself; those that stay count for more by as much."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(slots)), rng.normal(0, 0.05, (len(slots), rank))
    gw, gv, bias, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), -2.0, 1e-2
    weight = np.where(y == 1, np.sqrt(0.5 / max(y.mean(), 1e-6)), np.sqrt(0.5 / max(1 - y.mean(), 1e-6)))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // 256)):
            at = np.concatenate([flat[starts[i] : starts[i + 1]] for i in part]) if len(part) else flat[:0]
            row = np.repeat(np.arange(len(part)), lengths[part])
            stay = rng.random(len(at)) < keep
            at, row = at[stay], row[stay]
            x = v[at] / keep
            total = np.stack([np.bincount(row, x[:, k], len(part)) for k in range(rank)], 1)
            square = np.bincount(row, (x**2).sum(1), len(part))
            z = bias + np.bincount(row, w[at], len(part)) / keep + 0.5 * ((total**2).sum(1) - square)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            pair = d[row, None] * (total[row] - x) / keep
            grad_w = np.bincount(at, d[row] / keep, len(w)) + decay * w
            grad_v = np.stack([np.bincount(at, pair[:, k], len(w)) for k in range(rank)], 1) + decay * v
            gw, gv, gb = gw + grad_w**2, gv + grad_v**2, gb + d.sum() ** 2
            w, v, bias = w - 0.3 * grad_w / np.sqrt(gw), v - 0.1 * grad_v / np.sqrt(gv), bias - 0.1 * d.sum() / np.sqrt(gb)
    return Machine(slots, float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", max_rows: int = 6000, common: int = COMMON, rank: int = 4, epochs: int = 25) -> Machine | None:
    """Learns from at most max_rows labelled rows of each class, those with the smallest hashes of doc_id; `learn` is
    a condition on the labels' rows. Spark counts the slots of these texts; those that the label goes with, or that go
    without it, by MIN_GAIN and the `common` ones of most texts go into the machine; there are no more than the bounded
    sample's texts have. Returns None if there are not two classes."""
    rows = labels.where(f"doc_id is not null and {label} in (0, 1)").where(F.lit(True) if learn is None else learn).select("doc_id", F.col(label).cast("int").alias("y")).dropDuplicates(["doc_id"])
    picked = [rows.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    # bounded by max_rows, so it may be broadcast
    sample = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("y", "text"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, n = Selected(None), np.zeros((2, SLOTS), np.int32)
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y][find.of(text)] += 1
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], ["slot", "n0", "n1"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    seen = sample.mapInArrow(count, "slot long, n0 int, n1 int").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share, n = sizes[1] / (sizes[0] + sizes[1]), F.col("n0") + F.col("n1")
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rest0, rest1 = sizes[0] - F.col("n0"), sizes[1] - F.col("n1")
    gain = cell(F.col("n1"), n * share) + cell(F.col("n0"), n * (1 - share)) + cell(rest1, (rest0 + rest1) * share) + cell(rest0, (rest0 + rest1) * (1 - share))
    known = seen.where(n >= MIN_TEXTS).select("slot", n.alias("n"), gain.alias("gain"))
    best = known.where(F.col("gain") >= MIN_GAIN).select("slot").union(known.orderBy(F.desc("n"), "slot").limit(common).select("slot")).distinct()
    slots = np.sort(np.array([r["slot"] for r in best.collect()], np.int64))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Selected(slots)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find.of(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["y", "at"])

    data = sample.mapInArrow(features, "y int, at array<int>").toArrow()
    at = data["at"].combine_chunks()
    return _train(slots, at.flatten().to_numpy(), at.value_lengths().to_numpy(), data["y"].to_numpy().astype(np.float64), rank, epochs)


def score(docs: DataFrame, machine: Machine | None, column: str = "toxicity") -> DataFrame:
    """docs with the score (0 to 1) of each whole text. The machine is bounded by the sample it was fitted on."""
    docs = docs.drop(column)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    text_at = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        find = Selected(m.slots) if m else None
        for b in batches:
            s = [m.score(find.of(t or "")) if m else 0.0 for t in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, column])

    return docs.mapInArrow(run, schema)
