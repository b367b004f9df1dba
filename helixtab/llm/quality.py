"""Quality rules: counting rules, then a language-specific band of perplexities under an n-gram model.

The model is an interpolated modified Kneser-Ney model of order 5 over the characters of words: a word is the
sequence of its characters and an end, after a start. Spark counts the n-grams of all texts of a language, for each
language apart; continuation counts, discounts, probabilities and backoffs are aggregations and joins on n-gram
tables. No n-gram is cut. The model is that of the texts it scores, so it has every gram it is asked for. Those that
make up at least KEEP of all symbols (1 / KEEP at most, a proven bound) are in an array sorted by hash, which tasks
search; the probabilities of all others are joined to the texts that have them.

A text's perplexity is that of all its words. Each language has a band around the median of its logarithm, over all
texts that the counting rules pass; texts outside it are rejected. The mean over few symbols strays more than that over
many, so the band of a text of n symbols reaches WIDTH * sqrt(spread^2 / n + drift^2) up and down: spread is the
language's median of |deviation| * sqrt(n), drift its median |deviation| among texts of at least the median length; both
have a least value, for languages of few texts.

Nulls: a null text has no words and fails the base rules; a null language is a language, another than the empty one.
Repeated rows count as rows. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtab.llm.shared import CACHE_ENTRIES, join_small, text_bytes, written

ORDER, KEEP = 5, 2.0**-24
WIDTH, MIN_SPREAD, MIN_DRIFT = 4.0, 0.25, 0.004
START, END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(data: bytes) -> tuple[tuple[int, int, int, int, int], dict[bytes, int], np.ndarray]:
    """The five base counts of a text in UTF-8, its distinct words and how often it has each."""
    w = data.split()  # at 0x20 and 0x09-0x0D
    n = len(w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    first: dict[bytes, int] = {}
    at = np.fromiter(map(first.setdefault, w, range(n)), np.int64, n)
    times = np.bincount(at, minlength=n)[np.fromiter(first.values(), np.int64, len(first))]
    repeated = 0
    if n >= 4:
        pairs = at[:-2] * n + at[1:-1]
        if n >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, inverse, found = np.unique(pairs * n + at[2:], return_inverse=True, return_counts=True)
        starts = found[inverse] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= starts
        repeated = int(inside.sum())
    chars = len(str(data, "utf-8", "replace")) - sum(map(data.count, b" \t\n\v\f\r"))
    return (n, chars, sum(map(data.count, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated), first, times


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    return _words(text.encode())[0]


def _codes(strings: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The strings in one, its code points, and the strings' lengths."""
    joined = "".join(strings)
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), np.fromiter(map(len, strings), np.int64, len(strings))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _hashed(seed: np.uint64 | np.ndarray, codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the grams of `lengths` symbols, ORDER at most, whose last ones are at `ends`; the seed is that
    of the language."""
    h = np.array(np.broadcast_to(seed, len(ends)), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        on = np.flatnonzero(lengths > back)
        x = (h[on] ^ codes[ends[on] - back]) * _MIX
        h[on] = x ^ (x >> np.uint64(32))
    return h


@dataclass
class WordGrams:
    """The n-gram that ends at each symbol of some words after the start, of the full order or from the start on;
    grams found several times are listed once."""

    joined: str
    codes: np.ndarray
    ends: np.ndarray  #: of each distinct gram, its last symbol
    lengths: np.ndarray
    which: np.ndarray  #: for each symbol of each word, its gram
    sizes: np.ndarray  #: symbols of each word, the end included

    @staticmethod
    def of(words: list[str], seed: np.uint64) -> WordGrams:
        joined, codes, lengths = _codes([f"{START}{w}{END}" for w in words])
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ends = np.flatnonzero(place > 0)
        long = np.minimum(place[ends] + 1, ORDER)
        _, first, which = np.unique(_hashed(seed, codes, ends, long), return_index=True, return_inverse=True)
        return WordGrams(joined, codes, ends[first], long[first], which, lengths - 1)

    def strings(self) -> list[str]:
        return [self.joined[e - n + 1 : e + 1] for e, n in zip(self.ends.tolist(), self.lengths.tolist())]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all texts; grams of the full order or that begin with the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            for lang, counts in held.items():
                grams = WordGrams.of([str(w, "utf-8", "replace") for w in counts], _seed(lang))
                n = np.bincount(grams.which, np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), grams.sizes), len(grams.ends))
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), "gram": grams.strings(), "n": n.astype(np.int64)}, schema=schema)
            held.clear()

        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(data.split())
                if sum(map(len, held.values())) > CACHE_ENTRIES:
                    yield from out()
        yield from out()

    return _texts(docs).select("lang", "data").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    """Texts as bytes; lang: = and the language, or empty if that is null."""
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), text_bytes().alias("data"), F.col("doc_id").cast("long").alias("doc_id"))


def _levels(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, k, gram, n, p (its last symbol's probability after the others), and lang, gram, bow (a history's backoff
    weight), of all grams.

    Of each order: a gram's count n is its own at the full order and at the start of words, else the number of
    symbols seen before it. Discounts by modified Kneser-Ney; the lowest order is interpolated with the same
    probability for every symbol seen and one unseen.
    """
    n = F.col("n")
    levels = {ORDER: counts.where(F.length("gram") == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        after = levels[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = after.unionByName(counts.where((F.length("gram") == k) & F.col("gram").startswith(START))) if k > 1 else after
    grams = written(reduce(DataFrame.unionByName, [x.withColumn("k", F.lit(k)) for k, x in levels.items()]), "kn-counts")
    c = [F.sum((n == i).cast("double")).alias(f"c{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))

    def discount(i: int):
        found = i - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}"))
        return F.when((F.col("c1") > 0) & (F.col(f"c{i}") > 0) & (found > 0) & (found <= i), found).otherwise(F.lit(i * 0.5))

    discounts = grams.groupBy("lang", "k").agg(*c).select("lang", "k", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    own = Window.partitionBy("lang", "k", "h")  # no more rows than there are symbols
    d = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    parts = grams.join(F.broadcast(discounts), ["lang", "k"]).withColumn("h", F.expr("substring(gram, 1, k - 1)")).withColumn("s", F.sum("n").over(own)).withColumn("alpha", F.greatest(n - d, F.lit(0.0)) / F.col("s")).withColumn("gamma", F.sum(F.least(d, n)).over(own) / F.col("s"))
    parts = written(parts.select("lang", "k", "gram", "h", "n", "alpha", "gamma"), "kn-parts")
    symbols = parts.where("k = 1").groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("lower"))
    done = [parts.where("k = 1").join(symbols, "lang").withColumn("p", F.col("alpha") + F.col("gamma") * F.col("lower"))]
    for k in range(2, ORDER + 1):
        lower = done[-1].select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
        level = parts.where(F.col("k") == k).withColumn("tail", F.expr("substring(gram, 2)"))
        done.append(written(level.join(lower, ["lang", "tail"], "left").withColumn("p", F.col("alpha") + F.col("gamma") * F.coalesce("lower", F.lit(1e-9))).drop("tail", "lower"), "kn-level"))
    probs = reduce(DataFrame.unionByName, [x.select("lang", "k", "gram", "n", "p") for x in done])
    bows = parts.groupBy("lang", F.col("h").alias("gram")).agg(F.first("gamma").alias("bow"))
    return probs, bows


def model(counts: DataFrame) -> DataFrame:
    """lang, gram, p (log10 of its last symbol's probability after the others), bow (log10 of its backoff weight)."""
    probs, bows = _levels(counts)
    grams = probs.select("lang", "gram", "p")
    start = bows.where(F.col("gram").isin("", START)).join(grams, ["lang", "gram"], "left_anti").select("lang", "gram", F.lit(None).cast("double").alias("p"))
    return grams.unionByName(start).join(bows, ["lang", "gram"], "left").select("lang", "gram", F.log10("p").cast("float").alias("p"), F.log10("bow").cast("float").alias("bow"))


def _text_grams(counts: DataFrame) -> DataFrame:
    """lang, gram, n (its own count), p (log10) of each gram that texts have: of the full order or from the start on."""
    probs = _levels(counts)[0].where((F.col("k") == ORDER) | F.col("gram").startswith(START))
    return probs.groupBy("lang", "gram").agg(F.max("n").alias("n"), F.log10(F.max("p")).cast("float").alias("p"))


def _row_hashes(langs: pa.Array, grams: pa.Array) -> np.ndarray:
    """The hash of each row's language and gram."""
    langs = langs.dictionary_encode()
    seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], np.uint64)
    _, codes, lengths = _codes(grams.to_pylist())
    return _hashed(seeds[langs.indices.to_numpy()], codes, np.cumsum(lengths) - 1, lengths)


def _positions(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of the hashes in the sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


class Head:
    """The frequent grams: their sorted hashes and p."""

    def __init__(self, grams: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(_row_hashes(b.column(0), b.column(1)).view(np.int64)), b.column(2)], ["key", "p"])

        rows = grams.select("lang", "gram", "p").mapInArrow(run, "key long, p float").toArrow()  # 1 / KEEP rows at most
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.p = keys[order], np.append(rows["p"].to_numpy().astype(np.float32)[order], np.float32(np.nan))

    def word_scores(self, lang: str, words: list[str]) -> tuple[np.ndarray, dict[int, list[str]]]:
        """log10 probability of each word, as far as its grams are here; of words that have others, all those."""
        grams = WordGrams.of(words, _seed(lang))
        p = self.p[_positions(self.keys, _hashed(_seed(lang), grams.codes, grams.ends, grams.lengths))].astype(np.float64)
        firsts = np.cumsum(grams.sizes) - grams.sizes
        others: dict[int, list[str]] = {}
        gone = np.isnan(p)
        if gone.any():
            at = np.flatnonzero(gone[grams.which])
            for word, g in zip((np.searchsorted(firsts, at, "right") - 1).tolist(), grams.which[at].tolist()):
                others.setdefault(word, []).append(grams.joined[grams.ends[g] - grams.lengths[g] + 1 : grams.ends[g] + 1])
        return np.add.reduceat(np.nan_to_num(p)[grams.which], firsts), others


class SortedModel:
    """A whole small model() in sorted hash arrays, for grams that no text has too: the hash of language and gram, p
    and bow."""

    def __init__(self, rows: pa.Table):
        keys = _row_hashes(rows["lang"].combine_chunks(), rows["gram"])
        order = np.argsort(keys)
        self.keys = keys[order]
        # the last place, which a gram that isn't there gets, holds no number
        self.p, self.bow = (np.append(rows[c].fill_null(np.nan).to_numpy().astype(np.float32)[order], np.float32(np.nan)) for c in ("p", "bow"))

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        return _positions(self.keys, hashes)

    def look_up(self, seed: np.uint64, codes: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the last symbol's probability in each gram: that of the longest ending the model has, and the
        backoffs of the longer histories."""
        p, left, open_ = np.zeros(len(ends)), lengths.copy(), np.flatnonzero(lengths > 0)
        while len(open_):
            found = self.p[self._at(_hashed(seed, codes, ends[open_], left[open_]))]
            hit = ~np.isnan(found)
            p[open_[hit]] += found[hit]
            open_ = open_[~hit]
            p[open_] += np.nan_to_num(self.bow[self._at(_hashed(seed, codes, ends[open_] - 1, left[open_] - 1))])
            left[open_] -= 1
            p[open_[left[open_] == 0]] -= 3.0  # a symbol never seen
            open_ = open_[left[open_] > 0]
        return p

    def probabilities(self, lang: str, grams: list[str]) -> np.ndarray:
        _, codes, lengths = _codes(grams)
        return self.look_up(_seed(lang), codes, np.cumsum(lengths) - 1, lengths)

    def word_scores(self, lang: str, words: list[str]) -> np.ndarray:
        """log10 probability of each word."""
        grams = WordGrams.of(words, _seed(lang))
        p = self.look_up(_seed(lang), grams.codes, grams.ends, grams.lengths)
        return np.add.reduceat(p[grams.which], np.cumsum(grams.sizes) - grams.sizes)


def scored(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, lang, the five base counts, and perplexity (null without words) of each row; grams: _text_grams() of
    these rows, written.

    A task sums what the head has, and returns each text's other grams. No such gram is frequent, so no key of the join
    with their probabilities is hot.
    """
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_head = F.col("n") >= total * KEEP
    sent = docs.sparkSession.sparkContext.broadcast(Head(grams.where(in_head)))
    names = ["row", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "total", "grams", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, float]] = {}
        others: dict[str, dict[bytes, list[str]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                held = [(lang, *_words(data)) for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                if sum(map(len, known.values())) > CACHE_ENTRIES:
                    known.clear()
                    others.clear()
                new: dict[str, set[bytes]] = {}
                for lang, _, first, _ in held:
                    own = known.setdefault(lang, {})
                    new.setdefault(lang, set()).update(w for w in first if w not in own)
                for lang, found in new.items():
                    if found:
                        some = list(found)
                        scores, rest = sent.value.word_scores(lang, [str(w, "utf-8", "replace") for w in some])
                        known[lang].update(zip(some, scores.tolist()))
                        others.setdefault(lang, {}).update((some[i], g) for i, g in rest.items())
                out = []
                for lang, base, first, times in held:
                    rare: Counter = Counter()
                    if own := others.get(lang):
                        for w, m in zip(first, times.tolist()):
                            for g in own.get(w, ()):
                                rare[g] += m
                    out.append((*base, float(np.fromiter(map(known[lang].__getitem__, first), np.float64, len(first)) @ times), list(rare), list(rare.values())))
                cols = list(zip(*out)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([b.column(3), b.column(2), b.column(0), *[pa.array(x, pa.int64()) for x in cols[:5]], pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.list_(pa.string())), pa.array(cols[7], pa.list_(pa.int64()))], names)

    # written, so each row keeps its number
    texts = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    parts = written(texts.mapInArrow(run, "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, total double, grams array<string>, times array<long>"), "quality-parts")
    rest = parts.where(F.size("grams") > 0).select("row", "lang", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "lang", F.col("x.grams").alias("gram"), F.col("x.times").alias("m"))
    more = rest.join(grams.where(~in_head).select("lang", "gram", "p"), ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("m") * F.col("p").cast("double")).alias("more"))
    mean = -(F.col("total") + F.coalesce("more", F.lit(0.0))) / (F.col("word_chars") + F.col("n_words"))
    return parts.join(more, "row", "left").select("doc_id", "lang", *names[3:8], F.when(F.col("n_words") > 0, F.pow(F.lit(10.0), F.least(mean, F.lit(300.0)))).alias("perplexity"))


def bands(fit: DataFrame) -> DataFrame:
    """lang, middle, spread, drift over rows with lang, x (log10 of the perplexity) and n (symbols)."""
    median = lambda x: F.percentile_approx(x, 0.5, 10000)
    middle = written(fit.groupBy("lang").agg(median("x").alias("middle"), median("n").alias("middle_n")), "quality-middle")
    off = F.abs(F.col("x") - F.col("middle"))
    found = join_small(fit, middle, ["lang"]).groupBy("lang").agg(F.first("middle").alias("middle"), median(off * F.sqrt("n")).alias("spread"), median(F.when(F.col("n") >= F.col("middle_n"), off)).alias("drift"))
    return found.select("lang", "middle", F.greatest("spread", F.lit(MIN_SPREAD)).alias("spread"), F.greatest("drift", F.lit(MIN_DRIFT)).alias("drift"))


def judge(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, perplexity, low and high (the language's band at the text's
    length), kept."""
    grams = written(_text_grams(written(gram_counts(docs), "kn-grams")), "kn-text-grams")
    rows = written(scored(docs, grams), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("x", F.log10("perplexity")).withColumn("n", F.col("word_chars") + F.col("n_words"))
    banded = join_small(rows, written(bands(rows.where("not base_failed")), "quality-bands"), ["lang"], "left")
    reach = width * F.sqrt(F.col("spread") ** 2 / F.greatest("n", F.lit(1)) + F.col("drift") ** 2)
    inside = F.coalesce(F.abs(F.col("x") - F.col("middle")) <= reach, F.lit(False))
    limits = {"low": F.pow(F.lit(10.0), F.col("middle") - reach), "high": F.pow(F.lit(10.0), F.col("middle") + reach), "kept": ~F.col("base_failed") & inside, "lang": F.when(F.col("lang") != "", F.expr("substring(lang, 2)"))}
    return banded.withColumns(limits).drop("x", "n", "middle", "spread", "drift")
