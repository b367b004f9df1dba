"""Maximal periodic runs of a text's words, by a dictionary of basic factors, and the text with its repeats collapsed.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(12, 2 q) words long, that no
neighbouring word extends.

Nulls: a null text is empty. Repeated rows are rows like others; other columns are ignored. Texts without a word have no
runs and an empty collapsed text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import text_bytes

#: The shortest run. What find_runs() proposes for periods under 5 holds for 12 words and more.
SHORTEST = 12
#: Words of the texts whose factors are named together; a longer text goes by itself.
BATCH_WORDS = 1 << 18


def _recurring(left: np.ndarray, right: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (left, right) that occur twice or more, by pair and position, and the pairs' new names."""
    bits = max(n - 1, 1).bit_length()
    if 3 * bits < 64:
        packed = np.sort((left << 2 * bits) | (right << bits) | at)
        at, key = packed & ((1 << bits) - 1), packed >> bits
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((at, right, left))
        at, left, right = at[order], left[order], right[order]
        new = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    name = np.concatenate(([0], np.cumsum(new)))
    often = np.bincount(name) > 1
    keep = often[name]
    return at[keep], (np.cumsum(often) - 1)[name[keep]]


def _proposals(at: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) from the occurrences of factors of this length: periods from length up to twice that.

    Occurrences no more than length / 2 apart are arithmetic progressions: their step is the factor's own period. A run
    of period q holds its first factor again q words on, in another progression that begins within twice the length; at
    most three do. All distances between members of two progressions are again a progression, which is proposed."""
    gap, same = np.diff(at), name[1:] == name[:-1]
    places, periods = [], []
    if length == 8:
        near = np.flatnonzero(same & (gap <= 4))
        places.append(at[near])
        periods.append(gap[near])
    starts = np.concatenate(([0], np.flatnonzero(~same | (gap > length // 2)) + 1))
    ends = np.concatenate((starts[1:] - 1, [len(at) - 1]))
    first, last, size, whose = at[starts], at[ends], ends - starts + 1, name[starts]
    step = np.where(size > 1, at[np.minimum(starts + 1, len(at) - 1)] - first, 0)
    for s in (1, 2, 3):
        a = np.flatnonzero((whose[:-s] == whose[s:]) & (first[s:] - last[:-s] < 2 * length))
        if not len(a):
            break
        b = a + s
        least, d = first[b] - last[a], np.maximum(step[a], step[b])
        some = np.maximum(d, 1)
        lo = np.maximum(-((least - length) // some), 0)
        hi = np.minimum(size[a] + size[b] - 2, (2 * length - 1 - least) // some)
        n = np.where(d > 0, np.maximum(hi - lo + 1, 0), least >= length)
        lo = np.where(d > 0, lo, 0)
        of = np.repeat(np.arange(len(a)), n)
        t = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
        places.append(last[a][of] - np.minimum(t, size[a][of] - 1) * d[of])
        periods.append(least[of] + t * d[of])
    place, period = np.concatenate(places or [at[:0]]), np.concatenate(periods or [at[:0]])
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # places of one period that are no further apart than the factor is long lie in one run
    fresh = np.concatenate(([True], (period[1:] != period[:-1]) | (np.diff(place) > length)))[: len(place)]
    return place[fresh], period[fresh]


def find_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the sequence, by start and period. ids: numbers below len(ids).

    Several texts can follow one another if they share no number: a factor that crosses from one to the next occurs
    once, and factors that occur once are dropped from all longer ones."""
    n = len(ids)
    names = [np.where(np.bincount(ids, minlength=1)[ids] > 1, ids, -1)]
    places, periods, length = [], [], 1
    while n > 2 * length:
        now = names[-1]
        at = np.flatnonzero((now[:-length] >= 0) & (now[length:] >= 0))
        at, name = _recurring(now[at], now[at + length], at, n) if len(at) else (at, at)
        if not len(at):
            break
        length *= 2
        names.append(np.full(n, -1, np.int64))
        names[-1][at] = name
        if length >= 4:
            for out, found in zip((places, periods), _proposals(at, name, length)):
                out.append(found)
    if not places:
        return (np.zeros(0, np.int64),) * 3
    at, q = np.concatenate(places), np.concatenate(periods)
    begin, end = at.copy(), at + q
    for k in range(len(names) - 1, -1, -1):  # as far as words q apart agree, by halves of the longest factor
        size, now = 1 << k, names[k]
        x, y = np.minimum(end - q, n - 1), np.minimum(end, n - 1)
        end += size * ((end + size <= n) & (now[x] >= 0) & (now[x] == now[y]))
        x = np.maximum(begin - size, 0)
        begin -= size * ((begin >= size) & (now[x] >= 0) & (now[x] == now[np.maximum(begin + q - size, 0)]))
    fits = end - begin >= np.maximum(SHORTEST, 2 * q)
    begin, end, q = begin[fits], end[fits], q[fits]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    if len(q):  # a multiple of a run's period proposes the same stretch
        own = np.concatenate(([True], (np.diff(begin) != 0) | (np.diff(end) != 0)))
        begin, end, q = begin[own], end[own], q[own]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _rows(ids: list, texts: list[list[bytes]]) -> Iterator[tuple]:
    """One result row for each text of a batch."""
    numbers, size = [], 0
    for words in texts:
        number = dict(zip(dict.fromkeys(words), range(size, size + len(words))))
        numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        size += len(words)
    begin, end, q = find_runs(np.concatenate(numbers)) if size else (np.zeros(0, np.int64),) * 3
    dropped = np.zeros(size + 1, np.int64)
    np.add.at(dropped, begin + q, 1)
    np.add.at(dropped, end, -1)
    dropped = np.cumsum(dropped) > 0
    first = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
    lo = np.searchsorted(begin, first)
    for k, (doc_id, words) in enumerate(zip(ids, texts)):
        own = slice(lo[k], lo[k + 1])
        if lo[k] == lo[k + 1]:
            yield doc_id, [], b" ".join(words)
            continue
        runs = list(zip((begin[own] - first[k]).tolist(), (end[own] - begin[own]).tolist(), q[own].tolist()))
        yield doc_id, runs, b" ".join([words[i] for i in np.flatnonzero(~dropped[first[k] : first[k + 1]]).tolist()])


def _batches(batches: Iterator[pa.RecordBatch], rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    for b in batches:
        ids, texts, size = [], [], 0
        for doc_id, data in zip(b.column(0), b.column(1)):
            ids.append(doc_id.as_py())
            words = data.as_py().split()
            texts.append(rewrite(ids[-1], words) if rewrite and words else words)
            size += len(words)
            if size >= BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _mapped(docs: DataFrame, rewrite, schema: str, row: Callable[[object, list, bytes], tuple]) -> DataFrame:
    fields = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches, rewrite):
            cols = list(zip(*[row(*r) for r in _rows(ids, texts)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(run, schema)


def collapse(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, text: the words joined by one space, without those that a run contains after its first period."""
    return _mapped(docs, rewrite, "doc_id long, text string", lambda doc_id, runs, text: (doc_id, text.decode()))


def audit(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per document: n_runs; of the longest run (ties: smallest start, then period) start, length, period and
    exponent_milli (floor of 1000 * length / period), null without a run; digests of all runs and the collapsed text.
    rewrite changes a text's words first."""

    def row(doc_id, runs: list[tuple[int, int, int]], text: bytes) -> tuple:
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        return doc_id, len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()

    return _mapped(docs, rewrite, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", row)
