"""Runs of repeated words, found by online dyadic square catching (operator 13).

A catcher of level k stands on each completed block of ``2**k`` words. While the next ``2**k`` words are
appended, the suffix of ``2**k`` words that ends at each of them is compared with the catcher's block. An equal suffix
``p`` words further on, ``2**k <= p < 2 * 2**k``, may stand in a square of period ``p``; its equal stretch
is then followed to both sides by comparing spans, and where it holds enough periods it is reported. Reports
of consecutive catchers with one period belong to one stretch and merge, and catchers inside a run that a lower
level reported could only report multiples of its period and are silent. Every stretch of at least
three periods ``q`` holds a whole block of the level with ``2**k <= q < 2 * 2**k`` and its copy, so none is missed.

A comparison with a catcher depends on no other one of its level, so numpy makes those of all words of
a piece of documents at once: O(n log n) word operations and O(n) memory, with no squares of long documents. Spans are
compared by hashes of prefix sums; the words of each reported run are compared themselves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, buffers, mix, pieces, powers, word_hashes, words
from .common import workers

#: A run has at least MIN_WORDS words and MIN_PERIODS periods; catchers find all runs of three periods or more.
MIN_WORDS, MIN_PERIODS = 6, 4
_SPACES = re.compile("[\x20\x09-\x0d]+")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Spans:
    """Hashes of spans of an array of codes, from prefix sums of ``code * P**position``."""

    def __init__(self, codes: np.ndarray):
        p, self.inv = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * p[:len(codes)], out=self.sums[1:])

    def windows(self, size: int, end: int) -> np.ndarray:
        """The hash of each window of ``size`` codes that ends by ``end``."""
        return (self.sums[size:end + 1] - self.sums[:end + 1 - size]) * self.inv[:end + 1 - size]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n codes from a are those from b."""
        s, inv = self.sums, self.inv
        return (s[a + n] - s[a]) * inv[a] == (s[b + n] - s[b]) * inv[b]

    def stretch(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many codes from a on are those from b on, at most ``most``; with step -1, those before them."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            back = mid if step < 0 else 0
            same = self.equal(a[open_] - back, b[open_] - back, mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1


def catch(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS,
          min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) rows of all runs in documents laid one after the other, the longest first.

    Document d is ``codes[starts[d]:starts[d] + lengths[d]]`` and is followed by a code that is nowhere else.
    """
    if min_periods < 3:
        raise ValueError("catchers find runs of at least three periods")
    spans = Spans(codes)
    found: list[np.ndarray] = []
    # the furthest end of a known run that starts at or before each word
    reach = np.zeros(len(codes) + 1, np.int64)
    size = 1
    while True:
        many = int(np.searchsorted(-lengths, -min_periods * size, "right"))
        if not many:
            break
        end = int(starts[many - 1] + lengths[many - 1])
        suffix = spans.windows(size, end)
        x = np.flatnonzero(suffix[size:] == np.repeat(suffix[::size], size)[:max(0, len(suffix) - size)]) + size
        at = (x // size - 1) * size
        new = reach[at] < x + size
        x, at = x[new], at[new]
        if len(x):
            found_now = _report(spans, x, at, size, end, starts, lengths, min_words, min_periods)
            if len(found_now):
                found.append(found_now)
                np.maximum.at(reach, found_now[:, 0], found_now[:, 0] + found_now[:, 1])
                reach = np.maximum.accumulate(reach)
        size *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _report(spans: Spans, x: np.ndarray, at: np.ndarray, size: int, end: int, starts: np.ndarray, lengths: np.ndarray,
            min_words: int, min_periods: int) -> np.ndarray:
    """The runs around equal blocks at ``at`` and ``x``."""
    p = x - at
    # consecutive catchers of one period stand in one stretch
    order = np.lexsort((at, p))
    x, at, p = x[order], at[order], p[order]
    first = np.ones(len(x), bool)
    first[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + size)
    x, at, p = x[first], at[first], p[first]
    doc = np.searchsorted(starts, at, "right") - 1
    from_, to = starts[doc], starts[doc] + lengths[doc]
    # both blocks in one document, and room for a run
    fine = (x + size <= to) & (lengths[doc] >= min_periods * p)
    x, at, p, from_, to = x[fine], at[fine], p[fine], from_[fine], to[fine]
    # of at least three periods, one more lies equal on one side or the other of the blocks
    right = x + size + p <= to
    right[right] = spans.equal(at[right] + size, x[right] + size, p[right])
    left = at - p >= from_
    left[left] = spans.equal(at[left] - p[left], at[left], p[left])
    fine = right | left
    x, at, p, from_, to = x[fine], at[fine], p[fine], from_[fine], to[fine]
    start = at - spans.stretch(at, x, at - from_, -1)
    stop = x + size + spans.stretch(at + size, x + size, to - x - size, 1)
    long = stop - start >= np.maximum(min_words, min_periods * p)
    return np.unique(np.column_stack([start, stop - start, p])[long], axis=0)


def runs_of_words(ws: list, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, seed: int = 1) -> list[tuple[int, int, int]]:
    """The runs of one list of words, by start and period, each compared word for word."""
    while True:
        number: dict = {}
        codes = mix(np.array([number.setdefault(w, len(number)) for w in ws] + [len(number)], np.uint64) + np.uint64(seed << 40))
        got = catch(codes, np.array([0]), np.array([len(ws)]), min_words, min_periods)
        out = sorted((int(s), int(n), int(q)) for s, n, q in got)
        if _hold(ws, out):
            return sorted(out, key=lambda r: (r[0], r[2]))
        seed += 1  # two spans had one hash: again with other codes


def _hold(ws: list, runs: list[tuple[int, int, int]]) -> bool:
    return all(ws[s:s + n - q] == ws[s + q:s + n] for s, n, q in runs)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _find(min_words: int, min_periods: int):
    def piece(raw: np.ndarray, off: np.ndarray) -> tuple[list, list, list, list]:
        s, e, doc = words(raw, off, NOT_SPACE)
        n_docs = len(off) - 1
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.diff(first)
        # the longest documents first, each followed by a mark of its own
        order = np.argsort(-n, kind="stable")
        lengths = n[order]
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        codes = mix(np.arange(int(n.sum()) + n_docs, dtype=np.uint64) + np.uint64(1 << 61))
        place = np.repeat(starts, lengths) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        which = np.repeat(first[:-1][order], lengths) + (place - np.repeat(starts, lengths))
        codes[place] = word_hashes(raw, s, e)[which]
        got = catch(codes, starts, lengths, min_words, min_periods)
        mine: dict[int, list[tuple[int, int, int]]] = {}
        for (a, length, q), d in zip(got.tolist(), (np.searchsorted(starts, got[:, 0], "right") - 1).tolist()):
            mine.setdefault(int(order[d]), []).append((a - int(starts[d]), length, q))
        # words parted by one space: the word bytes, and the byte after each word made a space
        line = raw.copy()
        keep = NOT_SPACE[raw] if len(raw) else np.zeros(0, bool)
        ends = off[1:][doc] if len(doc) else np.zeros(0, np.int64)
        part = e[e < ends]
        line[part] = 32
        keep[part] = True
        text, upto = line[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])
        whole = raw.tobytes() if mine else b""
        runs, bests, collapsed = [], [], []
        for d in range(n_docs):
            if d not in mine:
                runs.append([])
                bests.append(None)
                collapsed.append(text[upto[off[d]]:upto[off[d + 1]]].rstrip(b" "))
                continue
            ws = [whole[a:b] for a, b in zip(s[first[d]:first[d + 1]].tolist(), e[first[d]:first[d + 1]].tolist())]
            rs = sorted(mine[d], key=lambda r: (r[0], r[2]))
            if not _hold(ws, rs):
                rs = runs_of_words(ws, min_words, min_periods, 2)
            gone = np.zeros(len(ws) + 1, np.int64)
            for a, length, q in rs:
                gone[a + q] += 1
                gone[a + length] -= 1
            left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            runs.append([dict(start=a, length=length, period=q) for a, length, q in rs])
            top = best_run(rs)
            bests.append(None if top is None else dict(start=top[0], length=top[1], period=top[2]))
            collapsed.append(b" ".join([ws[i] for i in left.tolist()]))
        return n.tolist(), runs, bests, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for a, b, r, o in pieces(raw, off):
                n, runs, bests, collapsed = piece(r, o)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(bests, _RUN),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "best", "collapsed"])
    return run


def word_runs(documents: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row of ``documents``, in one scan without a shuffle.

    A run is a stretch of consecutive words with smallest period ``period`` and at least ``min_words`` words and ``min_periods``
    periods that no neighbouring word extends. ``best`` has the greatest length by period (ties: smallest start, then
    period) and is NULL without a run. ``collapsed`` holds the words, one space apart, without those that a run repeats after
    its first period. A NULL or empty text, or one of white space, has no words, no runs and an empty ``collapsed``;
    repeated rows and NULL ids give a row each; an empty table gives no rows; other columns are ignored.
    A text is worked on as a whole by one task, in memory that grows with its length.
    """
    workers(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    run = "struct<start:long,length:long,period:long>"
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _find(min_words, min_periods), f"doc_id {kind}, n_words long, runs array<{run}>, best {run}, collapsed string")


def plant_loops(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of ``documents``, of which those whose id's crc32 ends in 0 run in a loop from some word on.

    With g the crc32 without its last digit and n words, each word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) // (3 + g % 8). A NULL id counts as empty; texts that are NULL or have no words stay.
    """
    workers(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_plant, f"doc_id {kind}, text string")


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, out = batch.column(0).to_pylist(), batch.column(1), []
        for i, d in enumerate(ids):
            g, last = divmod(zlib.crc32(str("" if d is None else d).encode()), 10)
            ws = [w for w in _SPACES.split(texts[i].as_py() or "") if w] if last == 0 else []
            if ws:
                a = g % len(ws)
                p = 1 + (len(ws) - a) // (3 + g % 8)
                out.append(" ".join(ws[:a] + [ws[a + j % p] for j in range(len(ws) - a)]))
            else:
                out.append(texts[i].as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])
