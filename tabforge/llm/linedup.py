"""Line dedup by content-defined line chunks (operator 4).

A document's lines are hashed (128 bits). Chunks are runs of whole lines of at least ``MIN_WORDS`` words whose
borders follow from the lines alone, so that text before or after doesn't shift them: a rolling hash over the hashes of
``WINDOW`` lines cuts where it is 0 modulo ``DIVISOR``; and since the first and the last cut of a passage
leave its edges in a chunk with their surroundings, the shortest run that begins and the one that ends at each line
are chunks too. A chunk whose key occurs again goes, everywhere but in the document of the smallest id (there, in its
first place), once its lines have been compared byte for byte: the lines of repeated chunks are grouped by hash and text,
and a hash that stands for two texts counts for nothing.

Keys, not texts, are shuffled to find repeats, and hot keys are counted before the shuffle. Whole texts move
once, to the spans found in them; of these, the lines of repeated chunks move again for the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, stash, workers

MIN_WORDS = 50
WINDOW, DIVISOR = 2, 4
_MASK = (1 << 63) - 1


def hash_lines(text: str) -> tuple[list[str], list[bytes], list[int]]:
    """Lines, their 128-bit hashes and their numbers of words."""
    lines = text.split("\n")
    return lines, [blake2b(x.encode(), digest_size=16).digest() for x in lines], [len(x.split()) for x in lines]


def chunks(hashes: list[bytes], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(first line, end) of the chunks of a document, without repeats."""
    n = len(hashes)
    out = set()
    # content-defined cuts
    begin = 0
    for i in range(n):
        rolled = 0
        for h in hashes[max(0, i - WINDOW + 1):i + 1]:
            rolled = (rolled * 0x9E3779B97F4A7C15 + int.from_bytes(h[:8], "little")) & 0xFFFFFFFFFFFFFFFF
        if i + 1 == n or (rolled >> 32) % DIVISOR == 0:
            if sum(words[begin:i + 1]) >= least:
                out.add((begin, i + 1))
            begin = i + 1
    # the shortest runs from and to each line
    sums = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(sums, sums[:-1] + least, "left")
    starts = np.searchsorted(sums, sums[1:] - least, "right") - 1
    for i in range(n):
        if words[i] and ends[i] <= n:
            out.add((i, int(ends[i])))
        if words[i] and starts[i] >= 0:
            out.add((int(starts[i]), i + 1))
    return sorted(out)


def _two(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, first, end, k1, k2, lines = [], [], [], [], [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            _, hashes, words = hash_lines(text)
            for i, j in chunks(hashes, words):
                a, b = _two(blake2b(b"".join(hashes[i:j]), digest_size=16).digest())
                row.append(r)
                first.append(i)
                end.append(j)
                k1.append(a)
                k2.append(b)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("th").take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()),
             pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], names=["id", "th", "first", "end", "k1", "k2"])


def _found(spans) -> list[tuple[int, int, bool, int, int]]:
    return [(s["first"], s["end"], s["here"], s["k1"], s["k2"]) for s in spans or ()]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the repeated chunks, with their hashes."""
    for batch in batches:
        h1, h2, texts = [], [], []
        for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()):
            if not spans:
                continue
            lines, hashes, _ = hash_lines(text)
            for i in sorted({i for s in _found(spans) for i in range(s[0], s[1])}):
                a, b = _two(hashes[i])
                h1.append(a)
                h2.append(b)
                texts.append(lines[i])
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(texts, pa.string())],
                                         names=["h1", "h2", "line"])


def dropped_lines(spans: list[tuple[int, int, bool, int, int]]) -> set[int]:
    """Lines to remove, from (first, end, kept here, k1, k2) of the repeated chunks of one document."""
    gone: set[int] = set()
    held: set[int] = set()
    seen, again = set(), []
    for i, j, here, *key in sorted(spans):
        if not here:
            gone.update(range(i, j))
        elif tuple(key) in seen:
            again.append((i, j))
        else:
            seen.add(tuple(key))
            held.update(range(i, j))
    for i, j in again:
        gone.update(x for x in range(i, j) if x not in held)
    return gone


def _rewrite(names: list[str]):
    def run(batches):
        for batch in batches:
            texts, n, lost = [], [], []
            wrong = {(x["h1"], x["h2"]) for x in (batch.column("__wrong")[0].as_py() if batch.num_rows else None) or ()}
            for text, spans in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()):
                lines = (text or "").split("\n")
                found = _found(spans)
                if wrong and found:
                    bad = [_two(h) in wrong for h in hash_lines(text)[1]]
                    found = [s for s in found if not any(bad[s[0]:s[1]])]
                gone = dropped_lines(found)
                n.append(len(lines))
                lost.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(lost, pa.int64())],
                                             names=[*names, "__lines", "__removed"])
    return run


def two_texts(joined: DataFrame) -> DataFrame:
    """One row: the hashes of lines of repeated chunks that stand for more than one text.

    This is the byte comparison. A collision of 128-bit BLAKE2 is not known to exist, so the list is empty.
    """
    return (joined.mapInArrow(_lines, "h1 long, h2 long, line string").groupBy("h1", "h2", "line").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").count().where("count > 1").agg(F.collect_list(F.struct("h1", "h2"))))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The rows, their columns as they were but ``text`` without repeated chunks, with __lines and __removed.

    The document with the smallest doc_id keeps a chunk, of several with that id the one with the smallest hash of its text;
    rows that share id and text are one document, and NULL ids come last. NULL texts stay NULL and count one empty line; texts of fewer words than a chunk
    are unchanged; an empty table gives no rows. A column of ``documents`` named __lines or __removed gives way to the operator's; all others stay.
    """
    workers(documents.sparkSession)
    documents, back = aside(documents.drop("__lines", "__removed"), ["__id", "__th", "__text", "__spans", "__wrong", "id", "th"])
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    docs = documents.where("text is not null").select(ident.alias("id"), F.xxhash64("text").alias("th"), "text")
    keys = stash(docs.mapInArrow(_keys, "id long, th long, first int, end int, k1 long, k2 long"))
    # written, so that the join with the places of a hot chunk can be split
    again = stash(keys.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min(F.struct("id", "th")).alias("keeper"))
                  .where("c >= 2").drop("c"))
    spans = (keys.join(again, ["k1", "k2"])
             .groupBy("id", "th").agg(F.collect_set(F.struct(
                 "first", "end", (F.struct("id", "th") == F.col("keeper")).alias("here"), "k1", "k2")).alias("__spans")))
    names = documents.columns
    left = documents.withColumns({"__id": ident, "__th": F.xxhash64("text"), "__text": F.col("text")})
    both = left.join(spans, (F.col("__id") == spans["id"]) & (F.col("__th") == spans["th"]), "left").select(
        *[left[c] for c in names if c != "text"], "__text", "__spans")
    out = T.StructType([*documents.schema.fields, T.StructField("__lines", T.LongType()), T.StructField("__removed", T.LongType())])
    # the comparison and the rewriting read the same shuffle of the texts
    return back(both.withColumn("__wrong", two_texts(both).scalar()).mapInArrow(_rewrite(names), out))
