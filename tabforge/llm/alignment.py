"""Alignment of two tokenizers' tokens over the same text (operator 12).

Coarse cuts are the character offsets of ``tokenizers`` (A) and the byte spans of ``sentencepiece`` protos (B). An offset
can't part a character, shows a token of part of one as the whole and leaves out white space; a span shows all but the last byte of a
byte-fallback character as empty. Such tokens are refined: their end is the last coarse cut before them and the bytes that the vocabulary
entries decode to since then. Byte offsets where both have a cut divide the tokens into groups.

Texts are encoded by unit: a word with the space or line break before it. Neither vocabulary joins anything over such a break (read
from the vocabularies, and the cuts of every unit are checked), so a unit's tokens are those it has in any text, and each
distinct unit is encoded once a batch or more seldom. Texts for which that doesn't hold, or whose bytes don't come back, are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, stash, workers
from .packing import byte_letters

SPACE = "▁"
#: Documents worked on at once; the characters of units kept, then forgotten; units encoded at once.
AT_ONCE, KEPT_CHARS, UNITS = 256, 6 << 20, 4096
#: The most id pairs whose counts are sent to all tasks; rarer ones are joined by a shuffle.
HEAD_PAIRS = 1 << 20
#: A pair of ids as one number.
B_BITS = 31
#: White space where a plain split at spaces and line breaks would part more than words.
_ODD = re.compile(r"\s\s|^\s|\s\Z")
_BREAK = re.compile(r"(?<=\S)(?=[ \n]\S)")


class ByteLevel:
    """Token ids and byte ends by a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        # tokens of whole characters that end in none of the white space left out of offsets
        self.solid = np.array([_solid(b) for b in self.bytes])

    def cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(ids, byte end of each, their bytes) of a text."""
        e = self.model.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        if not len(ids):
            return ids, ids, b""
        stop = np.array(e.offsets, np.int64)[:, 1]
        raw = np.frombuffer(text.encode(), np.uint8)
        # the byte where each character starts, and the end
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        return ids, refine(at[np.minimum(stop, len(at) - 1)], self.solid[ids], self.size[ids]), b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Pieces:
    """Token ids and byte ends by a sentencepiece model; ends count the space that the model puts before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.byte = np.array([self.model.is_byte(i) for i in range(len(pieces))])
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(pieces, self.byte.tolist())]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        # whether no piece goes on over a space or line break after something else
        self.parts = not any(re.search(f"[^{SPACE}][{SPACE}]|.\n|\n.", p, re.DOTALL) for p in pieces)

    def cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(ids, byte end of each in space + text, their bytes) of a text."""
        got = self.model.encode(text, return_type="proto").pieces
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), b""
        ids, stop = np.array([(p.id, p.end + 1) for p in got], np.int64).T
        return ids, refine(stop, ~self.byte[ids], self.size[ids]), b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _solid(b: bytes) -> bool:
    try:
        return not b.decode()[-1:].isspace()
    except UnicodeDecodeError:
        return False


def refine(coarse: np.ndarray, sure: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends: the coarse cut of sure tokens; of others the last sure cut and the bytes since."""
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(size)), -1))
    there = last >= 0
    at = np.maximum(last, 0)
    return np.where(there, coarse[at] + total - total[at], total)


def groups(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(byte where both have a cut, tokens of A and of B up to it, the group before it as text, the linked pair)."""
    both = np.intersect1d(a_end, b_end)
    up_a, up_b = np.searchsorted(a_end, both, "right"), np.searchsorted(b_end, both, "right")
    xs, ys = list(map(str, a.tolist())), list(map(str, b.tolist()))
    said, p, q = [], 0, 0
    for s, t in zip(up_a.tolist(), up_b.tolist()):
        said.append((xs[p] if s == p + 1 else ",".join(xs[p:s])) + "|" + (ys[q] if t == q + 1 else ",".join(ys[q:t])))
        p, q = s, t
    # a token has at least a byte, so one of each vocabulary ends at a cut
    return both, up_a, up_b, said, (a[up_a - 1] << B_BITS) | b[up_b - 1]


class Aligner:
    """Aligns texts; remembers the units it has met until they are too many."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.said: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.fine: list[bool] = []
        self.chars = 0

    def units(self, text: str) -> list[str]:
        """The words of space + text: led by a line break, or else by a space that is left out; none if it must be encoded whole."""
        if not text or not self.b.parts or text[0].isspace() or text[-1].isspace():
            return []
        if _ODD.search(text) is None:
            return text.replace("\n", " \n").split(" ")
        return [u[1:] if u[0] == " " else u for u in _BREAK.split(" " + text)]

    def learn(self, new: list[str]) -> None:
        """Encode units that are not known yet, many in one text where nothing joins them."""
        for lead, some in ((" ", [u for u in new if u[0] != "\n"]), ("", [u for u in new if u[0] == "\n"])):
            for at in range(0, len(some), UNITS):
                part = some[at:at + UNITS]
                self._many(lead + lead.join(part), part, lead)

    def _many(self, text: str, part: list[str], lead: str) -> None:
        raw = text.encode()
        a, a_end, a_raw = self.a.cuts(text)
        b, b_end, b_raw = self.b.cuts(text[1:] if lead else text)
        if not lead:  # the space that the model puts before the first is none of the units'
            b, b_end, b_raw = b[1:], b_end[1:] - 1, b_raw[1:]
        stop = np.cumsum([len((lead + u).encode()) for u in part])
        if a_raw != raw or b_raw != raw or not np.isin(stop, a_end).all() or not np.isin(stop, b_end).all():
            for u in part:
                if len(part) > 1:
                    self._many(lead + u, [u], lead)
                else:
                    self._add(u, 0, 0, "", np.zeros(0, np.int64), False)
            return
        both, up_a, up_b, said, pairs = groups(a, a_end, b, b_end)
        last = np.searchsorted(both, stop)
        n_a, n_b = np.diff(up_a[last], prepend=0).tolist(), np.diff(up_b[last], prepend=0).tolist()
        low = 0
        for i, (u, high) in enumerate(zip(part, (last + 1).tolist())):
            self._add(u, n_a[i], n_b[i], ";".join(said[low:high]), pairs[low:high], True)
            low = high

    def whole(self, text: str) -> tuple[int, int, str, np.ndarray]:
        """(tokens of A, of B, groups as text, linked pairs) of a text encoded by itself; nothing where its bytes don't come back."""
        raw = (" " + text).encode()
        a, a_end, a_raw = self.a.cuts(" " + text)
        b, b_end, b_raw = self.b.cuts(text)
        if not text or a_raw != raw or b_raw != raw:
            return 0, 0, "", np.zeros(0, np.int64)
        _, _, _, said, pairs = groups(a, a_end, b, b_end)
        return len(a), len(b), ";".join(said), pairs

    def _add(self, unit: str, n_a: int, n_b: int, said: str, pairs: np.ndarray, fine: bool) -> None:
        self.number[unit] = len(self.said)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.said.append(said)
        self.pairs.append(pairs)
        self.fine.append(fine)
        self.chars += len(unit) + 8

    def align(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """(tokens of A, of B, groups as text, linked pairs) of each text; zeros and nothing where bytes don't come back."""
        if self.chars > KEPT_CHARS:
            self.forget()
        parted = [self.units(t) for t in texts]
        known = self.number
        new = list(dict.fromkeys(u for us in parted for u in us if u not in known))
        if new:
            self.learn(new)
        out = []
        for text, us in zip(texts, parted):
            at = [known[u] for u in us]
            if at and all(map(self.fine.__getitem__, at)):
                out.append((sum(map(self.n_a.__getitem__, at)), sum(map(self.n_b.__getitem__, at)),
                            ";".join(map(self.said.__getitem__, at)), np.concatenate([self.pairs[i] for i in at])))
            else:
                out.append(self.whole(text))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this process, made once."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _align(a_path: str, b_path: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                got = al.align([t or "" for t in part.column(1).to_pylist()])
                counted = [np.unique(g[3], return_counts=True) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([int(g[0]) for g in got], pa.int64()), pa.array([int(g[1]) for g in got], pa.int64()),
                     pa.array([g[2].count(";") + 1 if g[2] else 0 for g in got], pa.int64()), pa.array([len(g[3]) for g in got], pa.int64()),
                     pa.array([hashlib.sha256(g[2].encode()).hexdigest() if g[2] else "" for g in got]),
                     pa.array([c[0] for c in counted], pa.list_(pa.int64())), pa.array([c[1] for c in counted], pa.list_(pa.int64())),
                     *([pa.array([g[2] for g in got])] if with_groups else [])],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])])
    return run


def token_groups(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, groups): the aligned groups of every text as
    ``a1,a2|b1;a3|b2``, and its distinct linked pairs ``a << 31 | b`` with how often each is linked."""
    workers(documents.sparkSession)
    return _groups(documents, a_path, b_path, True)


def _groups(documents: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _align(a_path, b_path, with_groups), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, "
                                             "times array<long>" + (", groups string" if with_groups else ""))


def pair_counts(groups: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all texts hold each pair of ids linked, and whether it is the highest of its B id."""
    counts = (groups.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
              .agg(F.sum("x.times").alias("count")))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def align_tokenizers(documents: DataFrame, a_path: str, b_path: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``documents``.

    ``n_best`` counts the links whose pair is linked most often of all pairs of its B id (ties included), ``count_sum`` adds up the
    counts of all links. The text of A is a space and the text, as B puts one before it. Texts that are NULL or empty, or whose
    tokens' bytes don't give back the text, have no tokens: zeros and an empty ``groups_sha256``. Repeated rows and NULL ids give a row each and
    count each; an empty table gives no rows; other columns are ignored.

    The most frequent pairs, at most ``head_pairs``, go to all tasks; links of the others, few by then, meet their counts in a shuffle.
    """
    workers(documents.sparkSession)
    # rows numbered in the written table, so that the numbers stay
    groups = stash(_groups(documents, a_path, b_path, False).withColumn("row", F.monotonically_increasing_id()))
    counts = Stash(pair_counts(groups))
    least = _head_from(counts.df, head_pairs)
    links = groups.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    head = counts.df.where(F.col("count") >= least)
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum")]
    some = links.join(F.broadcast(head), "pair")
    if least > 1:
        rare = Stash(links.join(F.broadcast(head.select("pair")), "pair", "left_anti"))
        some = some.unionByName(rare.df.join(counts.df.where(F.col("count") < least), "pair"))
    per_row = some.groupBy("row").agg(*sums)
    return groups.join(per_row, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def _head_from(counts: DataFrame, head_pairs: int) -> int:
    """The least count such that at most ``head_pairs`` pairs have it or a higher one, on a grid of eighths of doublings."""
    step = F.floor(F.log2("count") * 8)
    rows = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("count").alias("c")).collect(), reverse=True)
    least, total = 1 << 62, 0
    for r in rows:
        total += r["n"]
        if total > head_pairs:
            return least
        least = int(r["c"])
    return 1
