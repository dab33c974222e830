"""Best-fit packing of token sequences (operator 1).

One scan makes each document's ids and cuts those longer than a sequence; only the pieces' places, lengths and
checksums are kept. Packing works on that small table, dealt evenly into groups of about ``GROUP`` pieces
(so their number grows with the input). In each the pieces come in a seeded order, a buffer of ``RUN`` of them at a time, the
longest of a buffer first. Bounded-space best fit keeps at most ``OPEN`` open bins: a bitset with one bit per amount of
free space finds the fullest bin that still takes a piece, and when another bin would be one too many, the fullest closes first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, workers

LENGTH = 2048
END = 0
GROUP, RUN, OPEN = 1 << 14, 256, 128
SEED = 42
#: Texts encoded at once.
AT_ONCE = 64


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library, with no special tokens put around a text.

    The vocabulary is read from the file and run by tiktoken's merge loop, which gives the same ids
    several times faster; the tokenizers library itself does texts that the former can't. With ``added`` that also holds
    for texts with the content of one of the file's added tokens, which has its own id there as by the
    library's defaults; without, such content is text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.added = special if added else set()
        byte = byte_letters()
        ranks = {bytes(byte[c] for c in k): v for k, v in vocabulary.items() if k not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except BaseException as e:  # a pattern engine that gives up on a text panics
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves,
    the others for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full ones after a shorter first."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def _pieces(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                of, piece, start, size, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(enc.ids(text or ""), np.uint32(END)).astype("<u4")
                    for p, (s, n) in enumerate(cuts(len(ids), length)):
                        mine = ids[s:s + n]
                        of.append(i)
                        piece.append(p)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(mine.tobytes()))
                        kept.append(mine.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
    return run


def token_pieces(documents: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids])."""
    workers(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _pieces(path, length, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                                         + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int, open_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in order: bounded-space best fit with a bitset of free spaces."""
    free_bits = 0
    by_free: dict[int, list[int]] = {}
    used: list[int] = []
    count = 0
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        fits = free_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                free_bits &= ~(1 << free)
            count -= 1
        else:
            if count >= open_bins:
                least = (free_bits & -free_bits).bit_length() - 1
                by_free[least].pop()
                if not by_free[least]:
                    free_bits &= ~(1 << least)
                count -= 1
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = capacity - used[b]
        if left:
            by_free.setdefault(left, []).append(b)
            free_bits |= 1 << left
            count += 1
    return bins, offsets


def in_buffers(size: np.ndarray, run: int) -> np.ndarray:
    """The places of the sizes in the order of their arrival: buffers of ``run`` in turn, each longest first."""
    return np.lexsort((np.arange(len(size)), -size, np.arange(len(size)) // run))


def _pack(capacity: int, open_bins: int, buffer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        t = t.take(pa.array(in_buffers(t.column("length").to_numpy(), buffer)))
        size = t.column("length").to_numpy()
        bins, offsets = best_fit(size, capacity, open_bins)
        # sequence numbers: the group's number above, the bin's below
        group = t.column("group").to_numpy().astype(np.int64)
        t = t.drop_columns(["group"]).append_column("sequence_id", pa.array((group << 32) | bins)).append_column("offset", pa.array(offsets))
        yield from t.to_batches(max_chunksize=10_000)
    return run


def pack(pieces: DataFrame, capacity: int = LENGTH, group: int = GROUP, open_bins: int = OPEN, buffer: int = RUN) -> DataFrame:
    """The pieces with (sequence_id, offset): their place in sequences of at most ``capacity`` ids, gapless from 0.

    ``pieces`` should be a written table: it is counted and then dealt out. Each group of about ``group`` pieces is
    packed by one task; what is left over is at most the open bins of each group. The order within a group is that of a seeded hash
    of id, piece and checksum, so it doesn't depend on where the rows lay.
    """
    workers(pieces.sparkSession)
    n = max(1, -(-pieces.count() // group))
    # dealt by place, so that repeated rows and hot keys spread evenly
    dealt = pieces.repartition(n).withColumn("group", F.spark_partition_id())
    in_order = dealt.sortWithinPartitions(F.xxhash64(F.lit(SEED), "doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    return in_order.mapInArrow(_pack(capacity, open_bins, buffer), in_order.drop("group").withColumns(
        {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)


def pack_documents(documents: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset (and their ids, for ``sequences``).

    A NULL text is empty and so has the end id alone; a NULL doc_id is carried along; repeated rows are packed
    once each; other columns are ignored; an empty table gives no rows.
    """
    return pack(stash(token_pieces(documents, path, length, with_ids)), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids): the ids of each packed sequence, its pieces in order."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("input_ids"))
