"""Chat formatting with offset-aligned loss masks (operator 2).

A conversation is rendered whole, turn by turn; the rendered text is encoded once with offsets, and the
sorted spans of the assistant texts are intersected with the token spans by binary search. The template's markers
are added tokens, at which the tokenizer cuts before anything else, so token borders always fall on
them: conversations of more than ``BLOCK_TURNS`` turn numbers are rendered and encoded in blocks of turns, with the
same tokens as in one piece, and a hot conversation is spread over many tasks. A block of more rows than that (rows
without a turn number, or with one and the same) is cut into parts of as many rows by their place in it. Only what has to
be read in order (the digests of a conversation) streams through one task, one part in memory at a time.

A rendered turn is ``<|turn|>role<|text|>text</turn>`` and a newline. In roles and texts a backslash is written
twice and each control string as a backslash and its letter, so that no control string is left in them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers

#: Control strings and the letters that stand for them after a backslash.
CONTROL = {"<|turn|>": "b", "<|text|>": "c", "</turn>": "e", "<|endoftext|>": "x"}
TURN, TEXT, DONE = "<|turn|>", "<|text|>", "</turn>"
BLOCK_TURNS = 1024
LEARN = "assistant"
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(DONE) + "\n", re.S)
_BACK = {v: k for k, v in CONTROL.items()} | {"\\": "\\"}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + CONTROL.get(m[0], "\\"), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == LEARN:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, DONE, "\n"]
        at += len(head) + len(body) + len(DONE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first token, end) of the tokens that lie within each span: sorted spans against sorted offsets."""
    if not spans or not len(offsets):
        return []
    s = np.array(spans)
    first = np.searchsorted(offsets[:, 0], s[:, 0], "left")
    end = np.searchsorted(offsets[:, 1], s[:, 1], "right")
    return [(int(a), int(b)) for a, b in zip(first, end) if a < b]


def masked_text(formatted: str, offsets: np.ndarray, runs: list[tuple[int, int]]) -> list[str]:
    """The characters under each run of masked tokens."""
    return [formatted[offsets[a, 0]:offsets[b - 1, 1]] for a, b in runs]


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The file's tokenizer with the template's markers as added tokens."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer
        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROL])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


_FORMATTED = ("block long, part long, n_turns long, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, "
              "loss_runs array<struct<first:int,end:int>>")


def _format(path: str, schema: pa.Schema):
    def emit(key, part, turns):
        text, spans = render(turns)
        enc = tokenizer(path).encode(text, add_special_tokens=False)
        offsets = np.array(enc.offsets, np.int32).reshape(-1, 2)
        return {"conv_id": key[0], "block": key[1], "part": part, "n_turns": len(turns), "formatted": text, "input_ids": enc.ids,
                "token_starts": offsets[:, 0], "token_ends": offsets[:, 1],
                "loss_runs": [{"first": a, "end": b} for a, b in mask(offsets, spans)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, turns, rows, waiting = None, 0, [], [], 0
        for batch in batches:
            for c, b, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "block", "role", "text"))):
                if (c, b) != now or len(turns) >= BLOCK_TURNS:
                    if turns:
                        rows.append(emit(now, part, turns))
                        waiting += len(turns)
                    now, part, turns = (c, b), part + 1 if (c, b) == now else 0, []
                    if waiting >= BLOCK_TURNS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, waiting = [], 0
                turns.append((role, text))
        if turns:
            rows.append(emit(now, part, turns))
        yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def format_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, block, part, n_turns, formatted, input_ids, token_starts, token_ends, loss_runs).

    A row is a conversation, or at most ``BLOCK_TURNS`` rows of it whose turn numbers share a block. Turns are ordered by turn, role and
    text, NULL first; NULL roles and texts count as empty; repeated rows are repeated turns; rows with a NULL conv_id
    are one conversation; other columns are ignored; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    workers(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK_TURNS)).cast("long"), F.lit(-(1 << 62)).cast("long")))
    out = spark.createDataFrame([], f"conv_id {kind}, {_FORMATTED}").schema
    return (turns.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
            .mapInArrow(_format(path, to_arrow_schema(out)), out))


def _digest(names: list[str], kind: pa.DataType):
    fields = [("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
              ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        rows, now, state = [], None, None

        def done():
            n, turns, chars, loss, size = state
            rows.append({"conv_id": now[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                         "loss_sha256": loss.hexdigest(), "formatted_chars": size})
        for batch in batches:
            for c, text, starts, ends, runs in zip(*(batch.column(x).to_pylist() for x in names)):
                if now is None or (c,) != now:
                    if now is not None:
                        done()
                    now, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                offsets = np.stack([np.array(starts, np.int64), np.array(ends, np.int64)], axis=1)
                for part in masked_text(text, offsets, [(r["first"], r["end"]) for r in runs]):
                    body = unescape(part)
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        if now is not None:
            done()
        yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted texts, token offsets and loss runs alone."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = formatted.schema["conv_id"].dataType
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
            .select("conv_id", "formatted", "token_starts", "token_ends", "loss_runs")
            .mapInArrow(_digest(["conv_id", "formatted", "token_starts", "token_ends", "loss_runs"], to_arrow_type(kind)),
                        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                        "formatted_chars long"))
