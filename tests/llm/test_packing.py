"""Operator 1: exact round trip of ids, gapless sequences, and closeness to the least number of sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabforge.llm.packing import OPEN, RUN, Encoder, best_fit, cuts, in_buffers, pack_documents, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(plain):
    enc = Encoder(PATH)
    for x in ["", " ", "\n\n a", "it's <|endoftext|> é\U0001F600", "a" * 50_000, "x　y \t z", " ".join("w%d" % i for i in range(3000))]:
        assert list(enc.ids(x)) == plain(x)


def test_added_tokens_have_their_own_ids(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["it's <|endoftext|> ok", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", "word " * 3000 + "<|endoftext|>", "é"]
    want = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert want[0] == [270, 338, 220, 50256, 12876, 0]
    got = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, with_ids=True).collect()
    back = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        back.setdefault(r.doc_id, []).extend(r.ids)
    assert back == want


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)] and cuts(4, 4) == [(0, 4)] and cuts(8, 4) == [(0, 4), (4, 4)]


def test_best_fit_bounds():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 5000)
    for bins in (1, 7, 400):
        b, off = best_fit(sizes, 100, bins)
        for k in range(b.max() + 1):
            at = np.flatnonzero(b == k)
            assert off[at].tolist() == np.concatenate([[0], np.cumsum(sizes[at])[:-1]]).tolist()
            assert sizes[at].sum() <= 100
    down = np.sort(sizes)[::-1]
    assert best_fit(down, 100, 5000)[0].max() + 1 <= 1.02 * -(-sizes.sum() // 100)


def test_best_fit_picks_the_fullest_and_closes_the_fullest():
    b, _ = best_fit(np.array([60, 70, 30, 40, 90, 95, 5]), 100, 2)
    # 30 goes to the bin of 70, 40 to that of 60; 90 and 95 open bins, 5 fits the fullest open one
    assert b.tolist() == [0, 1, 1, 0, 2, 3, 3]


def test_open_bins_are_bounded_and_close():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 2049, 6000)
    order = in_buffers(size, RUN)
    assert sorted(order.tolist()) == list(range(6000)) and (np.diff(order // RUN) >= 0).all()
    size = size[order]
    assert all((np.diff(size[i:i + RUN]) <= 0).all() for i in range(0, 6000, RUN))
    bins, _ = best_fit(size, 2048, OPEN)
    # a bin is open from its first piece until it is full or closed: replay with a list instead of a bitset
    opened, free, closed = [], {}, 0
    for n, b in zip(size.tolist(), bins.tolist()):
        fits = [free[x] for x in opened if free[x] >= n]
        if fits:
            assert b in opened and free[b] == min(fits)
        else:
            if len(opened) == OPEN:
                least = min(free[x] for x in opened)
                # the one that closes takes nothing any more; equal ones are alike
                opened.remove([x for x in opened if free[x] == least][-1])
                closed += 1
            opened.append(b)
            free[b] = 2048
        free[b] -= n
        if not free[b]:
            opened.remove(b)
        else:
            # the last of equal space is taken first
            opened.remove(b)
            opened.append(b)
        assert len(opened) <= OPEN
    assert closed > 0
    assert bins.max() + 1 <= 1.05 * -(-size.sum() // 2048)


def test_round_trip(spark, plain):
    rnd = random.Random(2)
    rows = [(i % 37, " ".join(rnd.choices(["alpha", "béta", "7", "\n", "zz"], k=rnd.choice([0, 3, 50, 900]))), 5, "x") for i in range(120)]
    rows += [(1000, None, 1, "y"), (None, "no id", 1, None), (2000, "long " * 6000, 0, "z"), (0, rows[0][1], 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")
    got = pack_documents(df.repartition(4), PATH, with_ids=True).cache()
    by = {}
    for r in got.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    texts = sorted(tuple(plain(t or "") + [0]) for _, t, *_ in rows)
    back = {}
    for r in got.where("doc_id = 2000 or length < 2048").collect():
        back.setdefault(r.doc_id, []).append((r.start, tuple(r.ids)))
    assert tuple(x for _, p in sorted(back[2000]) for x in p) == tuple(plain("long " * 6000) + [0])
    assert got.count() == sum(len(cuts(len(t), 2048)) for t in texts)
    assert sequences(got).select(F.sum(F.size("input_ids"))).first()[0] == sum(map(len, texts))
    assert pack_documents(df.limit(0), PATH).collect() == []
