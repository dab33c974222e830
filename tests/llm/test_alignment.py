"""Operator 12: groups, links and counts against whole-text encodings and brute-force counts."""

import functools
import hashlib
import random
from collections import Counter

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from __spark_entry__ import queries
from tabforge.llm.alignment import Aligner, align_tokenizers, token_groups
from tabforge.llm.packing import byte_letters

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True
PIECES = SentencePieceProcessor(model_file=B)
LETTERS = byte_letters()


@functools.cache
def brute(text):
    """(A ids, B ids, groups, links) of one text, its tokens' bytes laid one after the other."""
    if not text:
        return [], [], "", []
    e = LIBRARY.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], [], "", []
    def ends(ts):
        n, out = 0, []
        for i, x in ts:
            n += len(x)
            out.append((i, n))
        return out
    ea, eb = ends(a), ends(b)
    both = sorted({n for _, n in ea} & {n for _, n in eb})
    def part(ts):
        at = 0
        for n in both:
            low = at
            while at < len(ts) and ts[at][1] <= n:
                at += 1
            yield ts[low:at]
    groups, links = [], []
    for n, x, y in zip(both, part(ea), part(eb)):
        groups.append(",".join(str(i) for i, _ in x) + "|" + ",".join(str(i) for i, _ in y))
        links += [(i, j) for i, m in x if m == n for j, k in y if k == n]
    return [i for i, _ in ea], [i for i, _ in eb], ";".join(groups), links


def odd_texts():
    rnd = random.Random(2)
    out = ["", " ", "  ", "\n", "a", " a", "a ", "\na", "a\n", "a\nb", "a\n\nb c", "a \nb", "a\n b", "a\tb \t c", "x  y   z", "▁u", "<unk> <s>", "<0x41>", "it's <|endoftext|> ok",
           "日本語 🙂🙂 ½ ﬁ É", "\x00z \x1c q", "​ zero", "a\u00a0b \u2003c", "e\u0301 a\u0300", "'s 't don't", "12 345,67 8", "\r\nx\r\n", "🙂" * 500, "x" * 20_000, "deﬁ\u2028n \x85 o"]
    for alphabet in ("ab \n", "aé🙂 \n\t", "a1,.'! \n\r", "日本 \u3000\u00a0\x1fx"):
        out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(60)]
    return out


def test_units_give_the_tokens_of_whole_texts(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    al = Aligner(A, B)
    texts = [t or "" for t in rows if t is None or len(t) < 60_000] + odd_texts()
    used = 0
    for at in range(0, len(texts), 50):
        part = texts[at:at + 50]
        used += sum(bool(al.units(t)) for t in part)
        for t, (n_a, n_b, said, pairs) in zip(part, al.align(part)):
            a, b, groups, links = brute(t)
            assert (n_a, n_b, said) == (len(a), len(b), groups), t[:200]
            assert [(int(p) >> 31, int(p) & (1 << 31) - 1) for p in pairs] == links
    assert used > 0.6 * len(texts) and sum(al.fine) > 0.99 * len(al.fine)
    al.chars = 1 << 30
    assert al.align(texts[:5])[0][2] == brute(texts[0])[2] and al.chars < 1 << 20


def check(got, rows):
    want = {i: brute(t) for i, t in rows}
    counts = Counter(x for _, t in rows for x in brute(t)[3])
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(n, top.get(j, 0))
    assert len(got) == len(rows)
    for r in got:
        a, b, groups, links = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), groups.count(";") + 1 if groups else 0, len(links))
        assert r.n_best == sum(counts[x] == top[x[1]] for x in links) and r.count_sum == sum(counts[x] for x in links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_operator_on_odd_tables(spark):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(None, "the hot row"), (None, "the hot row"), (3, texts[3])] + [(5000 + i, "the same text") for i in range(100)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(9999, None, "x", 1)], "doc_id long, text string, pair string, row int").repartition(3)
    for head in (1 << 20, 40, 0):
        check(align_tokenizers(df, A, B, head).collect(), rows + [(9999, None)])
    assert align_tokenizers(df.limit(0), A, B).collect() == []
    some = token_groups(df.where("doc_id = 9"), A, B).first()
    assert some.groups == brute(texts[9])[2]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(queries()["op12_align_tokenizers"](spark, SF).collect(), rows)
