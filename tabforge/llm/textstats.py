"""Statistics of whole texts for the quality classifier, computed on the UTF-8 buffer."""

from __future__ import annotations

import numpy as np

from .bytewords import ALNUM, LOWER, NOT_SPACE, pieces, word_hashes, words

_MARKS = b"!*$%&#|<>{}@=\\~^_/"
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?'\"()-")] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False

NAMES = ["log_bytes", "log_words", "log_lines", "word_len", "word_len_sd", "upper", "digit", "high", "marks", "stops",
         "mark_words", "bare_words", "caps_words", "distinct_words", "distinct_pairs", "repeated_lines",
         "top_word", "words_per_line", "long_words", "marked_lines", "caps_lines", "worst_line"]


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, count of the most frequent one) by document; doc is ascending."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    d = (key >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    if len(starts):
        np.maximum.at(most, d[starts], np.diff(np.append(starts, len(d))))
    return np.bincount(d[starts], minlength=n).astype(float), most


def _some(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.diff(off).astype(float)
    one = np.maximum(size, 1)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return sums, (sums[off[1:]] - sums[off[:-1]]) / one
    s, e, doc = words(raw, off, NOT_SPACE)
    h = word_hashes(LOWER[raw], s, e)
    nw = np.bincount(doc, minlength=n).astype(float)
    per = np.maximum(nw, 1)
    length = (e - s).astype(float)

    def mean(x):
        return np.bincount(doc, weights=x, minlength=n) / per
    up, upper = share(_UPPER)
    mk, marks = share(_MARK)
    an, _ = share(ALNUM)
    w_len = mean(length)
    caps = ((up[e] - up[s]) >= 0.6 * np.maximum(an[e] - an[s], 1)) & (length > 1) & (up[e] - up[s] > 1)
    marked = (mk[e] - mk[s]) > 0
    distinct, top = _repeats(doc, h, n)
    pair_doc = doc[1:][doc[1:] == doc[:-1]]
    pair = (h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[doc[1:] == doc[:-1]]
    pairs, _ = _repeats(pair_doc, pair, n)
    ls, le, ldoc = words(raw, off, _NOT_NEWLINE)
    lines = np.bincount(ldoc, minlength=n).astype(float)
    unique_lines, _ = _repeats(ldoc, word_hashes(raw, ls, le), n)
    first = np.searchsorted(s, ls)
    last = np.searchsorted(s, le)
    cm = np.concatenate([[0], np.cumsum(marked)])
    cc = np.concatenate([[0], np.cumsum(caps)])
    in_line = np.maximum(last - first, 1)
    line_marks = (cm[last] - cm[first]) / in_line
    line_caps = (cc[last] - cc[first]) / in_line
    per_line = np.maximum(lines, 1)
    worst = np.zeros(n)
    np.maximum.at(worst, ldoc, np.maximum(line_marks, line_caps) * np.minimum(in_line / 8, 1))
    root = np.sqrt
    return np.stack([
        np.log1p(size), np.log1p(nw), np.log1p(lines), w_len,
        root(np.maximum(mean(length ** 2) - w_len ** 2, 0)), root(upper), root(share(_DIGIT)[1]),
        root(share(_HIGH)[1]), root(marks), root(share(_STOP)[1]), root(mean(marked)),
        root(mean((an[e] - an[s]) == 0)), root(mean(caps)), distinct / per, pairs / np.maximum(nw - 1, 1),
        root(1 - unique_lines / per_line), top / per, np.log1p(nw / per_line), mean(length > 20),
        np.bincount(ldoc, weights=line_marks > 0.5, minlength=n) / per_line,
        np.bincount(ldoc, weights=line_caps > 0.5, minlength=n) / per_line, worst], axis=1)


def doc_stats(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, len(NAMES)) statistics; empty texts get the zeros of their counts."""
    parts = [_some(r, o) for _, _, r, o in pieces(raw, off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
