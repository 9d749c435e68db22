"""Hashed words and structure statistics of many texts at once; used by the classifiers."""

from __future__ import annotations

import numpy as np

from strandline.llm.common import mix64, word_hashes

_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KIND = np.zeros((256, 6), dtype=np.float32)  # upper, lower, digit, mark, space, beyond ASCII
_KIND[65:91, 0] = _KIND[97:123, 1] = _KIND[48:58, 2] = _KIND[128:, 5] = 1
_KIND[[9, 10, 11, 12, 13, 32], 4] = 1
_KIND[:128, 3] = 1 - _KIND[:128, [0, 1, 2, 4]].sum(1)

#: Names of the columns of `structure`.
STATISTICS = (
    "log_chars", "log_words", "log_lines", "upper", "lower", "digits", "marks", "spaces", "beyond_ascii", "mean_word", "spread_word", "distinct_words",
    "top_word", "repeated_lines", "pairs_repeated", "marked_words", "upper_words", "long_words",
)


def hashed_words(texts: list[str], bits: int, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' words and of their first `heads` bytes, with the text of each; words are letters and digits, lower case."""
    words, owner, starts, ends, raw = word_hashes(texts, stop=_NOT_WORD)
    found, whose = [words], [owner]
    if heads and len(words):
        data = np.frombuffer(raw, dtype=np.uint8)
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
        for n in heads:
            long = ends - starts >= n
            at = starts[long]
            head = np.zeros(len(at), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    head = head * np.uint64(0x100000001B3) + low[at + j]
            found.append(mix64(head, 100 + n))
            whose.append(owner[long])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(whose)


def counted_words(texts: list[str], bits: int, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text: (text, bucket, count), ordered."""
    bucket, owner = hashed_words(texts, bits, heads)
    both, count = np.unique((owner << bits) | bucket, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), count


def structure(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS a text; an empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)), dtype=np.float32)
    words, owner, starts, ends, joined = word_hashes(texts)
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), dtype=np.int64, count=n)
    raw = np.frombuffer(joined, dtype=np.uint8)
    firsts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if n else np.zeros(0, dtype=np.int64)
    total = np.maximum(lengths, 1)
    for j in range(6):
        sums = np.concatenate([[0], np.cumsum(_KIND[raw, j], dtype=np.float64)])
        out[:, 3 + j] = (sums[firsts + lengths] - sums[firsts]) / total
    count = np.bincount(owner, minlength=n).astype(np.float64)
    some = np.maximum(count, 1)
    size = (ends - starts).astype(np.float64)
    mean = np.bincount(owner, size, minlength=n) / some
    out[:, 0], out[:, 1] = np.log1p(lengths), np.log1p(count)
    out[:, 9] = mean
    out[:, 10] = np.sqrt(np.maximum(np.bincount(owner, size**2, minlength=n) / some - mean**2, 0))
    out[:, 17] = np.bincount(owner, size > 20, minlength=n) / some
    if len(words):
        last, first = raw[ends - 1], raw[starts]
        out[:, 15] = np.bincount(owner, (_KIND[last, 3] > 0) & (last != 46) & (last != 44), minlength=n) / some
        out[:, 16] = np.bincount(owner, (_KIND[first, 0] > 0) & (size > 1) & (_KIND[raw[np.minimum(starts + 1, ends - 1)], 0] > 0), minlength=n) / some
        for column, ids, whose in ((11, words, owner), (14, _pairs(words), owner[:-1])):
            if not len(ids):
                continue
            order = np.lexsort((ids, whose))
            a, b = whose[order], ids[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            out[:, column] = np.bincount(a[new], minlength=n) / np.maximum(np.bincount(a, minlength=n), 1)
            if column == 11:
                runs = np.diff(np.append(np.flatnonzero(new), len(a)))
                np.maximum.at(out[:, 12], a[new], (runs / some[a[new]]).astype(np.float32))
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip()]
        out[i, 2] = np.log1p(len(lines))
        out[i, 13] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


def _pairs(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
