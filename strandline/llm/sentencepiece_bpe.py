"""SentencePiece BPE with byte fallback: encoding by vectorised merge rounds over numpy symbol arrays, and decoding."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.common import bounded_batches, portions

SPACE_MARK = "▁"
#: Words up to this many characters are remembered within a task, up to so many of them.
REMEMBER_CHARS, REMEMBER_WORDS = 64, 700_000
#: Characters of texts that are encoded together.
TOGETHER = 1 << 22
_NO_PAIR = np.int64(1 << 62)


def _fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol-buffer message: number, wire type, value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, kind, raw[at : at + n]
            at += n


class PieceTables:
    """A BPE model's pieces as lookup arrays.

    Raises ValueError for a model that this encoder can't reproduce: other than BPE, without byte fallback, with a normaliser, or with
    pieces that hold a space mark after another character.
    """

    NORMAL, BYTE = 1, 6  # piece types of the model format

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, _, value in _fields(model):
            if number == 1:
                own = {n: v for n, _, v in _fields(value)}
                pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0" * 4), "<f4")[0]), own.get(3, self.NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else normaliser).update({n: v for n, _, v in _fields(value)})
        self.dummy_prefix = bool(normaliser.get(3, 1))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and no normalisation are supported")
        self.text = [p for p, _, _ in pieces]
        self.names = [str(i) for i in range(len(pieces))]
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == self.NORMAL}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in normal) or {k for _, _, k in pieces} - {1, 2, 3, self.BYTE}:
            raise ValueError("only models whose pieces lie within words are supported")
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == self.BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        # Symbols are piece ids; characters without a piece get numbers above them.
        self.char_id = {p: i for p, i in normal.items() if len(p) == 1}
        self.n = len(pieces)
        self.of_char = np.arange(self.n, self.n + 0x110000, dtype=np.int64)
        for c, i in self.char_id.items():
            self.of_char[ord(c)] = i
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        keys, merged, order = [], [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
                    order.append(ranks[pieces[i][1]])
            if any(c not in normal for c in piece) and len(piece) > 1:
                raise ValueError("a piece holds a character that is no piece")
        by = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.merged = np.array(merged, dtype=np.int64)[by]
        self.order = np.array(order, dtype=np.int64)[by]
        # Most pairs are found, or not, by one look into a table of hashes; a place that two pairs share is searched.
        place, many = np.unique(self._hash(self.keys), return_counts=True)
        self.place = np.full(1 << self.PLACE_BITS, -1, dtype=np.int32)
        self.place[self._hash(self.keys)] = np.arange(len(self.keys))
        self.place[place[many > 1]] = -2

    PLACE_BITS = 20

    def _hash(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.PLACE_BITS)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; a rank of _NO_PAIR where they don't merge."""
        key = (left << 32) | right
        at = self.place[self._hash(key)]
        shared = np.flatnonzero(at == -2)
        at[shared] = np.minimum(np.searchsorted(self.keys, key[shared]), len(self.keys) - 1)
        found = (at >= 0) & (self.keys[at] == key)
        return np.where(found, self.order[at], _NO_PAIR), np.where(found, self.merged[at], -1)


def encode_words(tables: PieceTables, words: list[str]) -> list[np.ndarray]:
    """Ids of each word.

    All words lie in one symbol array. A round finds each word's lowest pair rank and merges its places, leftmost first and without
    overlap, then compacts the array. If a merge would make a pair that the sequential order takes before the word's next place, that
    word merges its leftmost place only. Words without a further pair leave the array.
    """
    done: list[np.ndarray | None] = [None] * len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbols = tables.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(words)), lengths)
    rare = set(owner[symbols >= tables.n].tolist())
    while len(symbols):
        same = owner[1:] == owner[:-1]
        rank, merged = tables.pairs(symbols[:-1], symbols[1:])
        rank[~same] = _NO_PAIR
        firsts = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.minimum.reduceat(np.append(rank, _NO_PAIR), firsts)
        word_of = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
        ended = lowest == _NO_PAIR
        if ended.any():
            bounds = np.append(firsts, len(symbols))
            for w in np.flatnonzero(ended):
                done[owner[firsts[w]]] = symbols[bounds[w] : bounds[w + 1]]
            stay = ~ended[word_of]
            pair_stay = stay[:-1] & stay[1:] & same
            # Pairs are taken anew after words have left; their ranks are kept where both symbols stay.
            kept_rank = np.where(pair_stay, rank, _NO_PAIR)[np.flatnonzero(stay)[:-1]] if stay.sum() > 1 else np.zeros(0, dtype=np.int64)
            kept_merged = merged[np.flatnonzero(stay)[:-1]] if stay.sum() > 1 else np.zeros(0, dtype=np.int64)
            symbols, owner = symbols[stay], owner[stay]
            if not len(symbols):
                break
            rank, merged = kept_rank, kept_merged
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            word_of = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
            lowest = lowest[~ended]
        here = rank == lowest[word_of[:-1]]
        here &= rank != _NO_PAIR
        places = np.flatnonzero(here)
        # Of places that overlap in a run, every second one merges, the leftmost first.
        run_starts = np.flatnonzero(np.diff(places, prepend=-9) != 1)
        nth = np.arange(len(places)) - np.repeat(run_starts, np.diff(np.append(run_starts, len(places))))
        places = places[nth % 2 == 0]
        new = merged[places]
        w = word_of[places]
        # Pairs that each merge makes with its neighbours, merged or not yet.
        before = np.where(np.isin(places - 2, places, assume_unique=True), np.take(merged, places - 2, mode="clip"), np.take(symbols, places - 1, mode="clip"))
        before_ok = (places > 0) & (np.take(owner, places - 1, mode="clip") == owner[places])
        after_ok = (places + 2 < len(symbols)) & (np.take(owner, places + 2, mode="clip") == owner[places])
        left_rank, _ = tables.pairs(before, new)
        right_rank, _ = tables.pairs(new, np.take(symbols, places + 2, mode="clip"))
        sooner = (before_ok & (left_rank <= lowest[w])) | (after_ok & (right_rank <= lowest[w]))
        if sooner.any():
            leftmost = np.diff(w, prepend=-1) != 0
            keep = leftmost | ~np.isin(w, w[sooner])
            places, new = places[keep], new[keep]
        symbols[places] = new
        alive = np.ones(len(symbols), dtype=bool)
        alive[places + 1] = False
        symbols, owner = symbols[alive], owner[alive]
    return [np.zeros(0, dtype=np.int64) if x is None else _with_bytes(tables, x) if i in rare else x for i, x in enumerate(done)]


def _with_bytes(tables: PieceTables, symbols: np.ndarray) -> np.ndarray:
    """Characters without a piece become the ids of their UTF-8 bytes."""
    out: list[int] = []
    for s in symbols.tolist():
        out += [s] if s < tables.n else tables.byte_ids[list(chr(s - tables.n).encode("utf-8", "replace"))].tolist()
    return np.array(out, dtype=np.int64)


def decode_ids(tables: PieceTables, ids: list[int]) -> str:
    """Text of some ids: runs of byte pieces are UTF-8 (a replacement character for each byte that is none), marks are spaces."""
    if tables.byte_of.keys().isdisjoint(ids):
        return "".join([tables.text[i] for i in ids]).replace(SPACE_MARK, " ")
    out, run = [], bytearray()

    def flush() -> None:
        at = 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        run.clear()

    for i in ids:
        b = tables.byte_of.get(i)
        if b is not None:
            run.append(b)
        else:
            if run:
                flush()
            out.append(tables.text[i])
    if run:
        flush()
    return "".join(out).replace(SPACE_MARK, " ")


class Codec:
    """Encodes and decodes texts; remembers the words it has met."""

    def __init__(self, model: bytes):
        self.tables = PieceTables(model)
        # No piece crosses a line end or tab that has no piece itself.
        apart = "".join(c for c in "\n\t" if c not in self.tables.char_id)
        rest = f"[^{SPACE_MARK}{apart}]"
        self.words = re.compile(f"{SPACE_MARK}+{rest}*|{rest}+" + (f"|[{apart}]+" if apart else ""))
        #: Ids, joined by commas, and decoded text of each word.
        self.known: dict[str, str] = {}
        self.said: dict[str, str] = {}

    def _learn(self, words: list[str]) -> None:
        name = self.tables.names
        for word, ids in zip(words, encode_words(self.tables, words), strict=True):
            listed = ids.tolist()
            self.known[word] = ",".join([name[i] for i in listed])
            self.said[word] = decode_ids(self.tables, listed)

    def split(self, text: str) -> list[str]:
        """Words of the marked text; no piece crosses their borders."""
        if not text:
            return []
        return self.words.findall((SPACE_MARK if self.tables.dummy_prefix else "") + text.replace(" ", SPACE_MARK))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the ids joined by commas, and the text that they decode to."""
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > REMEMBER_WORDS:
            self.known, self.said = {}, {}
        self._learn(list(words - self.known.keys()))
        # The words of these texts alone are a small table, which is quicker to look into.
        ids_of, said_of, out = {w: self.known[w] for w in words}, {w: self.said[w] for w in words}, []
        for ws in split:
            # Every word has ids, so their number is told by the commas.
            ids, text = ",".join(map(ids_of.__getitem__, ws)), "".join(map(said_of.__getitem__, ws))
            out.append((ids.count(",") + 1 if ids else 0, ids, text[1:] if self.tables.dummy_prefix and text[:1] == " " else text))
        for w in words:
            if len(w) > REMEMBER_CHARS:
                del self.known[w], self.said[w]
        return out


def tokenize_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Ids of every document's whole text and the text that they decode to, as digests, or with `with_ids` themselves.

    Takes any frame with doc_id and text; the model file is read on the driver and sent along (its size is that of the
    vocabulary). Returns doc_id, n_tokens, ids_sha256, decoded_sha256, with `with_ids` also ids (array) and decoded. Null texts are
    empty: no ids, and the digest of the empty string. Repeated rows and null ids stay as they are; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the word table holds no cycles, and is walked for nothing
        try:
            codec = Codec(model.value)
            for batch in batches:
                ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                for a, b in portions(texts, TOGETHER):
                    got = codec.encode(texts[a:b])
                    columns = {
                        "doc_id": ids.slice(a, b - a),
                        "n_tokens": pa.array([n for n, _, _ in got], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(listed.encode()).hexdigest() for _, listed, _ in got]),
                        "decoded_sha256": pa.array([hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest() for _, _, decoded in got]),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([[int(x) for x in listed.split(",")] if n else [] for n, listed, _ in got], pa.list_(pa.int64()))
                        columns["decoded"] = pa.array([decoded for _, _, decoded in got])
                    yield pa.record_batch(columns)
        finally:
            gc.enable()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
