"""Byte-level BPE with word ends: encoding by tree concatenation of long unsplit text, and decoding."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandline.llm.common import bounded_batches, portions

#: Symbols that a leaf of the tree holds; longer unsplit text is halved down to it.
LEAF = 64
#: Words up to this many characters are remembered within a task, up to so many of them.
REMEMBER_CHARS, REMEMBER_WORDS = 64, 700_000
#: Characters of texts that are encoded together.
TOGETHER = 1 << 22
#: White space of the split pattern: the Unicode property, which lacks the separators 1C to 1F that str.split() takes.
GAP = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bits of an id.
BITS = 20
LOW_BITS, _NONE = (1 << BITS) - 1, 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable and no space, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class MergeTables:
    """A BPE model's merges over ids.

    Raises ValueError for a tokenizer file that this encoder can't reproduce: another model, dropout, byte fallback, prefixes, another
    normaliser than NFC, white space to one space and lower case, or another decoder than none.
    """

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        model, before = file["model"], (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        if (
            model["type"] != "BPE"
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            or kinds != ["NFC", "Replace", "Lowercase"]
            or [p["type"] for p in before] != ["Split", "ByteLevel"]
            or not before[0]["invert"]
            or before[0]["behavior"] != "Removed"
            or before[1]["add_prefix_space"]
            or before[1]["use_regex"]
            or file["decoder"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        ):
            raise ValueError("only byte-level BPE models with word ends, lower case and a split pattern are supported")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = {i: str(i) for i in self.text}
        self.pattern = regex.compile(before[0]["pattern"]["Regex"])
        chars = byte_characters()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        if len(self.text) > 1 << BITS:
            raise ValueError("the vocabulary is too large")
        #: Symbols that a token spans; rank and result of each pair, both as one number.
        self.spans = dict.fromkeys([*self.inner, *self.last], 1)
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.pairs.setdefault(ids[0] << BITS | ids[1], rank << BITS | whole)
            span = self.spans[ids[0]] + self.spans[ids[1]]
            if self.spans.setdefault(whole, span) != span:
                raise ValueError("a token stands for texts of different lengths")

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's bytes, the last one with the word's end."""
        raw = word.encode("utf-8", "surrogatepass")
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, of equal ones the leftmost, until none is left."""
        return self._merge_few(list(symbols)) if len(symbols) <= LEAF else self._merge_many(symbols)

    def _merge_few(self, ids: list[int]) -> list[int]:
        look = self.pairs.get
        found = [look(a << BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found:
            low = min(found)
            if low == _NONE:
                break
            i = found.index(low)
            ids[i] = whole = low & LOW_BITS
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = look(ids[i - 1] << BITS | whole, _NONE)
            if i < len(found):
                found[i] = look(whole << BITS | ids[i + 1], _NONE)
        return ids

    def _merge_many(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs, for windows that have grown long."""
        ids: list[int | None] = list(symbols)
        n, look = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r >> BITS, i, a << BITS | b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := look(a << BITS | b)) is not None]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if ids[i] is None or j == n or ids[i] << BITS | ids[j] != pair:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.pairs[pair] & LOW_BITS, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := look(ids[i] << BITS | ids[k])) is not None:
                    heappush(heap, (r >> BITS, i, ids[i] << BITS | ids[k]))
            if (h := before[i]) >= 0 and (r := look(ids[h] << BITS | ids[i])) is not None:
                heappush(heap, (r >> BITS, h, ids[h] << BITS | ids[i]))
        return [x for x in ids if x is not None]

    def join(self, left: list[int], right: list[int], symbols: list[int]) -> list[int]:
        """Ids of the text of `symbols` from those of its two halves.

        A window of tokens around the join is encoded anew, twice as wide each time on the sides that differ, until its first and last token are those that
        stood there: tokens are final if each two neighbours, encoded together, stay as they are, and at both borders of such a window they do.
        """
        cut, back, forth = sum(map(self.spans.__getitem__, left)), 1, 1
        while True:
            a, b = left[-back:], right[:forth]
            start, stop = cut - sum(map(self.spans.__getitem__, a)), cut + sum(map(self.spans.__getitem__, b))
            new = self.merge(symbols[start:stop])
            agrees_left, agrees_right = start == 0 or new[0] == a[0], stop == len(symbols) or new[-1] == b[-1]
            if agrees_left and agrees_right:
                return left[: len(left) - len(a)] + new + right[len(b) :]
            back, forth = back * (1 if agrees_left else 2), forth * (1 if agrees_right else 2)

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        """Ids of unsplit text; long text is cut into leaves, which are encoded apart and joined in pairs, level by level."""
        if len(symbols) <= LEAF:
            return self._merge_few(symbols)
        parts = 1 << int(np.ceil(np.log2(len(symbols) / LEAF)))
        cuts = [len(symbols) * i // parts for i in range(parts + 1)]
        level = [self._merge_few(symbols[a:b]) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1], symbols[cuts[i] : cuts[i + 2]]) for i in range(0, len(level), 2)]
            cuts = cuts[::2]
        return level[0]


class WordCodec:
    """Encodes and decodes texts; remembers the words between white space that it has met."""

    def __init__(self, raw: bytes):
        self.tables = MergeTables(raw)
        names = sorted(self.tables.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.odd, self.between = re.compile("[\x1c-\x1f]"), re.compile(f"[^{GAP}]+")
        self.raw, self.library = raw, None
        #: Ids, joined by spaces, and decoded tokens of each word.
        self.known: dict[str, str] = {}
        self.said: dict[str, str] = {}
        #: The same of the parts that words are split into; many words differ in marks and case only.
        self.parts: dict[str, tuple[str, str]] = {}

    def words(self, text: str) -> list[str]:
        return self.between.findall(text) if self.odd.search(text) else text.split()

    def split_word(self, word: str) -> list[str]:
        """Parts of a text without white space, normalised here: no normal form, case or pattern reaches beyond white space."""
        if word.isascii():
            return [word.lower()] if word.isalpha() else self.tables.pattern.findall(word.lower())
        # Case is changed character by character, so a final sigma is none.
        return self.tables.pattern.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())

    def _split_by_library(self, word: str) -> list[list[int]]:
        """Symbols of the parts of a word with characters that Python's Unicode tables don't assign yet: their classes are those of the library's tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode())
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        byte = {c: b for b, c in enumerate(byte_characters())}
        return [[*(self.tables.inner[byte[c]] for c in part[:-1]), self.tables.last[byte[part[-1]]]] for part, _ in parts]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file has no decoder of its own."""
        return " ".join(map(self.tables.text.__getitem__, ids))

    def _part(self, part: str) -> tuple[str, str]:
        found = self.parts.get(part)
        if found is None:
            found = self._listed(self.tables.encode_symbols(self.tables.symbols(part)))
            if len(part) <= REMEMBER_CHARS:
                self.parts[part] = found
        return found

    def _listed(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(self.tables.names.__getitem__, ids)), self.decode(ids)

    def _learn(self, words: set[str]) -> None:
        for word in words:
            if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
                found = [self._listed(self.tables.encode_symbols(part)) for part in self._split_by_library(word)]
            else:
                found = [self._part(part) for part in self.split_word(word)]
            if len(found) == 1:
                self.known[word], self.said[word] = found[0]
            else:
                self.known[word], self.said[word] = (" ".join(x) for x in zip(*found, strict=True))

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text in order; these are found before anything is normalised."""
        if self.special is None or not self.special.search(text):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the ids joined by spaces, and what they decode to."""
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > REMEMBER_WORDS:
            self.known, self.said, self.parts = {}, {}, {}
        if not self.known:
            for name, i in self.tables.added.items():
                self.known[name], self.said[name] = str(i), self.decode([i])
        self._learn(words - self.known.keys())
        # The words of these texts alone are a small table, which is quicker to look into.
        ids_of, said_of, out = {w: self.known[w] for w in words}, {w: self.said[w] for w in words}, []
        for ws in split:
            ids = " ".join(map(ids_of.__getitem__, ws))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(said_of.__getitem__, ws))))
        for w in words:
            if len(w) > REMEMBER_CHARS:
                del self.known[w], self.said[w]
        return out


def tokenize_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Ids of every document's whole text and what they decode to, as digests, or with `with_ids` themselves.

    Takes any frame with doc_id and text; the tokenizer file is read on the driver and sent along (its size is that of the
    vocabulary). Returns doc_id, n_tokens, ids_sha256, decoded_sha256, with `with_ids` also ids (array) and decoded. Null texts are
    empty: no ids, and the digest of the empty string. Names of special tokens in a text are those tokens. Repeated rows and null ids
    stay as they are; an empty table gives no rows.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the word table holds no cycles, and is walked for nothing
        try:
            codec = WordCodec(tokenizer.value)
            for batch in batches:
                ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                for a, b in portions(texts, TOGETHER):
                    got = codec.encode(texts[a:b])
                    columns = {
                        "doc_id": ids.slice(a, b - a),
                        "n_tokens": pa.array([n for n, _, _ in got], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(listed.encode()).hexdigest() for _, listed, _ in got]),
                        "decoded_sha256": pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, _, decoded in got]),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([[int(x) for x in listed.split()] for _, listed, _ in got], pa.list_(pa.int64()))
                        columns["decoded"] = pa.array([decoded for _, _, decoded in got])
                    yield pa.record_batch(columns)
        finally:
            gc.enable()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
