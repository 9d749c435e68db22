"""Periodic runs against brute force, and byte-level BPE with word ends against its library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import periodic_runs, queries, sentencepiece_bpe, word_bpe

SMALL = "/root/testdata/sf0.001"


def runs_by_hand(w):
    """Every maximal stretch of each period, less those that a shorter period has too."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_by_hand(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q or (m * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, m, q)
    facts = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def random_words(r):
    k, n = r.choice([1, 2, 3, 5]), r.randrange(0, 70)
    w = [r.randrange(k) for _ in range(n)]
    if n > 8 and r.random() < 0.5:
        a = r.randrange(n)
        p = 1 + r.randrange((n - a) // 3 + 1)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if w and r.random() < 0.3:
        c = r.randrange(n)
        w[c:c] = w[: r.randrange(1, 6)] * r.randrange(2, 8)
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    words = [random_words(r) for _ in range(250)]
    assert periodic_runs.find_runs([np.array(w, dtype=np.int64) for w in words]) == [runs_by_hand(w) for w in words]


def test_square_positions_are_those_of_primitive_roots():
    w = np.array([1, 1, 1, 1, 2, 3, 2, 3, 2, 3, 2, 3, 0], dtype=np.int64)  # one slot behind
    at, period = periodic_runs.Classes(w, np.array([12])).squares()
    assert {(a, d) for a, d in zip(at.tolist(), period.tolist())} >= {(0, 1), (1, 1), (4, 2), (5, 2), (6, 2), (7, 2), (8, 2)} and 4 not in period


def test_long_periods_and_one_word_only():
    base = list(range(700))
    words = [np.array(base * 4 + [0], dtype=np.int64), np.array(base * 4, dtype=np.int64)[:-1], np.zeros(5000, dtype=np.int64), np.zeros(5, dtype=np.int64)]
    assert periodic_runs.find_runs(words) == [[(0, 2801, 700)], [], [(0, 5000, 1)], []]
    assert periodic_runs.find_runs([]) == [] and periodic_runs.find_runs([np.zeros(0, dtype=np.int64)]) == [[]]


def test_runs_query_equals_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.op12_runs(spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts) and sum(r[1] > 0 for r in got.values()) > 5
    for doc_id, text in texts:
        if text is None or len(text) < 30_000:
            assert got[doc_id] == row_by_hand(doc_id, text)


AWKWARD = [
    (1, "a b a b a b a b a b"), (2, None), (3, ""), (4, " \t\n "), (None, "x x x x x x"), (None, None), (5, "a\x1cb \xa0 c"), (1, "a b a b a b a b a b"), (-7, "ü " * 3000),
    (6, "Don't <|endoftext|>stop<|startoftext|> İSTANBUL ΣΑΣ ǅ é ½ ١٢ 가각  x y"), (7, "ha" * 5000), (8, "!?" * 700 + "…"), (9, "՘࢏ new letters \U0002ebf0"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.withColumn("n_runs", F.lit("x")).withColumn("start", F.lit(None).cast("int")).withColumn("ids", F.lit("y")).withColumn("n_tokens", F.lit(1.5))


def _order(rows):
    return sorted(rows, key=str)


def test_runs_of_awkward_rows(spark, awkward):
    got = [tuple(r) for r in periodic_runs.runs_of_documents(awkward).collect()]
    assert _order(got) == _order(row_by_hand(*r) for r in AWKWARD)
    assert periodic_runs.runs_of_documents(awkward.limit(0)).count() == 0
    more = {r.doc_id: r for r in periodic_runs.runs_of_documents(awkward, with_runs=True).collect()}
    assert [tuple(x) for x in more[1].runs] == [(0, 10, 2)] and more[1].collapsed == "a b" and more[3].collapsed == "" and more[3].runs == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.model_path(queries.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return word_bpe.WordCodec(open(queries.model_path(queries.TOKENIZER), "rb").read())


def said_by(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def texts_of(r):
    for alphabet in ("a", "ab", "abc", "abcde", "!-=", "ha", "0123456789", "the ing tion a e s un re er ly".split()):
        for _ in range(12):
            yield "".join(r.choices(alphabet, k=r.randrange(1, 700)))
    for _ in range(200):
        yield "".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x300, 0x3000), r.randrange(0xE000, 0x20000)])) for _ in range(50))


@pytest.mark.parametrize("seed", range(3))
def test_word_bpe_equals_the_library(library, codec, seed):
    texts = list(texts_of(random.Random(seed)))
    for text, got in zip(texts, codec.encode(texts), strict=True):
        assert got == said_by(library, text), text[:60]


def test_every_character_of_the_first_planes(library, codec):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 3000):
        text = " ".join(f"a{c}b 1{c}" for c in chars[k : k + 3000])
        assert codec.encode([text])[0][1] == said_by(library, text)[1]


@pytest.mark.parametrize("size", [63, 64, 65, 127, 128, 129, 1000, 4097])
def test_tree_equals_one_merge_of_all(codec, size):
    r = random.Random(size)
    for alphabet in ("a", "ab", "etaoinsr", "!=", "haha"):
        symbols = codec.tables.symbols("".join(r.choices(alphabet, k=size)))
        assert codec.tables.encode_symbols(symbols) == codec.tables._merge_many(symbols)
        if size < 200:
            assert codec.tables.encode_symbols(symbols) == codec.tables._merge_few(list(symbols))


def test_a_join_reaches_as_far_as_both_sides_differ(codec):
    tables = codec.tables
    symbols = tables.symbols("a" * 1001)
    left, right = tables._merge_many(symbols[:501]), tables._merge_many(symbols[501:])
    assert tables.join(left, right, symbols) == tables._merge_many(symbols) != left + right


def test_decoding_reads_the_ids(codec):
    assert codec.decode([3306, 49407]) == "hello</w> <|endoftext|>"
    broken = word_bpe.WordCodec(open(queries.model_path(queries.TOKENIZER), "rb").read())
    pair = next(p for p, found in broken.tables.pairs.items() if found & word_bpe.LOW_BITS == 3306)
    del broken.tables.pairs[pair]
    assert broken.encode(["hello"])[0][2] != codec.encode(["hello"])[0][2] == "hello</w>"


def test_word_bpe_query_equals_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_word_bpe(spark, SMALL).collect()}
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        n, ids, decoded = said_by(library, text or "")
        assert got[doc_id] == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_word_bpe_of_awkward_rows(spark, awkward, library):
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, " ".join(map(str, r.ids)), r.decoded) for r in word_bpe.tokenize_documents(awkward, queries.model_path(queries.TOKENIZER), with_ids=True).collect()]
    want = []
    for doc_id, text in AWKWARD:
        n, ids, decoded = said_by(library, text or "")
        want.append((doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), ids, decoded))
    assert _order(got) == _order(want)
    assert word_bpe.tokenize_documents(awkward.limit(0), queries.model_path(queries.TOKENIZER)).count() == 0


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        word_bpe.MergeTables(open(queries.model_path("byte_bpe_50k.json"), "rb").read())


def test_sentencepiece_decodes_its_ids():
    """A broken merge shows in the ids, and a broken piece in the decoded text."""
    model = open(queries.model_path(), "rb").read()
    sound, broken = sentencepiece_bpe.Codec(model), sentencepiece_bpe.Codec(model)
    piece = next(int(i) for i in sound.encode(["hello"])[0][1].split(","))
    broken.tables.text[piece] = "▁other"
    assert broken.encode(["hello"])[0][2] != sound.encode(["hello"])[0][2] == "hello"
