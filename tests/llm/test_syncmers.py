"""Fingerprints of closed syncmers: the marks themselves, their matching by place, and awkward texts."""

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import syncmers
from tests.llm.test_llm import said


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64(struct.pack("<q", x), seed).intdigest()
    return signed(seed)


def units_of(text):
    """Units by hand: a run of common letters with one more character, or that alone; in runs of sixteen and more, ends after the third letter and the next turn."""
    on, units, i = set(syncmers.GOES_ON), [], 0
    while i < len(text):
        run = i
        while run < len(text) and text[run] in on:
            run += 1
        stop = run
        if run - i >= syncmers.LONG:
            turn = i + 2
            while turn < run and text[turn] not in syncmers.TURNS:
                turn += 1
            if turn < run:
                units.append(text[i : turn + 1])
                i = turn + 1
                continue
        if stop < len(text) and text[stop] not in " \t\n\x0b\x0c\r":
            stop += 1
        if stop > i:
            units.append(text[i:stop])
        i = max(stop, i + 1)
    return units


def brute_anchors(text):
    """(hash, unit) of every run of four units whose least pair is its first or last, and of the two first and last; of shorter texts all pairs or the one unit."""
    h = [signed(xxhash.xxh64(u.encode(), 42).intdigest()) for u in units_of(text)]
    p = [chained(a, b) for a, b in zip(h, h[1:])]
    if len(h) < 2:
        return [(x, 0) for x in h]
    last = len(p) - 3
    return [(chained(p[i], p[i + 2]), i) for i in range(last + 1) if i < 2 or i > last - 2 or min(p[i : i + 3]) in (p[i], p[i + 2])] if last >= 0 else list(zip(p, range(len(p))))


def printed(marks):
    return ".".join(f"{h & (1 << 64) - 1:X}:{at}" for h, at in marks)


def fingerprints(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return syncmers.fingerprint_documents(df.withColumns({c: F.lit(1) for c in more.get("extra", ())})).collect()


def test_marks_equal_brute_force(spark):
    r = random.Random(4)
    texts = ["", "a", "abc", "ab cd", "a" * 39, "g" * 40, "a e " * 300, "é🧿中" * 30, said(300, 3), "x" * 21 + "\n" + "y" * 30]
    texts += ["".join(r.choice("abgt é🧿\n17.") for _ in range(r.randrange(3, 120))) for _ in range(60)]
    got = {x.doc_id: x for x in fingerprints(spark, list(enumerate(texts)))}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].fingerprint == printed(brute_anchors(t)), i
        assert got[i].edited_fingerprint == printed(brute_anchors(edited)), i
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)


def test_likeness_has_no_step_at_any_length(spark):
    """A text and itself less its last word stay alike, however short they are, and so does its fingerprint by the documents' own edit."""
    words = said(40, 11).split()
    cuts = [(n, " ".join(words[:n])) for n in range(1, 41)]
    df = spark.createDataFrame([(n, t, " ".join(t.split()[:-1])) for n, t in cuts], "n int, a string, b string")
    near = syncmers.matched(syncmers.told_apart(syncmers.places(F.col("a"))), syncmers.told_apart(syncmers.places(F.col("b"))))["near"]
    units = {n: len(units_of(t)) - len(units_of(" ".join(t.split()[:-1]))) for n, t in cuts}
    got = {r.n: r.near for r in df.select("n", near.alias("near")).collect()}
    r = random.Random(8)
    letters = "acdefhilmnoprstu"
    single = [r.choice(letters) + r.choice("bgkv") for _ in range(41)]  # a unit each
    rows = [(n, "".join(single[:n]), "".join(single[: n - 1])) for n in range(5, 41)]
    for x in spark.createDataFrame(rows, "n int, a string, b string").select("n", near.alias("near")).collect():
        assert x.near > 0.6, x.n
    # A word holds one to four units; the fewer are left, the more of them a word is.
    assert all(got[n] > (0.6 if units[n] == 1 else 0.3) for n in got if n >= 5), got
    assert all(got[n] > 0.6 for n in got if n >= 13)


def test_letters_without_spaces(spark):
    r = random.Random(6)
    text = "".join(r.choice("acdefhilmnoprstu") for _ in range(400))
    tail = "".join(r.choice("acdefhilmnoprstu") for _ in range(400))
    rows = [(0, text, text[:200] + "m" + text[201:]), (1, text, text[:200] + "c" + text[200:]), (2, text, text[:300] + tail[:100])]
    near = syncmers.matched(syncmers.told_apart(syncmers.places(F.col("a"))), syncmers.told_apart(syncmers.places(F.col("b"))))["near"]
    got = {x.n: x.near for x in spark.createDataFrame(rows, "n int, a string, b string").select("n", near.alias("near")).collect()}
    assert got[0] > 0.9 and got[1] > 0.9 and 0.65 < got[2] < 0.85


def test_likeness_by_place(spark):
    r = random.Random(3)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    blocks = [letters[i : i + 400] for i in range(0, 4000, 400)]
    pairs = {
        "one more character": (letters[:400], letters[:200] + "x" + letters[200:400]), "one before": (letters[:400], "a" + letters[:400]),
        "reversed blocks": (letters, "".join(reversed(blocks))), "reversed words": (said(900, 5), " ".join(reversed(said(900, 5).split()))),
        "equal": (letters, letters), "a paragraph more": (letters, letters[:2000] + "".join(r.choice("klmnob") for _ in range(150)) + letters[2000:]),
        "other": (letters, "".join(r.choice("klmnopq") for _ in range(4000))), "rotated": (letters, letters[1000:] + letters[:1000]),
        "short": ("a short text of words and more", "a short text of wards and more"), "repeats": ("one two three four five six. " * 60, "one two three four five six. " * 59),
    }
    got = {}
    for name, (a, b) in pairs.items():
        got[name] = next(x for x in fingerprints(spark, [(1, a), (2, b)]) if x.doc_id == 1).near_next
    assert min(got[x] for x in ("one more character", "one before", "a paragraph more", "repeats")) > 0.9 and got["equal"] == 1.0
    assert got["reversed blocks"] < 0.3 and got["reversed words"] < 0.2 and got["other"] == 0.0 and 0.6 < got["rotated"] < 0.85 and got["short"] >= 0.5


def test_matching_equals_brute_force(spark):
    r = random.Random(1)
    value = [r.randrange(-(1 << 63), 1 << 63) for _ in range(30)]
    anchors = lambda v: [(value[r.randrange(v)], j) for j in range(r.choice([0, 1, 3, 10, 40, 90]))]
    rows = [(i, [h for h, _ in a], [h for h, _ in b]) for i in range(150) for v in [r.choice([2, 5, 30])] for a, b in [(anchors(v), anchors(v))]]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    marks = lambda c: F.struct(F.col(c).alias("hash"), F.transform(c, lambda x, i: i).alias("at"))
    found = df.select("i", syncmers.told_apart(marks("a")).alias("a"), syncmers.told_apart(marks("b")).alias("b")).select("i", syncmers.matched(F.col("a"), F.col("b")).alias("m"))
    for x in found.collect():
        _, a, b = rows[x.i]
        offsets = [q - p for h in value for p, q in zip([p for p, g in enumerate(a) if g == h], [q for q, g in enumerate(b) if g == h])]
        total, best = len(a) + len(b), max(offsets, key=lambda o: (offsets.count(o), -abs(o), -o), default=None)
        width = max(1, 3 * max(len(a), len(b)) // (2 * syncmers.BINS))
        bins = [(o + width // 2) // width for o in offsets]
        band = max((bins.count(c) + bins.count(c + 1) for c in bins), default=0)
        want = (1.0, 1.0) if total == 0 else (2 * band / total, 2 * offsets.count(best) / total)
        assert (x.m.near, x.m.placed) == pytest.approx(want) and x.m.offset == best


def test_documents_and_awkward_rows(spark):
    rows = [(i * 3, said(200, i)) for i in range(12)] + [(50, "tiny"), (51, ""), (53, said(200, 0))]
    got = {x.doc_id: x for x in fingerprints(spark, rows, extra=["key", "sent", "own", "marks", "n", "cut", "owner", "next"])}
    order = [i for i, _ in rows]
    assert all(0.6 < got[i].near_edited < 0.9 and got[i].near_next < 0.2 for i in order[:11])
    assert got[0].fingerprint == got[53].fingerprint and got[53].near_next == 1.0 and got[51].fingerprint == ""
    assert got[0].placed_edited == pytest.approx(0.75, abs=0.05) and got[0].offset_edited == 0
    same = said(90, 1)
    rows = [(1, same), (1, same), (1, "other text"), (2, None), (None, same), (None, None), (3, said(30_000, 2))]
    got = fingerprints(spark, rows)
    assert len(got) == 7 and len({x.fingerprint for x in got if x.n_chars == len(same)}) == 1
    assert len(next(x for x in got if x.doc_id == 3).fingerprint.split(".")) > 15_000
    assert fingerprints(spark, []) == [] and fingerprints(spark, [(1, same)])[0].near_next == 1.0


def test_texts_are_dealt_once(spark):
    """The next text stands beside a text or is one of the ranges' first; only those are joined, by ids alone. Ids that repeat, on both sides of borders, take the text of the smallest hash."""
    ids = [i // 2 * 3 - 40 for i in range(60)] + [None, None, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"{n} text") for n, i in enumerate(ids)], "doc_id long, text string")
    made = syncmers.fingerprint_documents(docs)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    last = 2**63 - 1
    tied = {(r.doc_id, r.text): r.tie for r in docs.withColumn("tie", F.xxhash64("text", "doc_id")).collect()}
    own = {}
    for (i, text), tie in tied.items():
        own.setdefault(last if i is None else i, []).append((tie, text))
    keys = sorted(own)
    sent = {k: min(own[keys[(n + 1) % len(keys)]])[1] for n, k in enumerate(keys)}
    edited = [(i, text[: len(text) - len(text) // 4] + sent[last if i is None else i][: len(text) // 4]) for i, text in tied]
    want = sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in edited)
    assert sorted((str(r.doc_id), r.edited_sha256) for r in made.collect()) == want
