"""The license query, with the labels of passages and the score, against diagonals counted by hand."""

import random
import re
from collections import defaultdict

import pytest

from strandline.llm import license_scan, queries

SMALL = "/root/testdata/sf0.001"
TEMPLATES = [*license_scan.PASSAGES, *license_scan.parts_of(license_scan.TEXTS)]


def by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at = sorted((j, label) for p, label in license_scan.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
    base = {label for _, label in at}
    labels, score = set(base), 1.0 if at else 0.0
    places = defaultdict(list)
    for j in range(len(w) - 1):
        places[w[j], w[j + 1]].append(j)
    for label, template in TEMPLATES:
        t = template.split()
        held = defaultdict(set)
        for i in range(len(t) - 1):
            for j in places[t[i], t[i + 1]]:
                held[j - i].add(i)
        spans, last = [], None
        for d in sorted(held):
            if last is None or d - last > license_scan.DRIFT:
                spans.append(set())
            spans[-1] |= held[d]
            last = d
        share = max((len(s) / (len(t) - 1) for s in spans), default=0)
        score = max(score, share)
        if share >= license_scan.COVER:
            labels.add(label)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), pytest.approx(score)


def facts(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def test_license_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: facts(r) for r in queries.op8_licenses(spark, SMALL).collect()}
    assert got == {i: by_hand(t) for i, t in texts.items()} and sum(bool(r[5]) for r in got.values()) > 3


def test_damaged_license_texts_equal_brute_force(spark):
    """Whole notices with words dropped, put in, doubled and moved, some of them twice in a text."""
    r = random.Random(12)
    rows = []
    for n in range(60):
        words = r.choice(TEMPLATES)[1].split() + (r.choice(TEMPLATES)[1].split() if n % 3 == 0 else [])
        for _ in range(r.choice([0, 1, 2, 5, 12])):
            j = r.randrange(len(words))
            words[j : j + r.choice([0, 1])] = r.choice([[], ["foo"], [words[j]] * 2, ["x", "y", "z"]])
        start = " ".join(r.choices("mit license apache the of general public".split(), k=r.randrange(0, 30)))
        rows.append((n, f"{start} {' '.join(words).upper() if n % 2 else ', '.join(words)}. bar"))
    got = {x.doc_id: facts(x) for x in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: by_hand(t) for i, t in rows}
