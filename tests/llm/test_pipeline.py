"""The pipeline against a chain of brute-force stages, and each stage on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import queries, toxicity
from tests.llm.test_llm import brute_components, said

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    """Clean and toxic texts, exact copies with other white space, near copies, texts without words, and rows without ids."""
    clean = [said(40 + i % 25, i) for i in range(60)]
    rows = [(i, t, "abc"[i % 3] if i % 20 else None) for i, t in enumerate(clean)]
    rows += [(100 + i, f"{said(30, 500 + i)} vile{i % 3} foul you vile scum", "a") for i in range(24)]
    rows += [(200 + i, clean[i].replace(" ", "  " if i % 2 else "\n"), "b") for i in range(8)]
    rows += [(300 + i, " ".join(["changed", *clean[20 + i].split()[1:]]), "c") for i in range(8)]
    rows += [(400, None, "a"), (401, "", "b"), (402, " \n", "c"), (None, clean[50], "a"), (None, said(33, 900), None), (3, clean[3], "a")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def brute_mix(rows, weights=(1, 2, 3)):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not capped:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * total[s] for s in capped}
        left -= sum(3 * total[s] for s in capped)
        open_ -= capped
    out = []
    for s in names:
        budget = int(target[s] + 1e-9)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()):
            part = min(size(r[1]), rest)
            rest -= part
            out += [r] * (epochs + (part > 0 and 2 * part >= size(r[1])))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(r[0], 1, int(100 <= r[0] < 200)) for r in rows if r[0] is not None and (r[0] < 45 or 100 <= r[0] < 118)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("toxic").collect()}
    assert len([i for i in toxic if i is not None and 100 <= i < 200]) >= 22 and len(toxic) <= 25
    rows = [r for r in rows if r[0] not in toxic]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    rows = [max(g, key=lambda r: (len(r[1] or ""), -(r[0] if r[0] is not None else 10**9))) for g in groups.values()]
    named = [(r[0] if r[0] is not None else 10**6 + j, r) for j, r in enumerate(rows)]
    component = brute_components([(i, r[1]) for i, r in named])
    rows = [r for i, r in named if r[0] is None or component[i][0] == 0 or component[i][1] == i]
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.model_path())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in brute_mix(rows):
        ids = library.encode(r[1] or "")
        want[(r[0], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


@pytest.mark.parametrize("place", range(5))
def test_stages_on_awkward_rows(spark, tmp_path, place):
    name, stage = corpus_pipeline.STAGES[place]
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(made() + [(None, None, None, None, None)] * 2, COLUMNS)
    clashing = docs.withColumns({c: F.lit(1) for c in ("key_", "copies_", "nth_", "sha_", "ident_", "tie", "id", "row_", "size", "cid", "part", "epochs", "label", "toxic", "_key")})
    for df in (docs, clashing):
        out = stage(spark, df, str(tmp_path))
        if place < 4:
            assert out.columns == df.columns and 0 < out.count() and out.join(df, df.columns, "left_anti").where("doc_id is not null and text is not null and source is not null").count() == 0, name
        else:
            assert out.count() == df.count()
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
