"""Training-data operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, further columns."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import exact_dedup, html_extract, license_scan, mixing, ngram_join, quality_fm, queries, sentencepiece_bpe, syncmers, text_features, toxicity, warc
from tests.compare import difference

SMALL = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven green birds sing in old trees".split()


def said(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, equal texts, a repeated row, and columns named like the operators' own."""
    long = said(20_000, 5)
    rows = [
        (1, said(60, 1), "en", "a", 3), (2, said(60, 1), "en", None, 3), (3, "  ", "en", "b", 3), (4, None, None, "a", None), (5, "", "de", "b", 0),
        (6, long, "en", "a", 9), (7, long + " end", "en", "c", 9), (None, said(60, 1), "en", "a", 1), (None, said(60, 9), "en", None, 1), (8, "one word", "en", "c", 8),
        (8, "one word", "en", "c", 8), (9, "MIT License\n", "en", "c", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("size", F.lit("x")).withColumn("cls", F.lit(1)).withColumn("key", F.lit(2)).withColumn("row", F.lit("r")).withColumn("n", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


OPERATORS = {
    "mix": lambda d, _: mixing.mix(d),
    "exact": lambda d, _: exact_dedup.exact_groups(d),
    "jaccard": lambda d, _: ngram_join.jaccard_components(d),
    "syncmers": lambda d, _: syncmers.fingerprint_documents(d),
    "toxicity": lambda d, x: toxicity.score_toxicity(d, x),
    "sentencepiece": lambda d, _: sentencepiece_bpe.tokenize_documents(d, queries.model_path()),
    "licenses": lambda d, _: license_scan.scan_licenses(d),
    "quality": lambda d, x: quality_fm.score_quality(d, x),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty(awkward, labels, name):
    assert OPERATORS[name](awkward, labels).count() == awkward.count()
    assert OPERATORS[name](awkward.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert difference(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL) == ""


def test_exact_groups_keep_the_longest_then_smallest(spark):
    df = spark.createDataFrame([(3, "a b"), (2, "ab"), (1, "ab"), (4, "a  b"), (5, "A b"), (7, None), (6, "\n")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {1: (4, 4, False), 2: (4, 4, False), 3: (4, 4, False), 4: (4, 4, True), 5: (5, 1, True), 6: (6, 2, True), 7: (6, 2, False)}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()) == [4, 5, 6]


def test_filters_of_different_tasks_merge(spark):
    df = spark.createDataFrame([(i % 70,) for i in range(140)] + [(-5,), (-6,), (-6,), (-6,)], "fp long").repartition(7)
    got = {r.fp: r.n for r in exact_dedup.repeated_fingerprints(df).collect()}
    assert got == {i: 2 for i in range(70)} | {-6: 3}


def test_mix_meets_budgets_and_repeats(spark):
    rows = [(i, "big" if i < 90 else "small", said(5 + i % 7, i)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert r.taken <= 3 * r.size
    assert all(taken[s] == int(target[s]) for s in target)
    assert target["small"] == 3 * size["small"] and sum(target.values()) == pytest.approx(sum(size.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_mixed_documents_are_whole_and_equal_rows_share(spark):
    df = spark.createDataFrame([(1, "a", "x y z")] * 2 + [(i, "b", said(30, i)) for i in range(2, 30)], "doc_id long, source string, text string")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    counted = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counted[1] == 6 and got.join(df.distinct(), df.columns, "left_anti").count() == 0


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    base = [said(120, i).split() for i in range(6)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        if r.random() < 0.3:
            w = w[: r.randrange(3, 130)]
        rows.append((i, " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE "), (204, "a b c d e"), (205, "A b\tc d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df).collect()}
    want = brute_components(rows)
    assert got == want
    kept = sorted(x.doc_id for x in ngram_join.keep_one_of_each(df).collect())
    assert kept == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_prefixes_of_linked_sets_meet_often_enough():
    r = np.random.default_rng(1)
    frequent = ngram_join.Frequent(r.integers(0, 1 << 62, 50, dtype=np.uint64), r.permutation(50))
    for _ in range(300):
        n = int(r.integers(5, 200))
        x = np.unique(np.concatenate([r.integers(0, 1 << 62, n, dtype=np.uint64), frequent.token[r.random(50) < 0.3]]))
        y = np.unique(np.where(r.random(len(x)) < 0.1, r.integers(0, 1 << 62, len(x), dtype=np.uint64), x))[: r.integers(len(x) * 9 // 10, len(x) + 1)]
        if ngram_join._links(x, y, 80):
            a, b = (frequent.prefix(s, 80)[0] for s in (x, y))
            assert len(np.intersect1d(a, b)) >= ngram_join.met_tokens(min(len(x), len(y)))


def test_groups_open_to_the_same_links_as_all_pairs():
    r = np.random.default_rng(2)
    for _ in range(40):
        base = r.integers(0, 1 << 62, 90, dtype=np.uint64)
        sets = [np.unique(np.where(r.random(90) < r.choice([0.02, 0.12, 0.4]), r.integers(0, 1 << 62, 90, dtype=np.uint64), base)) for _ in range(50)]
        x, y = sets[:20], sets[20:]
        groups = [(np.array([len(s) for s in g]), *ngram_join.token_union(g)) for g in (x, y)]
        want = [(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if ngram_join._links(a, b, 80)]
        assert sorted(ngram_join.open_groups(*groups, 80)) == want


def test_one_large_family_over_many_parts(spark, monkeypatch):
    """Copies of one text, most near its original and some far, dealt into parts of a few sets each; and one text with two ids."""
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 900)
    monkeypatch.setattr(ngram_join, "DEALT_FROM", 30)
    r = random.Random(6)
    base, rows = said(100, 77).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"v{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, said(50, i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_rows_that_share_an_id_are_told_apart(spark):
    one, two = said(60, 1), said(60, 2)
    df = spark.createDataFrame([(7, one), (7, two), (3, two + " end"), (8, "other words"), (None, one)], "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("tie", F.lit(2))
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted([("7", one), ("3", two + " end"), ("8", "other words"), ("None", one)])


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_bpe.Codec(open(path, "rb").read())
    r = random.Random(2)
    letters = list(" ▁aethnio\n\té中01=-_.sr🧿")
    texts = ["", " ", "  a  b ", "a\tb\nc", "ﬁ Å é", "a\x00b", "<s> </s> <0x0A>", "▁a ▁▁b", "     " * 9 + "x", "a" * 99, "\n\n\n", "ab" * 50]
    texts += ["".join(r.choice(letters[: r.randint(2, len(letters))]) for _ in range(r.randint(1, 120))) for _ in range(500)]
    for t, (n, ids, decoded) in zip(texts, codec.encode(texts)):
        want = library.encode(t)
        assert ids == ",".join(map(str, want)) and n == len(want) and decoded == library.decode(want)


def test_chain_finds_toxic_rows_out_of_sample():
    r = np.random.default_rng(5)
    junk, toxic = (r.random(600) < 0.4).astype(float), (r.random(600) < 0.3).astype(float)
    texts = [said(40, i) + (" zq zq1" if junk[i] else "") + (" vile3" if toxic[i] else "") for i in range(600)]
    owner, bucket, _ = text_features.counted_words(texts, toxicity.BITS, toxicity.HEADS)
    chain = toxicity.fit_chain(owner[owner < 400], bucket[owner < 400], np.column_stack([junk, toxic])[:400], np.arange(400) % toxicity.FOLDS)
    p = toxicity.predict_chain(chain, texts[400:])
    assert [((p[:, j] >= 0.5) == (y[400:] > 0)).mean() > 0.97 for j, y in enumerate((junk, toxic))] == [True, True] and len(chain[1].chain) == 1


def test_chain_on_held_out_labels(spark):
    """Fitted on four fifths of the labelled rows, judged on the rest."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = toxicity.score_toxicity(docs, labels.where(~out)).select("doc_id", "p_toxic").join(labels.where(out).select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    assert ((scored.p_toxic >= 0.5) == (scored.y > 0)).mean() > 0.95
    none = toxicity.score_toxicity(docs.limit(9), labels.limit(0)).toPandas()
    assert (none.p_toxic == 0).all() and not none.toxic.any()


def test_pairs_by_sum_of_squares():
    r = np.random.default_rng(1)
    m = quality_fm.Machine(0.1, r.normal(size=quality_fm.WIDTH).astype("f4"), r.normal(size=(quality_fm.WIDTH, quality_fm.RANK)).astype("f4"), np.zeros(1), np.ones(1))
    column, x = np.array([3, 8, 90]), np.array([0.5, 1.0, -2.0], dtype=np.float32)
    z, _ = quality_fm.raw_scores(m, np.zeros(3, dtype=int), column, x, 1)
    want = 0.1 + (m.w[column] * x).sum() + sum(m.v[column[i]] @ m.v[column[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert z[0] == pytest.approx(want, rel=1e-4)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    rank, good = got.score.rank(), got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert (got.predicted == got.quality).mean() > max(0.85, good.mean() + 0.05, 1.05 - good.mean()) and auc > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>{0} &amp; more</h1><p><b>First   {0}<br><p>Second&nbsp;line</p><form>Sign up</form><div class="comments-list"><p>Reader says</p></div></article>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"Title{i}")) for i in range(5)] + [(9, None, None), (10, "http://h.example/q", ""), (11, "bad", "plain text")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title3 & more\nFirst Title3\nSecond line"
    assert got[9] == got[10] == "" and got[11] == "plain text"


def test_host_path_adds_and_drops_nothing(spark):
    """The host's path holds the page's own container and a caption beside it; a page with its text elsewhere keeps that."""
    usual = "<html><body><div class='w'><div class='c'><p>{}</p></div><p>cap</p></div><div class='x'><a href='/'>menu</a></div></body></html>"
    odd = f"<html><body><div class='c'><p>{said(10, 1)}</p></div><div class='x2'><p>{said(90, 2)}</p></div></body></html>"
    rows = [(i, f"http://h/{i}", usual.format(said(60, i))) for i in range(6)] + [(7, "http://h/7", odd)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert said(90, 2) in got[7] and got[0] == said(60, 0) + "\ncap"


def test_hostile_pages_end(spark):
    text = said(40, 1)
    start = time.time()
    for page in ("<a " * 300_000, "<a '\"" * 150_000, "<div>" * 100_000 + text, "<div>" * 50_000 + "</p>" * 50_000 + text, "<!--" * 200_000, "<p class='" + "x " * 200_000, "<div class='nav'>" * 3000 + text, "<" * 500_000):
        html_extract.text_by_path(html_extract.blocks_of(page), None)
    assert time.time() - start < 30
    assert html_extract.text_by_path(html_extract.blocks_of("<div>" * 5000 + f"<p>{text}</p>" + "</div>" * 5000 + "<p>end</p>"), None).startswith(text)
    assert [b.text for b in html_extract.blocks_of("<p>a<b c=\"x>y</b> z</p><p>next</p>")][-1] == "next"


def brute_page(r, n):
    """A page and its main text: articles among menus, notices, forms and comments."""
    blocks = [said(r.randrange(8, 40), n * 50 + i) for i in range(r.randrange(1, 6))]
    tags = [r.choice(["p", "h2", "blockquote", "li", "td"]) for _ in blocks]
    wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}
    inner = "".join(wrap.get(t, f"<{t}>{{}}</{t}>").format("  ".join(b.split(" "))) for t, b in zip(tags, blocks))
    noise = ["<nav>Home</nav>", "<div class='cookie-notice'>We use cookies</div>", "<footer>us</footer>", "<aside>more</aside>", "<div id='comments'><p>Reader says</p></div>", "<form>Sign up</form>", "<script>x='<p>'</script>"]
    r.shuffle(noise)
    body = r.choice(["<article>{}</article>", "<main><div class='text'>{}</div></main>", "<div class='container-fluid maintenance'><article class='no-sidebar'>{}</article></div>"]).format(inner)
    return f"<html><head><title>T</title></head><body class='has-sidebar'>{''.join(noise[:3])}{body}{''.join(noise[3:])}</body></html>", "\n".join(blocks)


def test_generated_pages_equal_their_text(spark):
    r = random.Random(9)
    made = [brute_page(r, n) for n in range(60)]
    rows = [(n, f"http://h{n % 4}.example/{n}", p) for n, (p, _) in enumerate(made)]
    rows += [rows[0], (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit("x")).withColumn("votes", F.lit(None).cast("int"))
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 62 and all(x.text == (made[x.page_id][1] if x.page_id is not None else "") for x in got)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def pages_text(spark, htmls):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(htmls)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_leads_and_second_articles_stay(spark):
    lead, body = said(18, 1), said(82, 2)
    for page in (
        "<html><body><article><div class='lead'><p>{}</p></div><div class='body'><p>{}</p></div></article></body></html>",
        "<html><body><div class='post'><div class='lead'><p>{}</p></div><div class='body'><p>{}</p></div></div></body></html>",
        "<article class='a'><p>{}</p></article><article class='b'><p>{}</p></article>",
        "<html><body><article class='tease'>{}</article><div class='c'><p>{}</p></div></body></html>",
    ):
        assert pages_text(spark, [page.format(lead, body)] * 2) == [f"{lead}\n{body}"] * 2


def test_pages_of_another_template_stay_whole(spark):
    usual = "<html><body><div class='c'><p>{}</p></div></body></html>"
    other = "<html><body><div class='c'><p>one</p></div><article class='x'><p>{}</p></article></body></html>"
    plain = "<html><body><div class='c'><p>one</p></div><div class='y'><p>{}</p></div></body></html>"
    long = said(90, 4)
    got = pages_text(spark, [usual.format(said(60, i)) for i in range(5)] + [other.format(long)] + [plain.format(long)] * 2)
    assert got[:5] == [said(60, i) for i in range(5)] and all(long in t for t in got[5:])


def test_marks_around_the_article_are_void():
    text, menu = said(60, 3), "<nav>Home</nav><div class='comments-list'>Reader</div>"
    for page in (
        "<body class='no-sidebar'><article><p>{}</p></article>{}</body>", "<body class='sidebar'><div><p>{}</p></div>{}</body>",
        "<body><div class='has-sidebar'><p>{}</p>{}</div></body>", "<body><div class='sidebar-right'><article><p>{}</p></article>{}</div></body>",
        "<body><div class='form-page'><p>{}</p></div>{}</body>", "<body><form id='form1'><div><p>{}</p></div>{}</form></body>",
        "<body><div class='sidebar'><main class='widget'><p>{}</p></main></div>{}</body>",
        "<body><main><div class='sidebar'><article><p>{}</p></article>{}</div></main></body>",
    ):
        assert [b.text for b in html_extract.blocks_of("<html>" + page.format(text, menu) + "</html>")] == [text], page
    for header in ("post-header", "entry-header"):
        page = f"<html><body><article><div class='{header}'><h1>Title</h1></div><p>{text}</p></article><form>Sign up</form>{menu}</body></html>"
        assert [b.text for b in html_extract.blocks_of(page)] == ["Title", text]


def test_licenses_equal_brute_force(spark):
    r = random.Random(8)
    pool = "mit license apache general public the of a".split()
    rows = [(i, "".join(r.choice(pool).upper() + r.choice([" ", "-", "\n", "é "]) for _ in range(r.randrange(40)))) for i in range(80)]
    got = {x.doc_id: x for x in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = {(j, label) for p, label in license_scan.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()}
        places = [j for j, _ in at]
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert x.base_labels == ",".join(sorted({label for _, label in at})) and set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""}


def test_passage_with_an_inserted_word(spark):
    text = "x " + "permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files"
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].labels == "mit" and got[0].base_labels == "" and 0.8 <= got[0].score < 1 and got[1].labels == "" and got[1].score == 0


def test_archives(spark, tmp_path):
    big, small = "x" * 1500, "y" * 10
    rows = [(1, "u\r\nv", big), (5, "u", big), (3, None, big), (7, "w", small), (8, "w", small), (9, "n", None), (None, "z", big), (10, "t", "WARC/1.1\r\n\r\nWARC/1.1" * 90 + "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {i: ("revisit", 5) for i in (1, 3, None)}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha1(body).hexdigest()
    records = {r.record_id for r in got.values()}
    assert len(records) == len(got) and all(r.refers_to_record in records for r in got.values() if r.record_type == "revisit")
    assert warc.archive_pages(pages.limit(0)).count() == 0
    twice = pages.unionAll(pages).withColumn("original", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("value", F.lit("v"))
    again = warc.archive_pages(twice)
    assert again.count() == 2 * len(rows) and again.where("record_type = 'revisit'").count() == 6


def test_archives_of_every_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", ((100, 3), (1000, 2), (None, 1)))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    rows = [(i, "u", "z" * (i * 37)) for i in range(60)] + [(100 + i, "v", "z" * 37 * 40) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), "2020-02-02T00:00:00Z")
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, *_ in rows) and {r.date for r in got} == {"2020-02-02T00:00:00Z"}
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {i: 104 for i in (40, 100, 101, 102, 103)}


def test_pipeline_stages(spark, labels):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_parts_of_whole_license_texts(spark):
    parts = license_scan.parts_of(license_scan.TEXTS)
    assert all(license_scan.PART_WORDS <= len(t.split()) < 2 * license_scan.PART_WORDS for _, t in parts)
    assert {label: " ".join(t for x, t in parts if x == label) for label in dict(license_scan.TEXTS)} == dict(license_scan.TEXTS)
    mit = dict(license_scan.TEXTS)["mit"].split()
    rows = [(1, said(50, 1) + " " + " ".join(mit[110:]) + " " + said(20, 2)), (2, " ".join(w for i, w in enumerate(mit) if i % 40 != 7)), (3, " ".join(mit[150:])), (4, said(300, 4)), (5, None)]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "", 4: "", 5: ""}
