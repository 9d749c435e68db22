"""Completed hierarchies, dictionaries, greedy choices, sample graphs, vocabularies, covariances and dumps against plain versions."""

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import dictionary as D
from strandline.operators import encoders as N
from strandline.operators import graph as G
from strandline.operators import greedy as Y
from strandline.operators import hierarchy as H
from strandline.operators import vectors as V
from strandline.plans import catalog, structure_queries
from strandline.sources import readers as R

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def drawn(seed, pid, h, t, below):
    return hashlib.md5(f"{seed}|{pid}|{h}|{t}".encode()).hexdigest()[:8] < below


# --- hierarchies --------------------------------------------------------------------------------------------------

EDGES = [("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("z", "w"), ("q", "y")]
CHILDREN = defaultdict(list)
for _p, _c in EDGES:
    CHILDREN[_p].append(_c)


def tree_and_occs(spark):
    r = random.Random(3)
    occs = sorted({(r.choice("rabxyzwqo"), f"h{r.randrange(12)}", f"t{r.randrange(6)}") for _ in range(300)})
    return spark.createDataFrame(EDGES, "parent string, child string"), spark.createDataFrame(occs, "pid string, h string, t string"), occs


@pytest.mark.parametrize("with_own", [False, True])
def test_bottom_up_completion_goes_level_by_level(spark, with_own):
    edges, occs, own = tree_and_occs(spark)
    sets = defaultdict(set)
    for p, h, t in own:
        sets[p].add((h, t))
    height = {"a": 1, "z": 1, "q": 1, "b": 2, "r": 3}
    held = {p: set(s) for p, s in sets.items() if p not in height}
    for level in (1, 2, 3):
        taken = {}
        for p in (p for p in height if height[p] == level):
            union = set().union(*(held.get(c, set()) for c in CHILDREN[p]))
            taken[p] = {x for x in union if drawn("third", p, *x, "55555555")}
        for p, s in taken.items():
            for c in CHILDREN[p]:
                held[c] = held.get(c, set()) - s
        for p, s in taken.items():
            held[p] = s | (sets[p] if with_own else set())
    got = rows(H.completed_bottom_up(occs, edges, with_own), "pid", "h", "t")
    assert got == sorted((p, *x) for p, s in held.items() for x in s)


def test_top_down_completion_passes_on_what_a_parent_leaves(spark):
    edges, occs, own = tree_and_occs(spark)
    parents = defaultdict(list)
    for p, c in EDGES:
        parents[c].append(p)
    held = defaultdict(set)
    for p, h, t in own:
        todo = [p]
        while todo:
            q = todo.pop()
            held[q].add((h, t))
            todo += parents[q]
    kept, passed = {}, {}
    for p in ("r", "q", "o", "a", "b", "x", "y", "z", "w"):
        may = {x for x in held[p] if all(x in passed[u] for u in parents[p] if held[u])}
        kept[p] = {x for x in may if p not in CHILDREN or drawn("half", p, *x, "80000000")}
        passed[p] = may - kept[p]
    got = rows(H.completed_top_down(occs, edges), "pid", "h", "t")
    assert got == sorted((p, *x) for p, s in kept.items() for x in s)
    assert not kept["r"] & (kept["a"] | kept["b"] | kept["y"] | kept["w"])


def test_cyclic_nodes_take_the_nearest_layer_above(spark):
    edges = [("r", "a"), ("a", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("r", "z"), ("l", "l"), ("l", "m"), ("m", "l")]
    got = {r.node: (r.layer, r.cyclic) for r in G.layers_of_all(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"r": (0, False), "a": (1, False), "x": (2, True), "y": (3, True), "z": (1, True), "l": (0, True), "m": (0, True)}
    chain = [("r", "a"), ("a", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    got = {r.node: r.layer for r in G.layers_of_all(spark.createDataFrame(chain, "src string, dst string")).collect()}
    assert got == {"r": 0, "a": 1, "x": 2, "y": 3, "z": 4}


# --- dictionaries -------------------------------------------------------------------------------------------------


def test_names_are_inverted_with_a_cap(spark):
    names = spark.createDataFrame([("b", " New  York"), ("a", "new york"), ("c", "NEW YORK"), ("d", "The"), ("e", ""), ("f", None), (None, "x"), ("g", "the end")], "id string, name string")
    got = rows(D.inverted_names(names, most_ids=2), "surface", "n", "first", "ids")
    assert got == [("new york", 2, "new", ["a", "b"]), ("the end", 2, "the", ["g"])]
    assert rows(D.inverted_names(names, lower=False, stop_words=[]), "surface") == [("NEW YORK",), ("New York",), ("The",), ("new york",), ("the end",)]
    assert rows(D.inverted_names(names, most_words=1, stop_words=[]), "surface") == [("the",)]


def greedy_by_hand(toks, surfaces):
    places = [(i, i + n, " ".join(toks[i : i + n])) for i in range(len(toks)) for n in range(1, 9) if i + n <= len(toks) and " ".join(toks[i : i + n]) in surfaces]
    taken, at = [], 0
    for i in range(len(toks)):
        here = [p for p in places if p[0] == i]
        if i >= at and here:
            taken.append(max(here, key=lambda p: p[1]))
            at = taken[-1][1]
    return places, taken


def test_longest_leftmost_places_equal_a_reader(spark):
    r = random.Random(7)
    docs = [(i, [r.choice("aAbcd") for _ in range(r.randrange(0, 60))]) for i in range(40)]
    surfaces = {" ".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(25)} - {"a"}
    names = spark.createDataFrame([(s, s) for s in surfaces] + [("a", "a")], "id string, name string")
    held = D.inverted_names(names)
    lists = spark.createDataFrame(docs, "sid long, toks array<string>")
    places = D.dictionary_places(lists, held)
    want = [(i, greedy_by_hand([w.lower() for w in toks], surfaces)) for i, toks in docs]
    assert rows(places, "sid", "start", "end", "surface") == sorted((i, *p) for i, (every, _) in want for p in every)
    assert rows(D.longest_leftmost(places), "sid", "start", "end", "surface") == sorted((i, *p) for i, (_, taken) in want for p in taken)
    cover = {i: sum(b - a for a, b, _ in taken) - sum(w.lower() == "a" for a, b, _ in taken for w in toks[a:b]) for (i, (_, taken)), (_, toks) in zip(want, docs)}
    assert {r.sid: r.covered for r in D.covered_share(lists, D.longest_leftmost(places)).collect()} == cover
    said = {p[2] for _, (every, _) in want for p in every}
    assert rows(D.not_found(held, places), "surface") == sorted((s,) for s in surfaces - said)


def test_places_are_found_across_stretches_and_lists_once(spark):
    words = [f"w{i % 7}" for i in range(3 * D.STRETCH + 1)]
    names = [("a", " ".join(words[i : i + n])) for i, n in ((0, 1), (3, 2), (5, 33), (1, 70), (0, 97), (0, 98))]
    lists = spark.createDataFrame([(1, words), (2, []), (3, None), (4, words[:32]), (5, words[:33]), (6, ["w0", None, "W1"])], "sid long, toks array<string>")
    surfaces = {x for _, x in names}
    want = [(i, a, b, " ".join(t[a:b])) for i, t in ((1, words), (4, words[:32]), (5, words[:33])) for a in range(len(t)) for b in range(a + 1, len(t) + 1) if " ".join(t[a:b]) in surfaces]
    got = D.dictionary_places(lists, D.inverted_names(spark.createDataFrame(names, "id string, name string")))
    assert rows(got, "sid", "start", "end", "surface") == sorted([*want, (6, 0, 1, "w0")])
    plan = catalog.queries()["dictionary_places"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_places_with_case_are_found_by_it(spark):
    names = spark.createDataFrame([("a", "New York"), ("b", "new york"), ("c", "New")], "id string, name string")
    lists = spark.createDataFrame([(1, ["New", "York", "new", "york", "NEW"]), (2, [])], "sid long, toks array<string>")
    got = D.dictionary_places(lists, D.inverted_names(names, lower=False), lower=False)
    assert rows(got, "sid", "start", "end", "surface") == [(1, 0, 1, "New"), (1, 0, 2, "New York"), (1, 2, 4, "new york")]


def test_sentences_of_names_are_capped(spark):
    places = spark.createDataFrame([(1, 0, 1, ["x", "y"]), (1, 70, 72, ["x"]), (2, 0, 1, ["x"])], "sid long, start long, end long, ids array<string>")
    sentences = spark.createDataFrame([(1, 0, 0, 65), (1, 1, 65, 140), (2, 0, 0, 3)], "sid long, sent long, start long, end long")
    assert rows(D.first_sentences(places, sentences, 2), "id", "sid", "sent") == [("x", 1, 0), ("x", 1, 1), ("y", 1, 0)]


def unfolded_by_hand(topic, links, places):
    """One article: entities are expanded one by one, the found one that stands first and wasn't expanded next."""
    entities, checked, out, now, behind = {}, set(), [(topic, 0, None, None)], topic, 0
    while True:
        checked.add(now)
        entities.pop(now, None)
        for e in links[now]:
            found = [p for p in places[e] if p[0] >= behind]
            if found and e not in checked:
                entities[e] = min(found)
        if not entities:
            return out
        now = min(entities, key=lambda e: (entities[e], e))
        behind = entities[now][1]
        out.append((now, len(out), *entities[now]))


def test_topic_graphs_equal_a_plain_loop(spark):
    r = random.Random(5)
    names = [f"e{i}" for i in range(9)]
    links = sorted({(r.choice(names), r.choice(names)) for _ in range(30)})
    near = defaultdict(list)
    for a, b in links:
        if a != b:
            near[a].append(b)
    places, topics, want = [], [], []
    for sid in range(12):
        own = defaultdict(list)
        for _ in range(r.randrange(0, 15)):
            e, at = r.choice(names), r.randrange(100)
            own[e].append((at, at + r.randrange(1, 3)))
            places.append((sid, e, *own[e][-1]))
        topics.append((sid, r.choice(names)))
        want += [(sid, *x) for x in unfolded_by_hand(topics[-1][1], near, own)]
    got = D.topic_graphs(spark.createDataFrame(topics, "sid long, id string"), spark.createDataFrame(links, "id string, other string"), spark.createDataFrame(places, "sid long, id string, start long, end long"))
    assert sorted(map(str, rows(got, "sid", "id", "round", F.coalesce("start", F.lit(-1)), F.coalesce("end", F.lit(-1))))) == sorted(str((s, e, n, -1 if a is None else a, -1 if b is None else b)) for s, e, n, a, b in want)


def test_topic_query_equals_a_plain_loop(spark):
    topics, links, places = structure_queries._topics(spark, SMALL)
    near, own = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for r in links.collect():
        near[r.id].append(r.other)
    for r in places.collect():
        own[r.sid][r.id].append((r.start, r.end))
    want = [(r.sid, e, n) for r in topics.collect() for e, n, *_ in unfolded_by_hand(r.id, near, own[r.sid])]
    assert rows(catalog.queries()["topic_graphs"](spark, SMALL), "sid", "id", "round") == sorted(want)


def test_a_surface_of_many_items_unfolds_to_all_of_them(spark, tmp_path):
    """Of 250 items with the name of three words, B2 is not among the first hundred, and is the topic's neighbour."""
    spark.range(2000).select(F.col("id").alias("item_id"), F.lit("so so so so so so so so").alias("text")).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "so so so"), (2, "so")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(catalog.queries()["topic_graphs"](spark, str(tmp_path)), "sid", "id", "round") == [(1, "B1", 0), (1, "B2", 1)]
    # A place stands once, however many items it names.
    assert structure_queries._unfolded(spark, str(tmp_path))[2].count() == 3


def test_topics_match_texts_once_and_write_a_round_once(spark, monkeypatch):
    topics, _, places = structure_queries._topics(spark, SMALL)
    assert not any("regexp" in df._jdf.queryExecution().optimizedPlan().toString() for df in (topics, places))
    written = []
    monkeypatch.setattr(D, "checkpointed", lambda df: written.append(df) or df.checkpoint())
    chain = [(f"e{i}", f"e{i + 1}") for i in range(6)]
    got = D.topic_graphs(spark.createDataFrame([(1, "e0"), (2, None)], "sid long, id string"), spark.createDataFrame(chain, "id string, other string"), spark.createDataFrame([(1, f"e{i}", i, i + 1) for i in range(7)], "sid long, id string, start long, end long"))
    assert rows(got.where("sid = 1"), "id", "round") == [(f"e{i}", i) for i in range(7)] and got.where("sid = 2").count() == 1
    assert len(written) <= 3 + 2 * 7


# --- greedy choices -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_easy_siblings_equal_the_greedy_pass(spark, seed):
    """Five hundred relations, with equal scores and chains of nearest ones."""
    r = random.Random(seed)
    pids = [f"P{i:03d}" for i in range(500)]
    label = {p: r.randrange(6) for p in pids}
    scores = [(a, b, r.randrange(50) / 50) for a in pids for b in r.sample(pids, 8) if a != b]
    siblings = [(a, b) for a in pids for b in pids if a != b and label[a] == label[b]]
    near = {}
    for a, b, s in scores:
        if a not in near or (-s, b) < near[a]:
            near[a] = (-s, b)
    test, train = set(), set()
    for s, a, b in sorted((s, a, b) for a, (s, b) in near.items() if label[a] == label[b]):
        if a not in train and b not in test:
            test.add(a)
            train.add(b)
    train |= {b for a, b in siblings if a in test and b not in test}
    got = Y.easy_siblings(spark.createDataFrame(scores, "p1 string, p2 string, score double"), spark.createDataFrame(siblings, "a string, b string"))
    assert rows(got, "pid", "split") == sorted([(p, "test") for p in test] + [(p, "train") for p in train]) and len(test) > 20
    halves = Y.with_dev_half(got)
    assert halves.where("split = 'dev'").count() == len(test) // 2 and halves.where("split = 'train'").count() == len(train)


def test_independent_sets_on_any_graph(spark):
    r = random.Random(9)
    order = list(range(80))
    r.shuffle(order)
    edges = {(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(150)) if a != b}
    edges |= {(b, a) for a, b in edges}
    taken = set()
    for n in sorted(range(80), key=order.__getitem__):
        if not any((n, t) in edges for t in taken):
            taken.add(n)
    got = Y.first_independent_set(spark.createDataFrame(list(enumerate(order)), "node int, order int"), spark.createDataFrame(sorted(edges), "a int, b int"))
    assert rows(got, "node", "taken") == sorted((n, n in taken) for n in range(80))
    assert Y.first_independent_set(spark.createDataFrame([], "node int, order int"), spark.createDataFrame([], "a int, b int")).count() == 0


def test_hard_members_and_swaps(spark):
    means = spark.createDataFrame([("g", [1.0, 0.0]), ("g_1", [0.9, 0.1]), ("g_2", [0.5, 0.5]), ("g_3", [0.0, 1.0])], "pid string, vec array<double>")
    groups = spark.createDataFrame([("g", p) for p in ("g", "g_1", "g_2", "g_3")], "grp string, pid string")
    took = lambda m: rows(V.central_member(means, groups, m), "pid")[0][0]
    assert (took("min"), took("top_1"), took("middle"), took("top_9")) == ("g_3", "g", "g_1", "g_2")
    assert took("random") == min(("g", "g_1", "g_2", "g_3"), key=lambda p: hashlib.md5(f"1|g|{p}".encode()).hexdigest())
    with pytest.raises(ValueError):
        V.central_member(means, groups, "other")
    edges = spark.createDataFrame([("r", "g"), ("g", "g_1"), ("g", "g_3"), ("g_3", "u"), ("s", "g"), ("s", "k")], "parent string, child string")
    pairs = spark.createDataFrame([("g", "g_3"), ("k", "k")], "a string, b string")
    assert rows(V.swapped(edges, pairs), "parent", "child") == [("g", "u"), ("g_3", "g"), ("g_3", "g_1"), ("r", "g_3"), ("s", "g_3"), ("s", "k")]


def test_covariances_equal_numpy(spark):
    r = np.random.default_rng(2)
    x = {p: r.normal(1000, 3, size=(n, 5)) for p, n in (("a", 40), ("b", 2), ("c", 1))}
    data = [(p, [float(v) for v in row]) for p, m in x.items() for row in m] + [("a", None), (None, [1.0] * 5), ("a", [1.0, None, 1.0, 1.0, 1.0])]
    got = V.covariances(spark.createDataFrame(data, "pid string, vec array<double>").repartition(3)).collect()
    assert len(got) == 75
    for g in got:
        assert g.n == len(x[g.pid]) and g.mean_i == pytest.approx(x[g.pid][:, g.i].mean())
        assert g.covariance is None if g.pid == "c" else g.covariance == pytest.approx(np.cov(x[g.pid], rowvar=False)[g.i, g.j])
    assert V.covariances(spark.createDataFrame([], "pid string, vec array<double>")).count() == 0


# --- samples and vocabularies -------------------------------------------------------------------------------------

OCCS = [("s1", "P", 0, "h1", "t1"), ("s1", "P", 1, "h2", "t1"), ("s2", "Q", 0, "t1", "h1")]
TRIPLES = [("h1", "P", "t1"), ("h1", "Q", "o"), ("t1", "R", "h2"), ("h2", "Q", "o"), ("h1", "Q", "o")]


def encoded_by_hand(kind, pid, occs):
    """Numbers by first use, in the order in which a reader adds edges."""
    number, edges = {}, defaultdict(set)
    ind = lambda x: number.setdefault(x, len(number))
    ind(N.GATHER if kind == "property" else pid)
    around = defaultdict(list)
    for h, r, t in sorted(set(TRIPLES)):
        around[h].append((h, r, t))

    def add(k, a, b):
        edges[k].add((ind(a), ind(b)))

    for h, t in occs:
        if kind == "one":
            add("one", h, pid), add("one", pid, t)
        elif kind == "bow":
            add("head", h, pid), add("tail", t, pid)
        elif kind == "property":
            add(N.GATHER, h, N.GATHER), add(N.GATHER, t, N.GATHER), add(pid, h, t)
        for side, e in (("head", h), ("tail", t)):
            for a, r, b in around[e]:
                if kind == "one":
                    add("one", a, r), add("one", r, b)
                elif kind == "property":
                    add(r, a, b)
                elif r != pid:
                    add(side if kind == "only_property" else f"{side}_other", r, pid)
                    if kind == "bow":
                        add(f"{side}_other", b, pid)
    return number, edges


@pytest.mark.parametrize("kind", N.KINDS)
def test_sample_graphs_number_nodes_by_first_use(spark, kind):
    occs = spark.createDataFrame(OCCS, "sample string, pid string, pos int, h string, t string")
    triples = spark.createDataFrame(TRIPLES, "h string, r string, t string")
    samples = spark.createDataFrame([("s1", "P", "b", 0), ("s2", "Q", "b", 1)], "sample string, pid string, batch string, number int")
    edges = N.sample_edges(occs, triples, kind)
    nodes = N.sample_nodes(samples, edges, kind)
    (n1, e1), (n2, e2) = encoded_by_hand(kind, "P", [("h1", "t1"), ("h2", "t1")]), encoded_by_hand(kind, "Q", [("t1", "h1")])
    assert rows(nodes, "sample", "id", "ind") == sorted([("s1", *x) for x in n1.items()] + [("s2", *x) for x in n2.items()])
    offsets = N.batch_offsets(samples, nodes)
    assert rows(offsets, "sample", "size", "offset") == [("s1", len(n1), 0), ("s2", len(n2), len(n1))]
    want = [("b", k, a, b) for k, s in e1.items() for a, b in s] + [("b", k, a + len(n1), b + len(n1)) for k, s in e2.items() for a, b in s]
    assert rows(N.packed_edges(edges, nodes, offsets), "batch", "kind", "src", "dst") == sorted(want)


def test_rare_ids_become_the_fill(spark):
    occs = spark.createDataFrame(OCCS[:1], "sample string, pid string, pos int, h string, t string")
    edges = N.sample_edges(occs, spark.createDataFrame(TRIPLES[:2], "h string, r string, t string"), "bow", spark.createDataFrame([("h1",)], "id string"))
    assert rows(edges.select("kind", "src", "dst").distinct(), "kind", "src", "dst") == [("head", "h1", "P"), ("head_other", N.PAD, "P"), ("tail", N.PAD, "P")]
    with pytest.raises(ValueError):
        N.sample_edges(occs, edges, "none")


def test_vocabulary_by_first_appearance(spark):
    docs = {5: "b a b", 900: "c a <UNK>", 301: "d b e", 2: "a"}
    tokens = spark.createDataFrame([(s, i, w) for s, t in docs.items() for i, w in enumerate(t.split())] + [(7, 0, None)], "sid long, pos int, tok string")
    vocab = N.vocabulary(tokens)
    assert {r.tok: r.ind for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3, "d": 4, "e": 5, "c": 6}
    dev = spark.createDataFrame([(1, 0, "c"), (1, 1, "zz"), (1, 2, "a")], "sid long, pos int, tok string")
    assert rows(N.encoded_tokens(dev, vocab), "pos", "ind") == [(0, 6), (1, 1), (2, 2)]
    assert rows(N.encoded_tokens(dev, vocab, None), "pos", "ind") == [(0, 6), (2, 2)]


# --- dumps --------------------------------------------------------------------------------------------------------


def test_dumps_name_their_columns(spark, tmp_path):
    text = "-- x\nCREATE TABLE `page` (\n  `id` int,\n  `ns` int,\n  `title` text,\n  PRIMARY KEY (`id`),\n  KEY `no` (`ns`)\n);\nINSERT INTO `page` VALUES (1,0,'a,b'),(2,0,'it\\'s (x)'),(3,1,'c'),(4,0);\n"
    text += "INSERT INTO `page` VALUES (5,0,'d'),((6,'e);\nCREATE TABLE `other` (\n  `z` int\n);\n"
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write(text)
    path = str(tmp_path / "d.sql.gz")
    assert R.dump_columns(spark, path) == ["id", "ns", "title"]
    assert rows(R.read_dump(spark, path, keep={"ns": "0"}), "id", "title") == [("1", "a,b"), ("2", "it's (x)"), ("5", "d")]
    # (4,0) and (6,'e) have two fields, and a bracket is left over.
    assert tuple(R.dump_faults(spark, path).first()) == (6, 2, 1)
    (tmp_path / "none.sql").write_text("INSERT INTO `x` VALUES (1);\n")
    with pytest.raises(ValueError):
        R.dump_columns(spark, str(tmp_path / "none.sql"))


def test_last_lines_are_those_of_the_last_file(spark, tmp_path):
    """A long file that comes first by name is read in later tasks than a short one."""
    (tmp_path / "a.tsv").write_text("k\told\n" + "x\ty\n" * 200_000)
    (tmp_path / "b.tsv").write_text("k\tnew\n")
    got = {r.key: r.val for r in R.read_map(spark, str(tmp_path)).collect()}
    assert got == {"k": "new", "x": "y"}

# --- work that grows with the input alone -------------------------------------------------------------------------


@pytest.mark.parametrize("complete", [H.completed_bottom_up, H.completed_top_down])
def test_completions_write_plans_not_pairs(spark, monkeypatch, complete):
    """What is written on the way is as long as the hierarchy and its sets of nodes, however many pairs there are."""
    written, write = [], H.checkpointed
    monkeypatch.setattr(H, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    edges, _, _ = tree_and_occs(spark)
    occs = spark.range(500).select(F.lit("y").alias("pid"), F.concat(F.lit("h"), F.col("id")).alias("h"), F.lit("t").alias("t"))
    assert complete(occs, edges).select("h", "t").distinct().count() == 500
    assert max(df.count() for df in written) < 50


@pytest.mark.parametrize("kind", N.KINDS)
def test_packed_samples_in_one_go(spark, monkeypatch, kind):
    """Batches are packed as by edges, nodes and offsets one after the other, with nothing written."""
    batches = spark.createDataFrame([("s1", "b", 0), ("s2", "b", 1)], "sample string, batch string, number int")
    occs = spark.createDataFrame(OCCS, "sample string, pid string, pos int, h string, t string").join(batches, "sample")
    occs = occs.withColumn("pos", F.row_number().over(Window.partitionBy("sample").orderBy("pos")) - 1)
    triples = spark.createDataFrame(TRIPLES, "h string, r string, t string")
    (n1, e1), (n2, e2) = encoded_by_hand(kind, "P", [("h1", "t1"), ("h2", "t1")]), encoded_by_hand(kind, "Q", [("t1", "h1")])
    want = [("b", k, a, b) for k, s in e1.items() for a, b in s] + [("b", k, a + len(n1), b + len(n1)) for k, s in e2.items() for a, b in s]
    assert rows(N.packed_samples(occs, triples, kind), "batch", "kind", "src", "dst") == sorted(want)
    assert rows(N.sample_offsets(occs, triples, kind), "sample", "size", "offset") == [("s1", len(n1), 0), ("s2", len(n2), len(n1))]
    written, write = [], structure_queries.checkpointed
    monkeypatch.setattr(structure_queries, "checkpointed", lambda df: written.append(df) or write(df))
    catalog.queries()[f"graph_{kind}"](spark, SMALL)
    assert not written


@pytest.mark.parametrize("kind", N.KINDS)
def test_edges_of_samples_are_not_dealt(spark, kind):
    """A head with more triples than go in a packed row, and repeats: graphs are as by single steps, without a window or an aggregate over edges."""
    n = 2 * N.PACKED + 3
    triples = spark.createDataFrame([("h1", "ab"[i % 2], f"x{i % n}") for i in range(n + 50)] + [("t1", "P", "h1"), ("t2", "c", "x1")], "h string, r string, t string")
    occs = spark.createDataFrame([("s1", "b", 0, "P", 0, "h1", "t1"), ("s1", "b", 0, "P", 1, "h1", "t2"), ("s2", "b", 1, "P", 0, "t2", "none"), ("s3", "c", 2, "a", 0, "t1", "h1")], "sample string, batch string, number int, pid string, pos int, h string, t string")
    edges = N.sample_edges(occs, triples, kind)
    nodes = N.sample_nodes(occs.select("sample", "pid"), edges, kind)
    offsets = N.batch_offsets(occs.select("sample", "batch", "number").distinct(), nodes)
    got, sizes = N.packed_samples(occs, triples, kind), N.sample_offsets(occs, triples, kind)
    assert rows(got, "batch", "kind", "src", "dst") == rows(N.packed_edges(edges, nodes, offsets), "batch", "kind", "src", "dst")
    assert rows(sizes, "sample", "batch", "size", "offset") == rows(offsets, "sample", "batch", "size", "offset")
    for made in (got, sizes):
        assert not any(x in made._jdf.queryExecution().optimizedPlan().toString() for x in ("Window", "Aggregate", "Join"))


def test_a_null_tail_is_a_node_without_edges(spark):
    triples = spark.createDataFrame([("h", "r", None), ("h", "r", "x")], "h string, r string, t string")
    occs = spark.createDataFrame([("s", "b", 0, "P", 0, "h", "t")], "sample string, batch string, number int, pid string, pos int, h string, t string")
    assert rows(N.packed_samples(occs, triples, "bow"), "kind", "src", "dst") == [("head", 1, 0), ("head_other", 3, 0), ("head_other", 4, 0), ("tail", 2, 0)]
    assert rows(N.sample_offsets(occs, triples, "bow"), "size") == [(6,)]
