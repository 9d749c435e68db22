"""N-gram Jaccard join: a token-group matrix over word shingles, bounds of query against group, exact verification and link components.

Every text is its set of 64-bit shingle hashes, and equal sets are one class. Of a class only the first tokens in a common order, rare
ones first, need to meet those of another: two sets of n and m tokens that share o or more have their first l common tokens among the
first n - o + l of the one and the first m - o + l of the other, for any l up to o. Here l is a twentieth of the smaller set, so a
passage that many texts quote doesn't bring them together. Classes with too few met tokens leave at this point; most do.

The rest are partitioned into groups of similar texts: by the token of theirs that most classes have, then by whether they link to
that token's leader, the class with most met tokens, are near it, or are unlike it, and then look for another leader. A group holds its
token union, with a bit a member for each token. Groups that link to one leader are a family, which is connected, and stands in the
token-group matrix as one column. Pairs of columns that meet
often enough are opened group by group: a member is a query against the other group's union, and only where its overlap with the
union reaches what a link needs, the members' bits are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, components, join_group_facts, maybe_broadcast, mix64, portions, shared_checkpoint, shingle_sets, text_of

WORDS_IN_SHINGLE, PERCENT = 5, 80
#: Tokens that two linked sets have in common early on, as a share of the smaller set (in per cent); prefixes are longer by as much.
MET_PERCENT = 5
#: Members of a group at most: a bit each.
GROUP_ROWS = 64
#: Similarity to a leader from which texts that don't link to it share groups, as a fraction. Others find another leader, themselves in the end.
NEAR = (1, 2)
#: Tokens of the sets that are grouped in one task, about, and ids that may be broadcast to fetch those sets.
PART_TOKENS, BROADCAST_IDS = 250_000, 200_000
#: Tokens counted in this many documents or more come last in the common order; the most frequent ones are sent to the tasks.
FREQUENT_FROM, FREQUENT_TOKENS = 16, 1 << 18
#: Tokens a task gathers before it passes them on, tokens of a block of the prefixes, about, and documents beyond which a token has several blocks.
WINDOW_TOKENS, BLOCK_TOKENS, DEALT_FROM = 500_000, 1_000_000, 20_000
_LOW = np.uint64(0xFFFFFFFF)
_WIDE = np.uint64(32)


def needed_overlap(n, m, percent: int = PERCENT):
    """The least intersection of sets of n and m tokens with 100 * intersection >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def met_tokens(n: int) -> int:
    """How many of their first common tokens linked sets are held to; n is the size of the smaller one."""
    return n * MET_PERCENT // 100 + 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that can be among the first `met_tokens` common ones with any set that links to it."""
    return min(n, n + (-percent * n) // 100 + met_tokens(n))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sizes, 64-bit signatures and 128-bit names of some sets; zeros for empty ones."""
    n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    both = np.zeros((len(sets), 2), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        with np.errstate(over="ignore"):
            both[some, 0] = mix64(np.add.reduceat(mix64(flat, 21), at) + n[some].astype(np.uint64), 23)
            both[some, 1] = np.add.reduceat(mix64(flat, 22), at)
    return n, both[:, 0].copy(), [x.tobytes() for x in both]


def _skeleton(k: int):
    """Of each row its ids, the size and the names of its set; and, of every so many tokens of a task, those met repeatedly."""
    names = ["rid", "doc_id", "tie", "n", "cls", "cid", "tokens", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: list[np.ndarray] = []
        held = 0

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(window), return_counts=True)
            token, count = token[count > 2], count[count > 2]
            none = [pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.binary())]
            return pa.record_batch([*none, pa.array([token.tobytes()], pa.binary()), pa.array([count.astype(np.int64).tobytes()], pa.binary())], names)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions(texts):
                sets = shingle_sets(texts[a:b], k)
                n, cls, cid = _signatures(sets)
                ids = [batch.column(c).slice(a, b - a) for c in ("rid", "doc_id", "tie")]
                yield pa.record_batch([*ids, pa.array(n), pa.array(_signed(cls)), pa.array(cid, pa.binary()), pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.binary())], names)
                window += sets
                held += int(n.sum())
                if held > WINDOW_TOKENS:
                    yield frequent()
                    window, held = [], 0
        if held:
            yield frequent()

    return run


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.record_batch({"token": pa.array(np.frombuffer(t, dtype=np.int64)), "count": pa.array(np.frombuffer(c, dtype=np.int64))})


class Frequent:
    """The most frequent tokens with their counts, and the place of each in the order of ascending counts. They only order tokens."""

    def __init__(self, token: np.ndarray, count: np.ndarray):
        order = np.argsort(token)
        self.token, self.count = token[order], count[order]
        self.rank = np.empty(len(token), dtype=np.int64)
        self.rank[np.lexsort((self.token, self.count))] = np.arange(len(token))

    def prefix(self, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The set's first tokens in the common order, infrequent ones by hash and then frequent ones by count, with the latter's counts or 0."""
        k = prefix_length(len(tokens), percent)
        if not len(self.token):
            return tokens[:k], np.zeros(min(k, len(tokens)), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        often = self.token[at] == tokens
        rare, at = tokens[~often][:k], at[often]
        at = at[np.argsort(self.rank[at])][: k - len(rare)]
        return np.concatenate([rare, self.token[at]]), np.concatenate([np.zeros(len(rare), dtype=np.int64), self.count[at]])


def _frequent_tokens(skeleton: DataFrame) -> Frequent:
    """Those counted in FREQUENT_FROM documents, FREQUENT_TOKENS at most, whatever the input's size."""
    counted = skeleton.where("rid is null and tokens is not null").select("tokens", "counts").mapInArrow(_token_counts, "token long, count long")
    most = counted.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT_FROM).orderBy(F.desc("count"), "token").limit(FREQUENT_TOKENS)
    found = most.toArrow()
    token, count = (np.array(found.column(c).combine_chunks(), dtype=np.int64) for c in ("token", "count"))
    return Frequent(token.view(np.uint64), count)


def _prefix_blocks(frequent, buckets: int, dealt_from: int, k: int, percent: int):
    """Tokens of the prefixes in blocks by hash; those of more than `dealt_from` documents go to several blocks by class, all apart from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def blocks() -> pa.RecordBatch:
            token, count, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            deals = (count // dealt_from + 1).astype(np.uint64)
            own = token % np.uint64(buckets)
            bucket = np.where(deals > 1, np.uint64(buckets) + (own + cls % deals * np.uint64(97)) % np.uint64(buckets), own)
            place = (bucket << _WIDE) | (token >> _WIDE)
            order = np.lexsort((cls, place))
            place, cls, deals = place[order], cls[order], deals[order]
            new = np.append(True, (place[1:] != place[:-1]) | (cls[1:] != cls[:-1]))
            place, cls, deals = place[new], cls[new], deals[new]
            bucket = (place >> _WIDE).astype(np.int64)
            first = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
            cuts = list(zip(first, np.append(first[1:], len(bucket)), strict=True))
            token = (place & _LOW).astype(np.uint32)
            return pa.record_batch(
                {
                    "bucket": pa.array(bucket[first]),
                    "tokens": pa.array([token[a:b].tobytes() for a, b in cuts], pa.binary()),
                    "classes": pa.array([cls[a:b].tobytes() for a, b in cuts], pa.binary()),
                    "deals": pa.array([deals[a:b].astype(np.int64).tobytes() if bucket[a] >= buckets else None for a, b in cuts], pa.binary()),
                }
            )

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in portions(texts):
                sets = shingle_sets(texts[a:b], k)
                n, cls, _ = _signatures(sets)
                for i in np.flatnonzero(n):
                    token, count = frequent.value.prefix(sets[i], percent)
                    held.append((token, count, np.full(len(token), cls[i], dtype=np.uint64)))
                    size += len(token)
                if size > WINDOW_TOKENS:
                    yield blocks()
                    held, size = [], 0
        if size:
            yield blocks()

    return run


def _met_in_block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class in a block: how many of its tokens another class has too, the sum of those tokens' classes, and the token with most classes.

    Of tokens with several blocks each holds its share of the classes, and all tokens count.
    """
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for t, c, m in zip(*(batch.column(x).to_pylist() for x in ("tokens", "classes", "deals")), strict=True):
            token = np.frombuffer(t, dtype=np.uint32)
            held.append((token, np.frombuffer(c, dtype=np.uint64), np.frombuffer(m, dtype=np.int64) if m is not None else np.ones(len(token), dtype=np.int64)))
    token, cls, deals = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((cls, token))
    token, cls, deals = token[order], cls[order], deals[order]
    new = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
    token, cls, deals = token[new], cls[new], deals[new]
    first = np.append(True, token[1:] != token[:-1])
    count = np.diff(np.append(np.flatnonzero(first), len(token)))[np.cumsum(first) - 1]
    met = (count > 1) | (deals > 1)
    name = np.where(deals > 1, -1 - token.astype(np.int64), token.astype(np.int64) + (int(key[0].as_py()) << 32))[met]
    cls, count = cls[met], (count * deals)[met]
    order = np.lexsort((name, count, cls))
    name, cls, count = name[order], cls[order], count[order]
    first = np.flatnonzero(np.append(True, cls[1:] != cls[:-1])) if len(cls) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(cls)) - 1 if len(cls) else first
    sums = np.append(0, np.cumsum(count))
    columns = {"cls": _signed(cls[first]), "met": last - first + 1, "known": sums[last + 1] - sums[first], "count": count[last], "token": name[last]}
    yield pa.record_batch({c: pa.array(v.astype(np.int64)) for c, v in columns.items()})


def _set_rows(k: int):
    """The sets of the wanted classes, one row for each part that needs them."""
    names = ["part", "cid", "key", "leads", "guest", "spread", "n", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted, parts, home = (batch.column(c).to_pylist() for c in ("text", "cid", "parts", "home"))
            for a, b in portions(texts):
                sets = shingle_sets(texts[a:b], k)
                n, _, cid = _signatures(sets)
                # Rows that repeat an id may have other sets.
                rows = [(i, p) for i in range(a, b) if cid[i - a] == wanted[i] for p in parts[i]]
                if rows:
                    pick = pa.array([i for i, _ in rows])
                    yield pa.record_batch(
                        [
                            pa.array([p for _, p in rows], pa.int64()), *(batch.column(c).take(pick) for c in ("cid", "key", "leads")),
                            pa.array([p != home[i] for i, p in rows]), batch.column("spread").take(pick),
                            pa.array([int(n[i - a]) for i, _ in rows], pa.int64()), pa.array([sets[i - a].tobytes() for i, _ in rows], pa.binary()),
                        ],
                        names,
                    )

    return run


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    common = _common(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def around_leader(leader: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Of each set: 2 if it links to the leader, 1 if it is half as similar or more, else 0."""
    out = []
    for s in sets:
        if min(len(s), len(leader)) * NEAR[1] < NEAR[0] * max(len(s), len(leader)):
            out.append(0)
            continue
        common = _common(leader, s)
        union = len(leader) + len(s) - common
        out.append(2 if 100 * common >= percent * union else int(common * NEAR[1] >= NEAR[0] * union))
    return out


def token_union(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted union of at most GROUP_ROWS sets, and for each token a bit a set."""
    if len(sets) == 1:
        return sets[0], np.ones(len(sets[0]), dtype=np.uint64)
    union, place = np.unique(np.concatenate(sets), return_inverse=True)
    masks, at = np.zeros(len(union), dtype=np.uint64), 0
    for j, s in enumerate(sets):
        masks[place[at : at + len(s)]] |= np.uint64(1 << j)
        at += len(s)
    return union, masks


def _bits(masks: np.ndarray, members: np.ndarray) -> Iterator[np.ndarray]:
    """0-1 matrices of members by tokens, for some tokens after the other."""
    for i in range(0, len(masks), 1 << 14):
        yield ((masks[None, i : i + (1 << 14)] >> members.astype(np.uint64)[:, None]) & np.uint64(1)).astype(np.float32)


def open_groups(x: tuple, y: tuple, percent: int) -> list[tuple[int, int]]:
    """Linked members of two groups, each a (sizes, union, masks).

    A member is first held against the other group's union: to link to any set it has to share `percent` of its own tokens.
    """
    (n, union, masks), (m, other, others) = x, y
    at = np.minimum(np.searchsorted(other, union), len(other) - 1)
    common = other[at] == union
    masks, others = masks[common], others[at[common]]
    if not len(masks):
        return []
    rows, columns = np.arange(len(n)), np.arange(len(m))
    for _ in range(2):
        rows = rows[sum(a.sum(axis=1, dtype=np.int64) for a in _bits(masks, rows)) * 100 >= percent * n[rows]]
        masks, others, rows, columns, n, m = others, masks, columns, rows, m, n
    if not len(rows) or not len(columns):
        return []
    shared = sum((a @ b.T).astype(np.int64) for a, b in zip(_bits(masks, rows), _bits(others, columns), strict=True))
    i, j = np.nonzero(100 * shared >= percent * (n[rows][:, None] + m[columns][None, :] - shared))
    return list(zip(rows[i].tolist(), columns[j].tolist(), strict=True))


def _forest(pairs: list[tuple]) -> list[tuple]:
    """Pairs that connect what all of them connect."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


_GROUP = "grp long, fam long, node binary, low long, high long, cids binary, sizes binary, tokens binary, masks binary, ptokens binary, pplaces binary, links binary"


def _built(frequent, percent: int):
    """Groups of the sets of a part, with their token unions, prefixes and inner links (pairs of names)."""

    def group(members: list[tuple[bytes, np.ndarray]], node: bytes | None, low: int | None = None, high: int | None = None) -> tuple:
        sizes = np.array([len(s) for _, s in members], dtype=np.int64)
        union, masks = token_union([s for _, s in members])
        links: list[tuple[bytes, bytes]] = []
        if node is None and len(members) > 1:
            shared = open_groups((sizes, union, masks), (sizes, union, masks), percent)
            links = _forest([(members[i][0], members[j][0]) for i, j in shared if i < j])
        first = [frequent.value.prefix(s, percent)[0] for _, s in members]
        places = np.concatenate([np.arange(len(p), dtype=np.int32) for p in first])
        ptokens, at = np.unique(np.concatenate(first), return_inverse=True)
        least = np.full(len(ptokens), np.iinfo(np.int32).max, dtype=np.int32)
        np.minimum.at(least, at, places)
        grp = int.from_bytes(members[0][0][:8], "little", signed=True)
        fam = int.from_bytes(node[:8], "little", signed=True) if node is not None else grp
        blobs = (sizes.tobytes(), union.tobytes(), b"" if len(members) == 1 else masks.tobytes(), ptokens.tobytes(), least.tobytes())
        return (grp, fam, node, low or int(sizes.min()), high or int(sizes.max()), b"".join(c for c, _ in members), *blobs, b"".join(a + b for a, b in links))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "cid", "leads", "guest", "spread", "tokens")), strict=True):
                by_key.setdefault(row[0], []).append(row[1:])
        out = []
        for rows in by_key.values():
            sets = {cid: np.frombuffer(t, dtype=np.uint64) for cid, *_, t in rows}
            rest = sorted({cid for cid, _, guest, *_ in rows if not guest}, key=lambda c: (len(sets[c]), c))
            leader = next((cid for cid, leads, *_ in rows if leads), None)
            # A family of several parts has the bounds that its leader's size sets, the same in every part.
            n = len(sets[leader]) if leader is not None else 0
            bounds = (-((-percent * n) // 100), n * 100 // percent) if rows[0][3] else None
            while rest:
                head = leader if leader is not None else rest[len(rest) // 2]
                kinds = around_leader(sets[head], [sets[c] for c in rest], percent)
                linked, near, rest = ([c for c, k in zip(rest, kinds, strict=True) if k == kind] for kind in (2, 1, 0))
                own = bounds or (len(sets[linked[0]]), len(sets[linked[-1]])) if linked else None
                for i in range(0, len(linked), GROUP_ROWS):
                    out.append(group([(c, sets[c]) for c in linked[i : i + GROUP_ROWS]], head, *own))
                for i in range(0, len(near), GROUP_ROWS):
                    out.append(group([(c, sets[c]) for c in near[i : i + GROUP_ROWS]], None))
                leader = bounds = None
        for i in range(0, len(out), 200):
            columns = list(zip(*out[i : i + 200], strict=True))
            kinds = [x.split(" ") for x in _GROUP.split(", ")]
            yield pa.record_batch([pa.array(c, pa.int64() if t == "long" else pa.binary()) for c, (_, t) in zip(columns, kinds, strict=True)], [x for x, _ in kinds])

    return run


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fam, low, high, t, p in zip(*(batch.column(c).to_pylist() for c in ("fam", "low", "high", "ptokens", "pplaces")), strict=True):
            token = np.frombuffer(t, dtype=np.int64)
            same = [pa.array(np.full(len(token), v)) for v in (fam, low, high)]
            yield pa.record_batch([pa.array(token), *same, pa.array(np.frombuffer(p, dtype=np.int32))], ["token", "fam", "low", "high", "place"])


def _opened(percent: int):
    """Links between the members of two groups, as pairs of nodes: a family is one node, others are classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            sides = [[batch.column(f"{c}_{s}") for c in ("node", "cids", "sizes", "tokens", "masks")] for s in "xy"]
            for i in range(batch.num_rows):
                groups, names = [], []
                for columns in sides:
                    node, cids, sizes, tokens, masks = (c[i].as_py() for c in columns)
                    union = np.frombuffer(tokens, dtype=np.uint64)
                    groups.append((np.frombuffer(sizes, dtype=np.int64), union, np.frombuffer(masks, dtype=np.uint64) if masks else np.ones(len(union), dtype=np.uint64)))
                    names.append([node or cids[j : j + 16] for j in range(0, len(cids), 16)])
                found += {(names[0][a], names[1][b]) for a, b in open_groups(*groups, percent)}
            edges = _forest(found)
            yield pa.record_batch({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    return run


def _inner_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = [(x[i : i + 16], x[i + 16 : i + 32]) for x in batch.column("links").to_pylist() for i in range(0, len(x), 32)]
        yield pa.record_batch({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(x[i : i + 16], node) for node, x in zip(batch.column("node").to_pylist(), batch.column("cids").to_pylist(), strict=True) for i in range(0, len(x), 16)]
        yield pa.record_batch({"cid": pa.array([c for c, _ in rows], pa.binary()), "node": pa.array([n or c for c, n in rows], pa.binary())})


def jaccard_rows(docs: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Link components as in `jaccard_components`, with `tie` (a hash of the text) and `stays` (the row's class is the one that names its component)."""
    text = text_of()
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.select(F.coalesce("doc_id", "tie").alias("rid"), "doc_id", "tie", "text")
    named = shared_checkpoint(rows.mapInArrow(_skeleton(k), "rid long, doc_id long, tie long, n long, cls long, cid binary, tokens binary, counts binary"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_tokens(named))
    skeleton = named.where("rid is not null").select("rid", "doc_id", "tie", "n", "cls", "cid")
    facts = [F.min("rid").alias("rid"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n"), F.first("cls").alias("cls")]
    classes = shared_checkpoint(skeleton.where("n > 0").groupBy("cid").agg(*facts))

    groups = _grouped(rows, classes, frequent, k, percent)
    edges = _links_across(groups, percent).unionByName(groups.where(F.length("links") > 0).select("links").mapInArrow(_inner_links, "a binary, b binary"))
    labels = components(edges)
    node_of = groups.select("node", "cids").mapInArrow(_members, "cid binary, node binary")
    component = node_of.join(labels, "node", "left").select("cid", F.coalesce("component", "node").alias("component"))
    return _named_rows(skeleton, classes, component)


def _grouped(rows: DataFrame, classes: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """Groups of the classes that meet enough tokens of others, with their token unions; a checkpoint."""
    total = classes.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = max(256, int(total // BLOCK_TOKENS))
    blocks = rows.select("text").mapInArrow(_prefix_blocks(frequent, buckets, DEALT_FROM, k, percent), "bucket long, tokens binary, classes binary, deals binary")
    met = blocks.groupBy("bucket").applyInArrow(_met_in_block, "cls long, met long, known long, count long, token long")
    met = met.groupBy("cls").agg(F.sum("met").alias("met"), F.sum("known").alias("known"), F.max(F.struct("count", "token"))["token"].alias("key"))
    # The smallest set that can link is percent of this one. Blocks keep 32 bits of a token, so two tokens of a set may rarely count as one.
    enough = F.floor(F.ceil(F.col("n") * percent / 100) * MET_PERCENT / 100) + 1
    live = shared_checkpoint(met.join(classes.select("cls", "cid", "rid", "n"), "cls").where(F.col("met") >= F.greatest(F.lit(1), enough - 2)).select("cid", "rid", "n", "key", "known"))

    leads = live.groupBy("key").agg(F.max_by("cid", F.struct("known", "cid")).alias("leader"), F.sum("n").alias("volume"))
    volume = live.agg(F.sum("n")).first()[0] or 0
    parts = int(volume // PART_TOKENS) + 1
    salts = F.ceil(F.col("volume") / PART_TOKENS)
    own = F.when(salts > 1, F.xxhash64("key", F.pmod(F.xxhash64("cid"), salts))).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts)))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), salts - 1), lambda i: F.xxhash64("key", i))
    wanted = live.join(leads, "key").select("rid", "cid", "key", own.alias("home"), (F.col("cid") == F.col("leader")).alias("leads"), (salts > 1).alias("spread"), everywhere.alias("everywhere"))
    wanted = wanted.withColumn("parts", F.when(F.col("leads") & F.col("spread"), F.col("everywhere")).otherwise(F.array("home"))).drop("everywhere")
    wanted = shared_checkpoint(wanted)
    count = wanted.count()
    sets = rows.select("rid", "text").join(maybe_broadcast(wanted, count, BROADCAST_IDS), "rid")
    sets = sets.mapInArrow(_set_rows(k), "part long, cid binary, key long, leads boolean, guest boolean, spread boolean, n long, tokens binary")
    return shared_checkpoint(sets.groupBy("part").applyInArrow(_built(frequent, percent), _GROUP))


def _links_across(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups of different columns of the token-group matrix; a checkpoint.

    Of two columns, tokens meet at places that the bound allows; pairs that meet less than `met_tokens` times go. A column stands in
    with the sizes of its smallest and largest members, which only widens the bounds.
    """
    matrix = groups.select("fam", "low", "high", "ptokens", "pplaces").mapInArrow(_matrix_rows, "token long, fam long, low long, high long, place int")
    matrix = matrix.groupBy("token", "fam").agg(F.min("place").alias("place"), F.min("low").alias("low"), F.max("high").alias("high"))
    x, y = (matrix.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("fam", "low", "high", "place")]) for side in "xy")
    smaller = F.least("low_x", "low_y")
    met = F.floor(smaller * MET_PERCENT / 100) + 1
    overlap = F.ceil((F.col("low_x") + F.col("low_y")) * percent / (100 + percent) - F.lit(1e-9))
    sizes = (F.col("high_x") * 100 >= F.col("low_y") * percent) & (F.col("high_y") * 100 >= F.col("low_x") * percent)
    near = (F.col("place_x") < F.col("high_x") - overlap + met) & (F.col("place_y") < F.col("high_y") - overlap + met)
    both = x.join(y, (x.token == y.token) & (F.col("fam_x") < F.col("fam_y")) & sizes & near)
    pairs = both.groupBy("fam_x", "fam_y").agg(F.count(F.lit(1)).alias("common"), F.min(met).alias("least")).where("common >= least").select("fam_x", "fam_y")
    blobs = ("node", "cids", "sizes", "tokens", "masks")
    left, right = (groups.select(F.col("fam").alias(f"fam_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in blobs]) for side in "xy")
    opened = pairs.join(left, "fam_x").join(right, "fam_y").drop("fam_x", "fam_y")
    return shared_checkpoint(opened.mapInArrow(_opened(percent), "a binary, b binary"))


def _named_rows(skeleton: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """Each row with its component's smallest id."""
    label = shared_checkpoint(component.join(classes.select("cid", "least_id"), "cid"))
    smallest = label.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min_by("cid", F.struct(F.col("least_id").isNull(), "least_id", "cid")).alias("keeper"), F.count(F.lit(1)).alias("rows"))
    smallest = shared_checkpoint(smallest.where("rows > 1"))
    several = join_group_facts(label.select("cid", "component"), smallest, "component", "rows").where("rows is not null").select("cid", "component_id", "keeper", F.lit(True).alias("linked"))
    of_class = classes.join(several, "cid", "left").where("linked or class_size > 1")
    of_class = shared_checkpoint(of_class.select("cid", "class_size", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("keeper", "cid").alias("keeper")))
    out = join_group_facts(skeleton.where("n > 0"), of_class, "cid", "class_size")
    alone = F.col("class_size").isNull()
    found = out.select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("cid") == F.col("keeper"))).alias("stays"),
    )
    empty = skeleton.where("n = 0").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return found.unionByName(empty)


def jaccard_components(docs: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Link components of documents whose k-word shingle sets have a Jaccard similarity of `percent` or more.

    Takes any frame with doc_id and text. Returns doc_id, n_shingles, component_id (smallest doc_id that links reach, itself
    included), class_size (documents with the same set). Words are as in `common.word_hashes`. The result is exact up to collisions of
    64-bit hashes.

    A text without words links with nothing. Rows without an id take part, and have their component's smallest id, or null if it
    has none. Repeated rows count as equal texts; a text without words keeps its own id. An empty table gives no rows; further
    columns are ignored.
    """
    return jaccard_rows(docs, k, percent).select("doc_id", "n_shingles", "component_id", "class_size")


def keep_one_of_each(docs: DataFrame, k: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the one whose id names it; columns are unchanged. Documents without words or without an id stay.

    Where one id stands on rows of several texts, only those texts go that another row stands for. Rows that repeat id and set of the
    staying one stay with it.
    """
    id_name, tie_name = (f"{docs.columns and max(docs.columns, key=len)}_{x}" for x in ("id", "tie"))
    decided = jaccard_rows(docs, k, percent)
    gone = decided.where("n_shingles > 0 and doc_id is not null and not (stays and doc_id = component_id)")
    gone = shared_checkpoint(gone.select(F.col("doc_id").alias(id_name), F.col("tie").alias(tie_name)).distinct())
    marked = (F.col("doc_id").cast("long") == F.col(id_name)) & (F.xxhash64(text_of()) == F.col(tie_name))
    return docs.join(maybe_broadcast(gone, gone.count()), marked, "left_anti")
