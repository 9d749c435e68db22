"""Hard negatives: rows of other labels whose scores lie in a window below a positive's, from a vantage-point tree over norm-augmented vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import join_group_facts, shared_checkpoint

#: Vectors that the upper tree is fitted on at most, its levels at most (so 512 cells), and vectors that a cell should hold.
SAMPLE_ROWS, MOST_LEVELS, ROWS_IN_CELL = 4096, 9, 1024
#: Vectors that a task's own tree holds at most; larger cells are split by hash. Queries that travel together.
ROWS_IN_BLOCK, PACK = 16_384, 512
#: Vectors in a leaf of a task's tree, and cells that a query visits before its bound is known.
LEAF, FIRST_CELLS = 64, 2
POSITIVES, NEGATIVES = 5, 5
#: Components beyond this have no scores that fit in a long.
MOST = 1 << 26
_QUERY = "qkey string, label int, same boolean, low long, high long, vector array<int>"
_FOUND = "qkey string, score long, vec_id long, own boolean"


# --- the tree -----------------------------------------------------------------------------------------------------


class UpperTree:
    """A perfect binary vantage-point tree: its leaves are the cells that Spark deals the vectors to.

    Vectors get one more component that gives all of them the norm M, and a query's is 0. The squared distance to a query of norm
    |q| is then |q|^2 + M^2 - 2 * score, so nearer means a higher score, and a window of scores is an annulus.
    """

    def __init__(self, sample: np.ndarray, norm2: float, levels: int):
        self.norm2, self.levels = norm2, levels
        sample = self.augmented(sample)
        self.vantage = np.zeros(((1 << levels) - 1, sample.shape[1]))
        self.radius = np.zeros(len(self.vantage))
        members = {0: np.arange(len(sample))}
        for node in range(len(self.vantage)):
            own = members.pop(node)
            # The one that lies farthest from the first spreads the others best.
            far = own[np.argmax(_distance(sample[own], sample[own[0]]))] if len(own) else 0
            self.vantage[node] = sample[far] if len(own) else 0
            d = _distance(sample[own], self.vantage[node])
            self.radius[node] = np.median(d) if len(d) else 0
            members[2 * node + 1], members[2 * node + 2] = own[d <= self.radius[node]], own[d > self.radius[node]]

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.sqrt(np.maximum(self.norm2 - (vectors * vectors).sum(axis=1), 0))])

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and its distances to the vantage points on the way."""
        points, node = self.augmented(vectors), np.zeros(len(vectors), dtype=np.int64)
        way = np.zeros((len(vectors), self.levels))
        for level in range(self.levels):
            way[:, level] = np.sqrt(((points - self.vantage[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (way[:, level] > self.radius[node])
        return node - len(self.vantage), way


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


class Cells:
    """Distances of each cell's vectors to the vantage points above it, as ranges; one row a cell, so at most 512."""

    def __init__(self, tree: UpperTree, rows: list):
        self.tree = tree
        self.name = np.array([r.cell for r in rows], dtype=np.int64)
        self.blocks = np.array([r.blocks for r in rows], dtype=np.int64)
        self.low = np.array([r.low for r in rows], dtype=float).reshape(len(rows), tree.levels)
        self.high = np.array([r.high for r in rows], dtype=float).reshape(len(rows), tree.levels)
        self.above = np.zeros((len(rows), tree.levels), dtype=np.int64)
        node = self.name + len(tree.vantage)
        for level in reversed(range(tree.levels)):
            node = (node - 1) // 2
            self.above[:, level] = node

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that a vector of each cell can have from each query."""
        shape = (len(queries), len(self.name))
        least, most = np.zeros(shape), np.full(shape, np.inf)
        points = np.column_stack([queries, np.zeros(len(queries))])
        far = np.stack([_distance(points, v) for v in self.tree.vantage], axis=1) if self.tree.levels else None
        for level in range(self.tree.levels):
            d = far[:, self.above[:, level]]
            least = np.maximum(least, np.maximum(self.low[:, level] - d, d - self.high[:, level]))
            most = np.minimum(most, d + self.high[:, level])
        return least, most


def _annulus(norm2: float, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances that the window's scores mean, a little wider for rounding; infinite ends where a window has none."""
    whole = norm2 + (vectors * vectors).sum(axis=1)
    slack = _slack(whole)
    near, far = np.sqrt(np.maximum(whole - 2 * high, 0)) - slack, np.sqrt(np.maximum(whole - 2 * low, 0)) + slack
    return near, far


def _slack(whole: np.ndarray) -> np.ndarray:
    return 1e-6 * np.sqrt(whole) + 1e-6


class BlockTree:
    """A vantage-point tree over the vectors of one block. A pack of queries goes through it together, each nearest leaf first."""

    def __init__(self, norm2: float, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]]):
        self.norm2 = norm2
        copies = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.vectors, self.labels = np.repeat(vectors, copies, axis=0), np.repeat(labels, copies)
        self.ids = np.array([i for own in ids for i in own], dtype=np.int64)
        self.real = self.vectors.astype(float)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        points = np.column_stack([self.real, np.sqrt(np.maximum(norm2 - (self.real**2).sum(axis=1), 0))])
        self.leaves: list[np.ndarray] = []
        #: Per leaf, each vantage point above it with the range of its members' distances.
        self.above: list[list[tuple[int, float, float]]] = []
        vantage: list[np.ndarray] = []
        todo: list[tuple[np.ndarray, list]] = [(np.arange(len(points)), [])]
        while todo:
            own, path = todo.pop()
            if len(own) <= LEAF:
                self.leaves.append(own)
                self.above.append(path)
                continue
            # The member that lies farthest from the first spreads the others best.
            v = points[own[np.argmax(_distance(points[own], points[own[0]]))]]
            d = _distance(points[own], v)
            by = np.argsort(d, kind="stable")
            half = len(own) // 2
            vantage.append(v)
            for part in (by[half:], by[:half]):
                todo.append((own[part], [*path, (len(vantage) - 1, float(d[part].min()), float(d[part].max()))]))
        self.vantage = np.array(vantage).reshape(len(vantage), points.shape[1])

    def _bounds(self, real: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each leaf's members from each query."""
        square = (self.vantage**2).sum(axis=1) + (real**2).sum(axis=1)[:, None] - 2 * (real @ self.vantage[:, :-1].T)
        far = np.sqrt(np.maximum(square, 0))
        least, most = np.zeros((len(real), len(self.leaves))), np.full((len(real), len(self.leaves)), np.inf)
        for leaf, path in enumerate(self.above):
            for v, low, high in path:
                least[:, leaf] = np.maximum(least[:, leaf], np.maximum(low - far[:, v], far[:, v] - high))
                most[:, leaf] = np.minimum(most[:, leaf], far[:, v] + high)
        return least, most

    def search(self, vectors: np.ndarray, labels: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each query the first k rows within its window, of its label or of others: numbers of queries, scores, ids, and whether a row is the query's own vector.

        `low`, `high` and `bound`, a score that the k-th row is known to have, are infinite where open. A query visits its nearest leaf, then the
        next one, the next two, four and so on, while they lie in the window's annulus and no farther than its k-th row so far.
        """
        real = vectors.astype(float)
        whole = self.norm2 + (real * real).sum(axis=1)
        near, _ = _annulus(self.norm2, real, low, high)
        floor = np.maximum(low, bound)
        least, most = self._bounds(real, whole)
        order = np.argsort(least, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        rank[most < near[:, None] - _slack(whole)[:, None]] = len(self.leaves)
        exact = real.shape[1] * self.largest * float(np.abs(real).max(initial=0)) < 1 << 52  # whole numbers that doubles hold
        best = np.full((len(real), k), -np.inf) if exact else np.full((len(real), k), np.iinfo(np.int64).min)
        place = np.full((len(real), k), -1, dtype=np.int64)
        names = np.full((len(real), k), np.iinfo(np.int64).max)
        start, stop = 0, 1
        while start < len(self.leaves):
            _, far = _annulus(self.norm2, real, np.maximum(floor, np.where(place[:, -1] >= 0, best[:, -1], -np.inf)), high)
            visit = (rank >= start) & (rank < stop) & (least <= far[:, None])
            for leaf in np.flatnonzero(visit.any(axis=0)):
                q, here = np.flatnonzero(visit[:, leaf]), self.leaves[leaf]
                score = real[q] @ self.real[here].T if exact else vectors[q] @ self.vectors[here].T
                fits = (self.labels[here][None, :] == labels[q][:, None]) == same[q][:, None]
                fits &= (score >= floor[q][:, None]) & (score <= high[q][:, None])
                some = fits.any(axis=1)
                q, score, fits = q[some], score[some], fits[some]
                if not len(q):
                    continue
                nothing = -np.inf if exact else np.iinfo(np.int64).min
                scores = np.concatenate([best[q], np.where(fits, score, nothing)], axis=1)
                places = np.concatenate([place[q], np.where(fits, here[None, :], -1)], axis=1)
                called = np.concatenate([names[q], np.where(fits, self.ids[here][None, :], np.iinfo(np.int64).max)], axis=1)
                first = np.lexsort((called, -scores), axis=1)[:, :k]
                best[q], place[q], names[q] = (np.take_along_axis(x, first, axis=1) for x in (scores, places, called))
            start, stop = stop, 2 * stop
        q, nth = np.nonzero(place >= 0)
        at = place[q, nth]
        own = same[q] & (self.vectors[at] == vectors[q]).all(axis=1)
        return q, best[q, nth].astype(np.int64), self.ids[at], own


# --- the index in Spark -------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        values = v.values.to_numpy(zero_copy_only=False)
        out[i, : len(values)] = values
    return out


class Index:
    """All vectors in cells and blocks (`placed`), with the small table of cells."""

    def __init__(self, classes: DataFrame):
        """`classes` has cls, vector, label, ids; it should be checkpointed."""
        spark = classes.sparkSession
        squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        n, width, norm2 = classes.agg(F.count("*"), F.max(F.size("vector")), F.max(squares)).first()
        self.width, norm2 = int(width or 0), float(norm2 or 0)
        levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(n, 1) / ROWS_IN_CELL)))))
        # Rows in the order of a hash of their vector are a random sample; as many as the constant says reach the driver.
        sample = classes.select("vector", F.xxhash64("cls").alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect() if levels else []
        first = np.zeros((len(sample), self.width))
        for i, r in enumerate(sample):
            first[i, : len(r.vector)] = r.vector
        self.tree = tree = UpperTree(first, norm2, levels)
        width = self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, way = tree.place(_matrix(batch.column("vector"), width).astype(float))
                columns = {name: batch.column(name) for name in batch.schema.names}
                yield pa.record_batch(columns | {"cell": pa.array(cell, pa.int32()), "way": pa.array(list(way), pa.list_(pa.float64()))})

        self.placed = shared_checkpoint(classes.mapInArrow(place, "cls string, vector array<int>, label int, ids array<long>, cell int, way array<double>"))
        lows = F.array(*[F.min(F.col("way")[i]) for i in range(levels)]) if levels else F.array().cast("array<double>")
        highs = F.array(*[F.max(F.col("way")[i]) for i in range(levels)]) if levels else F.array().cast("array<double>")
        cells = self.placed.groupBy("cell").agg(lows.alias("low"), highs.alias("high"), F.ceil(F.count("*") / ROWS_IN_BLOCK).alias("blocks"))
        cells = shared_checkpoint(cells)
        self.cells = Cells(tree, cells.orderBy("cell").collect())
        blocked = self.placed.join(F.broadcast(cells.select("cell", "blocks")), "cell")
        self.blocks = blocked.select("cell", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vector", "label", "ids")
        self.spark = spark

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The first k rows of each query, higher scores and then smaller ids first: qkey, score, vec_id, own.

        `queries` has qkey, label, same (rows of this label, or of the others), low and high (the window, null where open) and vector. A query
        visits its nearest cells first; the score of its k-th row then bounds what it needs of all others.
        """
        queries = shared_checkpoint(queries)
        first = shared_checkpoint(_first_of_each(self._visit(queries.withColumn("bound", F.lit(None).cast("long")), k, True), k))
        kth = first.groupBy("qkey").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        rest = self._visit(queries.join(kth, "qkey", "left"), k, False)
        return _first_of_each(first.unionByName(rest), k)

    def _visit(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        cells, width, norm2 = self.cells, self.width, self.tree.norm2

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, len(whole), PACK):
                    batch = whole.slice(start, PACK)
                    vectors = _matrix(batch.column("vector"), width).astype(float)
                    ends = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high", "bound")}
                    near, far = _annulus(norm2, vectors, np.nan_to_num(ends["low"], nan=-np.inf), np.nan_to_num(ends["high"], nan=np.inf))
                    least, most = cells.bounds(vectors)
                    meets = (least <= far[:, None]) & (most >= near[:, None])
                    early = np.argsort(np.where(meets, least, np.inf), axis=1, kind="stable")[:, :FIRST_CELLS]
                    visit = np.zeros_like(meets)
                    np.put_along_axis(visit, early, True, axis=1)
                    if not first:
                        within = _annulus(norm2, vectors, np.nan_to_num(ends["bound"], nan=-np.inf), np.full(len(vectors), np.inf))[1]
                        visit = ~visit & (least <= within[:, None])
                    visit &= meets
                    for c in np.flatnonzero(visit.any(axis=0)):
                        part = batch.take(pa.array(np.flatnonzero(visit[:, c])))
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, part.schema) as out:
                            out.write_batch(part)
                        n, pack = int(cells.blocks[c]), sink.getvalue().to_pybytes()
                        yield pa.record_batch({"cell": pa.array([cells.name[c]] * n, pa.int32()), "block": pa.array(range(n), pa.int32()), "kind": pa.array([1] * n, pa.int32()), "pack": pa.array([pack] * n, pa.binary())})

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, tree = None, [], None
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "kind")), strict=True))
                cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or keys[i][2]] + [len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    if keys[a][:2] != key:
                        key, held, tree = keys[a][:2], [], None
                    part = batch.slice(a, b - a)
                    if not keys[a][2]:
                        held.append((_matrix(part.column("vector"), width), part.column("label").to_numpy(), part.column("ids").to_pylist()))
                        continue
                    if tree is None:
                        tree = BlockTree(norm2, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [i for h in held for i in h[2]])
                    queries = pa.ipc.open_stream(part.column("pack")[0].as_py()).read_all()
                    vectors = _matrix(queries.column("vector").combine_chunks(), width)
                    low, high, bound = (queries.column(c).to_numpy().astype(float) for c in ("low", "high", "bound"))
                    low, high, bound = np.nan_to_num(low, nan=-np.inf), np.nan_to_num(high, nan=np.inf), np.nan_to_num(bound, nan=-np.inf)
                    q, score, vec_id, own = tree.search(vectors, queries.column("label").to_numpy(), queries.column("same").to_numpy(), low, high, k, bound)
                    if len(q):
                        yield pa.record_batch({"qkey": queries.column("qkey").take(pa.array(q)).combine_chunks(), "score": pa.array(score), "vec_id": pa.array(vec_id), "own": pa.array(own)})

        packs = queries.mapInArrow(route, "cell int, block int, kind int, pack binary")
        rows = self.blocks.unionByName(packs, allowMissingColumns=True)
        return rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(answer, _FOUND)


def _first_of_each(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


# --- the operator -------------------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows that take part, with whole-number components: vec_id, label, vector.

    Null ids, labels and vectors, and vectors with a null or non-finite component, take no part, nor do those with a component
    beyond 2^26, whose scores no long holds. A row that is there twice counts once.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) <= MOST))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.cast("array<int>").alias("vector"))


def mine(rows: DataFrame, anchors, low_percent: int = 80, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each anchor and each of its first rows of the same label, the first rows of other labels with scores from `low_percent` of that one's up to it.

    `rows` are those of `whole_vectors`; `anchors` is a condition on them. Rows of one vector and label are one class: of its rows
    only the smallest ids can be among the first, one more than positives, since an anchor isn't its own; so no row is lost by keeping
    those, and anchors of one class share a search. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Anchors without another row of their label, and pairs without a row in the window, give no rows; a window below a negative score is
    empty. Of equal scores the smaller id comes first. A shorter vector counts as ending in zeros. An empty table gives no rows.
    """
    keep = max(positives + 1, negatives)
    rows = rows.withColumn("cls", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>"), F.col("label").cast("string")), 256))
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    few = rows.dropDuplicates(["cls", "vec_id"]).withColumn("nth", nth).where(F.col("nth") <= keep)
    classes = shared_checkpoint(few.groupBy("cls").agg(F.first("vector").alias("vector"), F.first("label").alias("label"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    index = Index(classes)
    asked = rows.where(anchors).select("vec_id", "cls").distinct()
    asked = shared_checkpoint(asked)
    sizes = asked.groupBy("cls").agg(F.count("*").alias("anchors"))
    sought = shared_checkpoint(sizes.join(classes, "cls").select("cls", "anchors", "vector", "label"))
    none = F.lit(None).cast("long")
    best = shared_checkpoint(index.search(sought.select(F.col("cls").alias("qkey"), "label", F.lit(True).alias("same"), none.alias("low"), none.alias("high"), "vector"), positives + 1))
    # One window for each score of a class's positives; a class has one more of those than an anchor.
    low = F.expr(f"score * {low_percent} div 100 + cast(score * {low_percent} % 100 > 0 as int)").alias("low")
    windows = best.where("score >= 0").select(F.col("qkey").alias("cls"), "score").distinct()
    windows = windows.join(sought, "cls").select(
        F.concat_ws("|", "cls", "score").alias("qkey"), "label", F.lit(False).alias("same"), low, F.col("score").alias("high"), "vector"
    )
    worst = index.search(windows, negatives).select(F.substring_index("qkey", "|", 1).alias("cls"), F.substring_index("qkey", "|", -1).cast("long").alias("within"), "score", "vec_id")
    listed = worst.groupBy("cls").agg(F.collect_list(F.struct("within", "score", "vec_id")).alias("negatives"))
    first = best.groupBy(F.col("qkey").alias("cls")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id", "own"))).alias("positives"))
    facts = shared_checkpoint(sizes.join(first, "cls").join(listed, "cls"))
    known = join_group_facts(asked, facts, "cls", "anchors")
    others = F.slice(F.filter("positives", lambda p: ~(p["own"] & (p["vec_id"] == F.col("vec_id")))), 1, positives)
    pairs = known.where(F.col("positives").isNotNull()).select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p"), "negatives")
    score = -F.col("p.below")
    order = F.array_sort(F.transform(F.filter("negatives", lambda x: x["within"] == score), lambda x: F.struct((-x["score"]).alias("below"), x["vec_id"].alias("vec_id"))))
    mined = pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), score.alias("positive_score"), F.posexplode(order).alias("at", "n"))
    return mined.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.below")).alias("negative_score")
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """`mine` over all embeddings: every seventh row has the next label, and every hundredth is an anchor."""
    rows = whole_vectors(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
