"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, floor(scale * x); a score is an integer inner product.
An inner product is no metric, so a vector x gets one more component,
sqrt(M^2 - |x|^2), M being the largest norm of its tree, and a query q a zero:
then distance^2 = |q|^2 + M^2 - 2 q.x, and the nearest are the highest scores.

1. Pivots (at most ``max_pivots`` vectors, those with the smallest hash) deal
   every vector to its nearest pivot. A cell with more than ``tree_size`` vectors
   is dealt again by pivots of its own, level by level, so the number of cells
   grows with the data and no level has more than ``max_pivots`` a cell. A cell
   that does not fall apart (copies of one vector, however many) is split into
   equal parts by a hash.
2. Each part becomes an M-tree: leaf pages of at most ``page_size`` vectors and
   inner nodes of at most ``fan_out`` pages, every node with its routing vector,
   covering radius and distance to its parent's routing vector, every vector
   with its distance to its page's. The pages are written as a table.
3. First round: every query searches the tree that it was dealt to itself, and
   learns a score that its k-th best reaches at least.
4. Second round: the roots of the trees (routing vector, radius, largest norm)
   tell which other trees can hold a better one; a query goes to those with
   its bound. Queries move, ``block_size`` of them share one reading of a tree.
   For a query the nodes are taken from a heap by their lower bound
   d(q, node) - radius; the search ends when the bound exceeds the distance of
   the k-th best so far. Before a distance is computed, |d(q, parent) -
   d(node, parent)| - radius is tried: by the triangle inequality it is a lower
   bound too, and needs no vector. Bounds are compared with a slack for rounding.
5. The k best of every tree meet per query: k rows per tree, ranked.

Scores are exact integers for any finite component: products that may pass 2**52
are added as 64-bit integers, those that may pass 2**62 as Python integers. A
score beyond 64 bits is reported as the nearest 64-bit number and ranked by its
exact value. Distances use vectors scaled down by a power of two where their
squares would overflow.

How much the bounds save depends on the vectors: in clustered ones a query sees
a few trees; if all vectors are about equally far from each other, no metric
index can leave a tree out, and the work is queries times rows.

Defined cases: vectors that are null or hold a null or non-finite component take
no part; a vector shorter than others counts as filled with zeros; a query's
candidates are the rows with another (or no) vec_id; repeated rows are
candidates each, and one query; rows without an id are candidates only, last
among ties; fewer than k candidates are returned all; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm._shared import written

NODE = (
    "cell long, part int, node int, parent int, leaf boolean, radius double, to_parent double, top double, "
    "center binary, ids array<long>, vectors binary, distances binary"
)
FOUND = "query_id long, key long, vec_id long, score long, beyond string, near double"
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of components, filled up with zeros."""
    out = np.zeros((len(column), dim))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass(frozen=True)
class Space:
    """How components become integers, and integers places for distances."""

    dim: int
    scale: float
    unit: float  # a power of two; 1 unless squares would overflow

    def integers(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(x * self.scale)

    def places(self, x: np.ndarray) -> np.ndarray:
        if self.unit == 1.0:
            return self.integers(x)
        with np.errstate(over="ignore", invalid="ignore"):
            v = self.integers(x)
            return np.where(np.isfinite(v), v * self.unit, x * self.unit * self.scale)

    def _whole(self, x: float) -> int:
        v = x * self.scale
        return math.floor(v) if math.isfinite(v) else math.floor(Fraction(x) * Fraction(self.scale))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        """Exact inner products of the integers of ``rows`` with those of ``q``."""
        v, w = self.integers(rows), self.integers(q)
        with np.errstate(over="ignore"):
            most = np.abs(v).max(initial=0.0) * np.abs(w).max(initial=0.0) * max(self.dim, 1)
        if most < 2.0**52:
            return (v @ w).astype(np.int64).tolist()
        if most < 2.0**62:
            return (v.astype(np.int64) @ w.astype(np.int64)).tolist()
        whole = [self._whole(x) for x in q.tolist()]
        return [sum(self._whole(x) * y for x, y in zip(r, whole, strict=True)) for r in rows.tolist()]


def _beyond(score: int) -> str | None:
    """Text that ascends with scores beyond 64 bits (of one sign)."""
    if -_LONG <= score <= _LONG:
        return None
    digits = str(abs(score)).zfill(700)
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210"))


def _assign(pivots: np.ndarray, space: Space):
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                v = space.places(_matrix(batch.column(1), space.dim))
                pivot = (v @ pivots.T - half).argmax(axis=1) if len(v) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(pivot.astype(np.int64))], names=["vec_id", "x", "cell"]
                )

    return run


def _assign_again(space: Space, max_pivots: int):
    """Rows of a cell to the nearest of the cell's own pivots."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        cell = rows.column("cell").to_numpy()
        if rows.num_rows and pivots.num_rows:
            p = np.unique(space.places(_matrix(pivots.column("x").combine_chunks(), space.dim)), axis=0)
            v = space.places(_matrix(rows.column("x").combine_chunks(), space.dim))
            nearest = np.concatenate(
                [(v[lo : lo + 4096] @ p.T - (p**2).sum(axis=1) / 2).argmax(axis=1) for lo in range(0, len(v), 4096)]
            )
            cell = cell * max_pivots + nearest
        return pa.table({"vec_id": rows.column("vec_id"), "x": rows.column("x"), "cell": pa.array(cell, pa.int64())})

    return run


def _split(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size`` near one another: halves by two far points."""
    done, todo = [], [rows]
    while todo:
        r = todo.pop()
        if len(r) <= size:
            done.append(r)
            continue
        p = points[r]
        a = p[((p - p[0]) ** 2).sum(axis=1).argmax()]
        b = p[((p - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(p @ (b - a), kind="stable")
        todo += [r[order[len(r) // 2 :]], r[order[: len(r) // 2]]]
    return done


def _center(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point nearest to the mean, and all distances to it."""
    mean = points.mean(axis=0)
    center = points[((points - mean) ** 2).sum(axis=1).argmin()]
    return center, np.sqrt(((points - center) ** 2).sum(axis=1))


def build_tree(ids: list[int | None], x: np.ndarray, space: Space, page_size: int, fan_out: int) -> list[dict]:
    """The nodes of an M-tree: a root, inner nodes and leaf pages."""
    v = space.places(x)
    norms = (v**2).sum(axis=1)
    top = float(norms.max())
    points = np.column_stack([v, np.sqrt(np.maximum(top - norms, 0))])
    root, far = _center(points)
    nodes = [{"node": 0, "parent": -1, "leaf": False, "radius": far.max(), "to_parent": 0.0, "center": root}]
    for inner in _split(points, np.arange(len(points)), page_size * fan_out):
        center, far = _center(points[inner])
        at = len(nodes)
        to_root = float(np.sqrt(((center - root) ** 2).sum()))
        nodes.append({"node": at, "parent": 0, "leaf": False, "radius": far.max(), "to_parent": to_root, "center": center})
        for page in _split(points, inner, page_size):
            own, far = _center(points[page])
            nodes.append(
                {
                    "node": len(nodes),
                    "parent": at,
                    "leaf": True,
                    "radius": far.max(),
                    "to_parent": float(np.sqrt(((own - center) ** 2).sum())),
                    "center": own,
                    "ids": [ids[i] for i in page],
                    "vectors": x[page],
                    "distances": far,
                }
            )
    for n in nodes:
        n["top"] = top
    return nodes


def _build(space: Space, page_size: int, fan_out: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("x").combine_chunks(), space.dim)
        nodes = build_tree(table.column("vec_id").to_pylist(), x, space, page_size, fan_out)
        as_bytes = lambda n, k: n[k].astype("<f8").tobytes() if k in n else None
        return pa.table(
            {
                "cell": pa.array([table.column("cell")[0].as_py()] * len(nodes), pa.int64()),
                "part": pa.array([table.column("part")[0].as_py()] * len(nodes), pa.int32()),
                **{k: pa.array([n[k] for n in nodes], t) for k, t in (("node", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()))},
                **{k: pa.array([float(n[k]) for n in nodes], pa.float64()) for k in ("radius", "to_parent", "top")},
                "center": pa.array([as_bytes(n, "center") for n in nodes], pa.binary()),
                "ids": pa.array([n.get("ids") for n in nodes], pa.list_(pa.int64())),
                "vectors": pa.array([as_bytes(n, "vectors") for n in nodes], pa.binary()),
                "distances": pa.array([as_bytes(n, "distances") for n in nodes], pa.binary()),
            }
        )

    return run


def _slack(base: float) -> float:
    return 1e-6 * (1.0 + math.sqrt(base))


class Tree:
    def __init__(self, nodes: list[dict], space: Space):
        nodes = sorted(nodes, key=lambda n: n["node"])
        self.nodes, self.space = nodes, space
        self.top = nodes[0]["top"]
        self.centers = np.stack([n["center"] for n in nodes])
        self.radius = np.array([n["radius"] for n in nodes])
        self.to_parent = np.array([n["to_parent"] for n in nodes])
        parents = np.array([n["parent"] for n in nodes])
        self.children = [np.flatnonzero(parents == i) for i in range(len(nodes))]
        for n in nodes:
            if n["leaf"]:
                n["places"] = space.places(n["vectors"])

    def search(self, own_id: int | None, x: np.ndarray, k: int, reached: float | None = None) -> list[tuple[int, int | None, float]]:
        """The k best (score, id, inner product of places) of the tree, ties to the
        smaller id (none: last); fewer if ``reached``, an inner product that the
        k-th best of other trees reaches, rules them out."""
        q = self.space.places(x)
        base = float(q @ q) + self.top
        point = np.append(q, 0.0)
        best: list[tuple] = []  # a heap, the worst first: (score, -id or -inf, inner product)
        slack = _slack(base)
        limit = math.inf if reached is None else math.sqrt(max(0.0, base - 2.0 * reached))
        root = float(np.sqrt(((self.centers[0] - point) ** 2).sum()))
        heap = [(max(0.0, root - self.radius[0]), 0, root)]
        while heap:
            bound, at, distance = heapq.heappop(heap)
            if bound > limit + slack:
                break
            node = self.nodes[at]
            if node["leaf"]:
                near = np.flatnonzero(np.abs(distance - node["distances"]) <= limit + slack)
                products = node["places"][near] @ q
                if limit < math.inf:  # the distance itself, before the exact score
                    close = base - 2.0 * products <= (limit + slack) ** 2
                    near, products = near[close], products[close]
                if not len(near):
                    continue
                ids = node["ids"]
                for i, s, p in zip(near.tolist(), self.space.scores(node["vectors"][near], x), products.tolist(), strict=True):
                    if ids[i] is not None and ids[i] == own_id:
                        continue
                    entry = (s, -ids[i] if ids[i] is not None else -math.inf, p)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    limit = min(limit, math.sqrt(max(0.0, base - 2.0 * best[0][2])))
                continue
            down = self.children[at]
            down = down[np.abs(distance - self.to_parent[down]) - self.radius[down] <= limit + slack]
            if len(down):
                far = np.sqrt(((self.centers[down] - point) ** 2).sum(axis=1))
                for i, d in zip(down.tolist(), far.tolist(), strict=True):
                    bound = max(0.0, d - self.radius[i])
                    if bound <= limit + slack:
                        heapq.heappush(heap, (bound, i, d))
        return [(s, None if i == -math.inf else -i, p) for s, i, p in sorted(best, reverse=True)]


def _search(space: Space, k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if pages.num_rows and queries.num_rows:
            nodes = pages.select([f.split()[0] for f in NODE.split(", ")]).to_pylist()
            for n in nodes:
                n["center"] = np.frombuffer(n["center"], "<f8")
                if n["leaf"]:
                    n["vectors"] = np.frombuffer(n["vectors"], "<f8").reshape(-1, space.dim)
                    n["distances"] = np.frombuffer(n["distances"], "<f8")
            tree = Tree(nodes, space)
            vectors = _matrix(queries.column("x").combine_chunks(), space.dim)
            names = [queries.column(c).to_pylist() for c in ("query_id", "key", "reached")]
            for own, key, reached, x in zip(*names, vectors, strict=True):
                for s, i, p in tree.search(own, x, k, reached):
                    rows.append((own, key, i, max(-_LONG - 1, min(_LONG, s)), _beyond(s), p))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.float64()]
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(FOUND.split(", "), columns, kinds, strict=True)})

    return run


def _reachable(space: Space):
    """(query, tree) of the trees whose root does not rule them out."""

    def run(roots: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"at": [], "tree": []}
        if roots.num_rows and queries.num_rows:
            centers = np.stack([np.frombuffer(c, "<f8") for c in roots.column("center").to_pylist()])
            radius, top, cell, part = (roots.column(c).to_numpy() for c in ("radius", "top", "cell", "part"))
            vectors = space.places(_matrix(queries.column("x").combine_chunks(), space.dim))
            own_cell, own_part = queries.column("cell").to_numpy(), queries.column("part").to_numpy()
            for i, (q, reached) in enumerate(zip(vectors, queries.column("reached").to_pylist(), strict=True)):
                base = float(q @ q) + top
                far = np.sqrt(((centers - np.append(q, 0.0)) ** 2).sum(axis=1))
                limit = np.inf if reached is None else np.sqrt(np.maximum(0.0, base - 2.0 * reached))
                can = (far - radius <= limit + 1e-6 * (1.0 + np.sqrt(base))) & ((cell != own_cell[i]) | (part != own_part[i]))
                trees = np.flatnonzero(can)
                out["at"].append(np.full(len(trees), i))
                out["tree"].append(trees)
        at = np.concatenate(out["at"]) if out["at"] else np.empty(0, np.int64)
        tree = np.concatenate(out["tree"]) if out["tree"] else np.empty(0, np.int64)
        moved = queries.select(["query_id", "key", "x", "reached"]).take(pa.array(at, pa.int64()))
        place = roots.select(["cell", "part"]).take(pa.array(tree, pa.int64()))
        return pa.table([*place.columns, *moved.columns], names=["cell", "part", "query_id", "key", "x", "reached"])

    return run


def _dealt(points: DataFrame, space: Space, n: int, max_pivots: int, tree_size: int, chunk: int) -> DataFrame:
    """(vec_id, x, cell, part): every vector in a part of at most about ``tree_size``."""
    wanted = min(max_pivots, max(1, -(-n // tree_size)))
    chosen = points.orderBy(F.xxhash64("x"), "vec_id").limit(wanted).collect()  # a bounded sample
    pivots = np.zeros((max(1, len(chosen)), space.dim))
    for row, r in zip(pivots, chosen, strict=False):
        row[: len(r.x)] = r.x
    pivots = np.unique(space.places(pivots), axis=0)
    dealt = written(points.mapInArrow(_assign(pivots, space), "vec_id long, x array<double>, cell long"), "vectors")
    largest, depth = n, 1
    while n > max_pivots**depth * tree_size:  # one level of pivots is too few
        counts = dealt.groupBy("cell").agg(F.count("*").alias("n_cell"))
        large = counts.where(F.col("n_cell") > tree_size)
        now = large.agg(F.max("n_cell")).first()[0]
        if now is None or (depth > 1 and now == largest):
            break
        largest, depth = now, depth + 1
        own = Window.partitionBy("cell").orderBy(F.xxhash64("x"), "vec_id")
        few = dealt.withColumn("r", F.row_number().over(own)).where(F.col("r") <= max_pivots)
        few = few.join(large, "cell").where(F.col("r") <= F.ceil(F.col("n_cell") / tree_size)).select("cell", "x", "n_cell")
        chunks = F.ceil(F.col("n_cell") / chunk).cast("int")
        few = few.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("cell", "chunk", "x")
        few = written(few, "pivots")
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(chunks, F.lit(1))).cast("int")
        rows = dealt.join(large, "cell", "left").select("vec_id", "x", "cell", spread.alias("chunk"), F.col("n_cell").isNotNull().alias("again"))
        again = (
            rows.where("again").drop("again").groupBy("cell", "chunk").cogroup(few.groupBy("cell", "chunk"))
            .applyInArrow(_assign_again(space, max_pivots), "vec_id long, x array<double>, cell long")
        )
        kept = rows.where("not again").select("vec_id", "x", (F.col("cell") * max_pivots).alias("cell"))
        dealt = written(kept.union(again), "vectors")
    counts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / tree_size).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    return written(dealt.join(counts, "cell").select("vec_id", "x", "cell", part.alias("part")), "parts")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    max_pivots: int = 256,
    tree_size: int = 8192,
    page_size: int = 256,
    fan_out: int = 8,
    block_size: int = 4096,
    max_tasks: int = 10_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` (an
    expression over ``vec_id``) holds."""
    usable = F.col(vector_col).isNotNull() & ~F.exists(
        vector_col,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    points = vectors.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector_col, lambda x: x.cast("double")).alias("x"),
    )
    n, dim, largest = points.agg(
        F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    ).first()
    exponent = math.frexp(largest or 0.0)[1] + math.frexp(float(scale))[1]
    space = Space(max(dim or 0, 1), float(scale), 2.0 ** min(0, 400 - exponent))
    placed = _dealt(points, space, n, max_pivots, tree_size, 65_536)
    index = written(placed.groupBy("cell", "part").applyInArrow(_build(space, page_size, fan_out), NODE), "m-tree")
    roots = index.where("node = 0").select("cell", "part", "center", "radius", "top")
    n_trees = roots.count()
    tasks = max(1, min(n_trees, max_tasks))

    queries = placed.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "x").agg(F.min(F.struct("cell", "part")).alias("own"))
    queries = written(
        queries.select("query_id", "x", "own.*", F.xxhash64("query_id", "x").alias("key"), F.lit(None).cast("double").alias("reached")),
        "queries",
    )

    def searched(pages: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
        left, right = pages.repartition(tasks, *by), asked.repartition(tasks, *by)
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(space, k), FOUND)

    first = written(searched(index, queries, ["cell", "part"]), "top-k")
    kth = first.groupBy("query_id", "key").agg(F.count("*").alias("n"), F.min("near").alias("near")).where(F.col("n") >= k)
    kth = kth.select(F.col("query_id").alias("_id"), F.col("key").alias("_key"), F.col("near").alias("_near"))
    same = F.col("query_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    bounded = queries.drop("reached").join(kth, same, "left").withColumn("reached", F.col("_near"))

    # Blocks of queries against chunks of the roots.
    chunks, blocks = -(-n_trees // 4096) or 1, -(-queries.count() // 16_384) or 1
    asked = bounded.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn(
        "block", F.pmod("key", F.lit(blocks)).cast("int")
    )
    asked = asked.select("chunk", "block", "query_id", "key", "x", "cell", "part", "reached")
    parts = roots.withColumn("chunk", F.pmod(F.xxhash64("cell", "part"), F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    visits = written(
        parts.groupBy("chunk", "block")
        .cogroup(asked.groupBy("chunk", "block"))
        .applyInArrow(_reachable(space), "cell long, part int, query_id long, key long, x array<double>, reached double"),
        "visits",
    )
    asking = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / block_size).cast("int").alias("blocks"))
    pages = index.join(asking, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    visits = visits.join(asking, ["cell", "part"]).withColumn("block", F.pmod("key", F.col("blocks")).cast("int")).drop("blocks")
    found = first.union(searched(pages, visits, ["cell", "part", "block"]))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
