"""Exact top-k by inner product: best-first search in M-trees.

Inner product is no metric, so each vector x gets one more component sqrt(M - |x|^2), M the largest squared norm, and a
query 0: then a larger product is a smaller distance. Vectors are dealt to blocks; each block of vectors meets each
block of queries in one task, which packs the vectors into an M-tree (pages of routing objects with covering radius and
distance to the parent), searches it best first, and skips computing a distance where the stored parent distances and
the triangle inequality already rule the entry out. Bounds carry a small slack, scores are exact integers, so ties are
exact too. The k best of each block are merged per query.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; only
vectors of the query's length are its candidates; rows with the query's id aren't; equal rows with other ids each
count; fewer than k candidates give fewer rows. The scaled components' products must fit into a long.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread  # noqa: F401  (workers load it with this module)

K, SCALE, PAGE = 10, 1024, 48
BLOCK, QUERY_BLOCK = 16384, 1024


class Node:
    """A page: entries' places in the block, their distances to the parent, and for inner pages radii and children."""

    __slots__ = ("rows", "to_parent", "radius", "children")

    def __init__(self, rows, to_parent, radius=None, children=None):
        self.rows, self.to_parent, self.radius, self.children = rows, to_parent, radius, children


class MTree:
    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points, self.page = points, page
        self.root = self._pack(np.arange(len(points)), None, 0)

    def _far(self, rows: np.ndarray, row: int) -> np.ndarray:
        d = self.points[rows] - self.points[row]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _pack(self, rows: np.ndarray, parent: int | None, depth: int) -> Node:
        if len(rows) <= self.page:
            return Node(rows, self._far(rows, parent) if parent is not None else np.zeros(len(rows)))
        # routing objects: each the farthest from those chosen before it
        chosen, gap = [int(rows[0])], self._far(rows, int(rows[0]))
        near = np.zeros(len(rows), np.int64)
        while len(chosen) < min(self.page, math.ceil(2 * len(rows) / self.page)):
            k = int(gap.argmax())
            if gap[k] == 0:
                break
            d = self._far(rows, int(rows[k]))
            near[d < gap] = len(chosen)
            gap = np.minimum(gap, d)
            chosen.append(int(rows[k]))
        if len(chosen) == 1:  # all alike: split by place
            parts = np.array_split(rows, min(self.page, math.ceil(len(rows) / self.page)))
            chosen = [int(p[0]) for p in parts]
        else:
            parts = [rows[near == k] for k in range(len(chosen))]
        radius = np.array([self._far(p, c).max() for p, c in zip(parts, chosen, strict=True)])
        to_parent = self._far(np.array(chosen), parent) if parent is not None else np.zeros(len(chosen))
        return Node(np.array(chosen), to_parent, radius, [self._pack(p, c, depth + 1) for p, c in zip(parts, chosen, strict=True)])

    def search(self, q: np.ndarray, k: int, score, ids: np.ndarray, own: int) -> list[tuple[int, int]]:
        """The k best (score, -id), best first. score: exact scores of given rows."""
        best: list[tuple[int, int]] = []
        slack = 1e-9 * (1 + float(np.sqrt(q @ q)) + float(np.abs(self.points[:1]).sum()))
        limit, heap, n = math.inf, [(0.0, 0, self.root, None)], 0
        q2 = float(q @ q)
        while heap:
            bound, _, node, d_parent = heapq.heappop(heap)
            if bound > limit + slack:
                break
            reach = node.radius if node.children else 0.0
            live = np.arange(len(node.rows))
            if d_parent is not None:
                live = np.flatnonzero(np.abs(d_parent - node.to_parent) - reach <= limit + slack)
            if not len(live):
                continue
            rows = node.rows[live]
            if node.children:
                diff = self.points[rows] - q
                d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                for j, x in zip(live.tolist(), d.tolist(), strict=True):
                    b = max(0.0, bound, x - node.radius[j])
                    if b <= limit + slack:
                        n += 1
                        heapq.heappush(heap, (b, n, node.children[j], x))
                continue
            s = score(rows)
            if len(best) == k:
                keep = s >= best[0][0]
                rows, s = rows[keep], s[keep]
            for r, x in zip(rows.tolist(), s.tolist(), strict=True):
                if ids[r] == own:
                    continue
                item = (x, -int(ids[r]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:  # score = (|q|^2 + M - d^2) / 2
                limit = math.sqrt(max(0.0, q2 + self.m - 2.0 * best[0][0]))
        return sorted(best, reverse=True)


def _search(vectors: pa.Table, queries: pa.Table, k: int, m: float) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if vectors.num_rows and queries.num_rows:
        size = vectors.column("dim")[0].as_py()
        flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, size)
        exact, asked = flat(vectors), flat(queries)
        ids = vectors.column("vec_id").to_numpy()
        real = exact.astype(np.float64)
        tree = MTree(np.column_stack([real, np.sqrt(np.maximum(0.0, m - np.einsum("ij,ij->i", real, real)))]))
        tree.m = m
        for own, v in zip(queries.column("vec_id").to_pylist(), asked, strict=True):
            q = np.append(v.astype(np.float64), 0.0)
            out += [(own, -i, s) for s, i in tree.search(q, k, lambda rows, v=v: exact[rows] @ v, ids, own)]
    return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors, queries: (vec_id, v array<long>)."""
    sized = lambda df: df.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v", F.size("v").alias("dim"))
    vectors, queries = sized(vectors), sized(queries).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    blocks, asked = max(1, math.ceil(facts["n"] / block)), max(1, math.ceil(queries.count() / query_block))
    m = facts["m"] or 0.0
    # every block of vectors meets every block of queries: an equi-join on the pair of blocks, no rows crossed
    left = vectors.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("q"))
    right = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(asked)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    key = ["dim", F.col("b").cast("long"), F.col("q").cast("long")]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda v, q: _search(v, q, k, m), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors with null or non-finite components left out."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return embeddings.where(F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
