"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

*Metric.* With ``M`` the largest norm of all vectors, each vector ``x`` gets one more
component, the root of ``M^2 - |x|^2``; a query gets zero there. Then the squared Euclidean
distance is ``|q|^2 + M^2 - 2 q.x``: the order of distances is that of inner products, and
the triangle inequality holds.

*Trees.* Vectors are dealt to shards of at most about ``SHARD`` rows by a hash of their id.
In each shard a tree halves the points again and again by their distance from a vantage
point, by rank, so that equal vectors cannot unbalance it, and notes the nearest and
farthest distance in each half.

*Search.* Every block of queries meets every shard's tree. The bounds of the vantage points
give each leaf a least distance; a query visits leaves in that order until its bound,
times ``factor``, exceeds the distance of its k-th best so far. Factor 1 is exact search;
larger ones visit fewer leaves. Matrix products choose candidates with a margin above their
rounding; the scores given are sums in double precision in the order of components. The
best of all shards are then ranked by id and score.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no
part, nor do rows without id; of rows with one id the smallest vector counts; shorter
vectors count as padded by zeros; ties go to the smaller id; fewer candidates than ``k``
are all returned; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

K = 20
SHARD = 8192
LEAF = 128
QUERY_ROWS = 4096
FACTOR = 1.0

# Margins: of matrix products (times the norms), and of distances (times the largest one).
PRODUCT_MARGIN = 1e-12
DISTANCE_MARGIN = 1e-6


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (as doubles) of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad & some)
    one = rows.groupBy(F.col(vec_id).alias("vec_id")).agg(F.min(vector).alias("vector"))
    return one.select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))


def build(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree over the rows of ``points``.

    ``order`` lists the rows leaf by leaf, ``ends`` where leaves end. Node ``i`` has a
    vantage point (a row), two children and for each child the range of distances in it;
    children >= 0 are nodes, others leaves (``-1 - leaf``).
    """
    vantage, child, low, high, ends, order = [], [], [], [], [], []
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        if len(rows) <= leaf:
            me = -1 - len(ends)
            order.append(rows)
            ends.append((ends[-1] if ends else 0) + len(rows))
        else:
            me = len(vantage)
            block = points[rows]
            center = block.mean(axis=0)
            top = rows[int(((block - center) ** 2).sum(axis=1).argmax())]
            distance = np.sqrt(((block - points[top]) ** 2).sum(axis=1))
            ranked = np.argsort(distance, kind="stable")
            half = len(rows) // 2
            near, far = ranked[:half], ranked[half:]
            vantage.append(top)
            child.append([0, 0])
            low.append([distance[near[0]], distance[far[0]]])
            high.append([distance[near[-1]], distance[far[-1]]])
            stack.append((rows[far], me, 1))
            stack.append((rows[near], me, 0))
        if parent >= 0:
            child[parent][side] = me
    return {
        "vantage": np.array(vantage, np.int64),
        "child": np.array(child, np.int64).reshape(-1, 2),
        "low": np.array(low, np.float64).reshape(-1, 2),
        "high": np.array(high, np.float64).reshape(-1, 2),
        "ends": np.array(ends, np.int64),
        "order": np.concatenate(order) if order else np.zeros(0, np.int64),
    }


def leaf_bounds(tree: dict[str, np.ndarray], distance: np.ndarray) -> np.ndarray:
    """Least distance of each query (row) from any point of each leaf, by its distances from the vantage points."""
    out = np.zeros((len(distance), len(tree["ends"])))
    bound = np.zeros((len(distance), len(tree["vantage"])))
    for node in range(len(tree["vantage"])):  # parents come before their children
        d = distance[:, node]
        for side in (0, 1):
            least = np.maximum(d - tree["high"][node, side], tree["low"][node, side] - d)
            least = np.maximum(bound[:, node], least)
            to = tree["child"][node, side]
            if to >= 0:
                bound[:, to] = least
            else:
                out[:, -1 - to] = least
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def search(
    tree: dict, ids: np.ndarray, vectors: np.ndarray, largest: float, query_ids: np.ndarray, queries: np.ndarray,
    k: int = K, factor: float = FACTOR,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's ``k`` best in this tree, the query's own id left out."""
    n = len(queries)
    norms = np.sqrt((queries**2).sum(axis=1))
    base = norms**2 + largest**2
    slack = DISTANCE_MARGIN * np.sqrt(base)
    vantage = np.sqrt(np.maximum(base[:, None] - 2 * queries @ vectors[tree["vantage"]].T, 0))
    bounds = leaf_bounds(tree, vantage)
    visits = np.argsort(bounds, axis=1, kind="stable")
    margin = PRODUCT_MARGIN * norms * largest
    best_score, best_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    begins = np.concatenate(([0], tree["ends"][:-1])).astype(np.int64)
    for turn in range(bounds.shape[1]):
        leaves = visits[:, turn]
        kth = best_score[:, -1]
        reach = np.sqrt(np.maximum(base - 2 * np.where(np.isfinite(kth), kth, -largest * norms), 0))
        least = bounds[np.arange(n), leaves]
        active = np.nonzero((least - slack) * factor <= reach)[0]
        if not len(active):
            break
        active = active[np.argsort(leaves[active], kind="stable")]
        cuts = np.nonzero(np.diff(leaves[active]))[0] + 1
        for block in np.split(active, cuts):
            leaf = leaves[block[0]]
            rows = tree["order"][begins[leaf] : tree["ends"][leaf]]
            about = queries[block] @ vectors[rows].T
            about[query_ids[block][:, None] == ids[rows][None, :]] = -np.inf
            limit = best_score[block, -1]
            if len(rows) >= k:
                limit = np.maximum(limit, np.partition(about, -k, axis=1)[:, -k])
            found = (about >= (limit - 2 * margin[block])[:, None]) & np.isfinite(about)
            q, r = np.nonzero(found)
            if not len(q):
                continue
            score = exact_products(queries[block[q]], vectors[rows[r]])
            touched = np.unique(q)
            row = np.concatenate((np.repeat(touched, k), q))
            scores = np.concatenate((best_score[block[touched]].ravel(), score))
            names = np.concatenate((best_id[block[touched]].ravel(), ids[rows[r]]))
            ranked = np.lexsort((names, -scores, row))
            row = row[ranked]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = ranked[place < k]
            best_score[block[touched]] = scores[first].reshape(-1, k)
            best_id[block[touched]] = names[first].reshape(-1, k)
    q, at = np.nonzero(np.isfinite(best_score))
    return q, best_id[q, at], best_score[q, at]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def index(rows: DataFrame, shard_rows: int = SHARD, leaf: int = LEAF) -> tuple[DataFrame, dict[str, float]]:
    """One tree per shard (shard, tree as bytes) over :func:`usable` rows; sizes of the whole index."""
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(squares)).head()
    facts = {"rows": n, "dim": dim or 0, "largest": float(np.sqrt(most or 0.0)), "shards": max(1, -(-n // shard_rows))}

    def plant(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        vectors = _matrix(part["vector"], facts["dim"])
        rest = np.sqrt(np.maximum(facts["largest"] ** 2 - (vectors**2).sum(axis=1), 0))
        tree = build(np.column_stack((vectors, rest)), leaf)
        out = io.BytesIO()
        np.savez(out, ids=part["vec_id"].to_numpy(np.int64), vectors=vectors, **tree)
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "tree": [out.getvalue()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(facts["shards"])))
    trees = dealt.groupBy("shard").applyInPandas(plant, "shard bigint, tree binary")
    return materialise(trees, "trees"), facts


def nearest(
    trees: DataFrame, facts: dict[str, float], queries: DataFrame, k: int = K, factor: float = FACTOR,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query (rows of :func:`usable`)."""
    n_blocks = max(1, -(-queries.count() // query_rows))
    shards = F.explode(F.sequence(F.lit(0), F.lit(facts["shards"] - 1)).cast("array<bigint>")).alias("shard")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")
    asked = queries.select("vec_id", "vector", block).select("vec_id", "vector", "block", shards)
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")).alias("block")
    dim, largest = facts["dim"], facts["largest"]

    def look(tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stored = dict(np.load(io.BytesIO(tree["tree"].iloc[0])))
        names = block["vec_id"].to_numpy(np.int64)
        found = search(
            stored, stored["ids"], stored["vectors"], largest, names, _matrix(block["vector"], dim), k, factor
        )
        return pd.DataFrame({"query_id": names[found[0]], "vec_id": found[1], "score": found[2]})

    best = (
        trees.select("shard", "tree", copies).groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(look, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, every: int = 20, k: int = K, factor: float = FACTOR) -> DataFrame:
    """The nearest of each row whose id is divisible by ``every``, among all other rows."""
    rows = materialise(usable(vectors), "vectors")
    trees, facts = index(rows)
    return nearest(trees, facts, rows.where(F.col("vec_id") % every == 0), k, factor)
