"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts, the more the more rows there are; a small
classifier learns where each vector's neighbours lie. It places every row in its most probable part, and sends each query
to several, as many as hold the wanted share of neighbours in a part of the sample that it didn't learn from; in these,
candidates are ranked by the exact measure. Parts are worked on in blocks of bounded size, so neither a large part nor one
vector with very many copies lands in one task.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.llm.sampling import first_by_hash
from assaya.shared import cut

#: Rows of a block: candidates and queries.
VECTORS, QUERIES = 8192, 2048


@dataclass
class Router:
    """Two layers and a softmax; ``scores`` are its logits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row by inner product, in blocks of rows."""
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        near = x[lo : lo + 1024] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float, rounds: int, rng) -> np.ndarray:
    """A part for each row: seeded by nearest centres, then rows move to the part of most of their neighbours, the
    largest gains first, while that part has room for ``slack`` times the mean."""
    room = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(4):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    wish = x @ centres.T
    part, size = np.full(len(x), -1), np.zeros(parts, dtype=np.int64)
    for i in np.argsort(-wish.max(axis=1), kind="stable"):
        for p in np.argsort(-wish[i], kind="stable"):
            if size[p] < room:
                part[i], size[p] = p, size[p] + 1
                break
    rows = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(votes, (rows, part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), part[rows]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, rng) -> Router:
    """``target``: for each row the shares of its neighbours in each part, which is where a query like it should look."""
    parts = target.shape[1]
    weights = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            at = order[lo : lo + 256]
            inner = np.maximum(x[at] @ weights[0] + weights[1], 0)
            p = inner @ weights[2] + weights[3]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p -= target[at]
            p /= len(at)
            back = (p @ weights[2].T) * (inner > 0)
            step += 1
            for k, g in enumerate((x[at].T @ back, back.sum(axis=0), inner.T @ p, p.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def parts_for(n: int, most: int) -> int:
    """Parts for ``n`` rows: they grow with the root of n, as long as the sample has 48 rows for each."""
    return max(1, min(round(0.14 * n**0.5), min(n, most) // 48))


def fit(vectors: DataFrame, parts: int | None, most: int, recall: float, neighbours: int = 20, slack: float = 1.15, rounds: int = 6, hidden: int = 128, epochs: int = 15, seed: int = 5) -> tuple[Router, float, int]:
    """The router, the length by which its input is scaled, and how many parts to search for a share ``recall`` of the
    neighbours; from at most ``most`` rows in the order of a hash, a tenth of which only serve to count."""
    n = vectors.count()
    rows = first_by_hash(vectors, F.xxhash64("id", "vec"), most, "id").select("vec").collect()
    x = np.array([r["vec"] for r in rows], dtype=np.float64)
    scale = float(np.linalg.norm(x, axis=1).mean())
    x /= scale
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts or parts_for(n, most), len(x) // 8))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), scale, 1
    graph = neighbour_graph(x, min(neighbours, len(x) - 1))
    part = balanced_parts(x, graph, parts, slack, rounds, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    held = np.arange(len(x)) % 10 == 0
    router = train_router(x[~held], target[~held], hidden, epochs, rng)
    place = router.scores(x).argmax(axis=1)
    order = np.argsort(-router.scores(x[held]), axis=1, kind="stable")
    ranks = np.argsort(order, axis=1)  # of each part for each row
    needed = np.take_along_axis(ranks, place[graph[held]], axis=1).ravel()
    return router, scale, int(np.quantile(needed, recall, method="higher")) + 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a finite vector that isn't zero, of the length that most such rows have (ties: the
    longest)."""
    vec = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size("vec") == (sizes[0]["size"] if sizes else 0))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, parts: int | None = None, recall: float = 0.95, most: int = 12_000, id_col: str = "vec_id", vec_col: str = "embedding", **settings
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query id the ``k`` nearest others found, by inner product in doubles.

    ``queries`` are rows of the same kind; a query's candidates are all rows with another id. Equal scores go by the
    smaller id. Rows that repeat an id are candidates each; a query id is searched once, by the least of its vectors (the first component counts most). Unusable
    rows (see ``usable``) take no part. The router is fitted on at most ``most`` rows, all rows are indexed. Parts are
    searched in the order of their probability: those that ``recall`` asks for, and further ones until they hold ``k``
    candidates; so fewer than ``k`` rows come back only where there are fewer candidates.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = cut(usable(vectors, id_col, vec_col))
    if rows.isEmpty():
        return spark.createDataFrame([], result)
    router, scale, probes = fit(rows, parts, most, recall, **settings)
    parts = len(router.b2)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    own = rows.join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    asked = cut(asked.join(own, "id", "left").select("id", "vec", F.coalesce("own", F.lit(0)).alias("own")))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()) / scale
                yield pd.DataFrame({"part": router.scores(x).argmax(axis=1), "id": pdf["id"], "vec": pdf["vec"]})

    schema = "part int, id long, vec array<double>"
    counts = lambda df: {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}  # noqa: E731  a row for each part
    placed = cut(rows.mapInPandas(place, schema))
    n_vectors = counts(placed)
    sizes = np.array([n_vectors.get(p, 0) for p in range(parts)])

    def route(batches):
        for pdf in batches:
            if len(pdf):
                order = np.argsort(-router.scores(np.stack(pdf["vec"].to_numpy()) / scale), axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                enough = (held < (k + pdf["own"].to_numpy())[:, None]).sum(axis=1) + 1
                tried = np.minimum(np.maximum(enough, probes), parts)
                rows = np.repeat(np.arange(len(pdf)), tried)
                yield pd.DataFrame({"part": np.concatenate([o[:t] for o, t in zip(order, tried)]), "id": pdf["id"].to_numpy()[rows], "vec": pdf["vec"].to_numpy()[rows]})

    routed = cut(asked.mapInPandas(route, schema))
    n_queries = counts(routed)
    blocks = lambda n, most: F.array(*[F.lit(max(1, -(-n.get(p, 0) // most))) for p in range(parts)])
    v_blocks, q_blocks = F.get(blocks(n_vectors, VECTORS), F.col("part")), F.get(blocks(n_queries, QUERIES), F.col("part"))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vec"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.select("part", dealt(v_blocks).alias("v"), every(q_blocks).alias("q"), "id", "vec")
    right = routed.select("part", every(v_blocks).alias("v"), dealt(q_blocks).alias("q"), "id", "vec")

    def rank(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(candidates) or not len(asked):
            return none
        candidates = candidates.sort_values("id", kind="stable")
        ids, x = candidates["id"].to_numpy(), np.stack(candidates["vec"].to_numpy())
        found = []
        for lo in range(0, len(asked), 128):
            part = asked.iloc[lo : lo + 128]
            q = np.stack(part["vec"].to_numpy())
            near = q @ x.T
            own_id = part["id"].to_numpy()
            near[own_id[:, None] == ids[None, :]] = -np.inf
            at = min(k, near.shape[1]) - 1
            least = -np.partition(-near, at, axis=1)[:, at]
            for i, one in enumerate(own_id):
                margin = 1e-9 * (1 + abs(least[i])) if np.isfinite(least[i]) else 0
                some = np.flatnonzero((near[i] >= least[i] - margin) & (near[i] > -np.inf))
                exact = (x[some] * q[i]).sum(axis=1)  # the same sum for equal vectors, in any block
                best = np.lexsort((ids[some], -exact))[:k]
                found.append(pd.DataFrame({"query_id": one, "vec_id": ids[some][best], "score": exact[best]}))
        return pd.concat(found, ignore_index=True)

    keys = ["part", "v", "q"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
