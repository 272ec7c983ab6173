"""Approximate nearest neighbours: balanced partitions of a neighbour graph and a classifier that routes queries."""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.sources import drop_table, materialize, read_table, ship

TOP = 20
EVERY = 20
#: Vectors on which partitions and classifier are fitted, on the driver; a fixed bound for any table.
SAMPLE = 4096
#: Sampled vectors that a partition has at least; the sample's size alone says how many partitions there are.
PART_SAMPLE = 32
#: Rows of a partition that is partitioned again, by a sample of its own.
SPLIT_ROWS = 1 << 18
#: Neighbours of each sampled vector in the graph.
DEGREE = 16
#: Queries go to the most probable partitions until they hold this much of the expected neighbours.
MASS = 0.97
#: Numbers in one block of rows, or of queries, of a partition that a task holds, and queries that it compares at once.
BLOCK, QUERY_BLOCK = 1 << 21, 1024
#: Rows that a task compares at once.
ROW_SLICE = 4096
#: Partitions of one router at most, as the sample is bounded.
MOST_PARTS = SAMPLE // PART_SAMPLE
#: Scores of a matrix product this close to the last place are computed anew, one by one, in a fixed order.
CLOSE = 1e-9


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Rows of the ``degree`` largest inner products of each row, itself excluded, in blocks."""
    out = []
    for a in range(0, len(x), 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(degree, len(x) - 1) - 1, axis=1)[:, :degree])
    return np.concatenate(out)


def bisect(links: list[np.ndarray], members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Halve ``members`` exactly, cutting few links: the second eigenvector of the walk, split at its median."""
    place = {int(m): i for i, m in enumerate(members)}
    pairs = [(i, place[int(n)]) for i, m in enumerate(members) for n in links[m] if int(n) in place]
    a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    src, dst = np.r_[a, b], np.r_[b, a]
    degree = np.maximum(np.bincount(src, minlength=len(members)), 1)
    v = rng.normal(size=len(members))
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(src, v[dst], len(members)) / degree
        v /= np.linalg.norm(v) or 1
    order = np.argsort(v, kind="stable")
    return members[order[: len(order) // 2]], members[order[len(order) // 2 :]]


def partition_graph(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Part of each node: recursive bisection into a power of two of parts whose sizes differ by at most one."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(list(graph), g, rng)]
    out = np.zeros(len(graph), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


class Router:
    """A small network (one hidden layer) from a vector to the shares of its neighbours in each partition."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 40, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w1 = rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1])
        self.b1, self.w2, self.b2 = np.zeros(hidden), np.zeros((hidden, target.shape[1])), np.zeros(target.shape[1])
        x = self._unit(x)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self._all()]
        t = 0
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                t += 1
                h = np.maximum(x[at] @ self.w1 + self.b1, 0)
                g = (self._softmax(h @ self.w2 + self.b2) - target[at]) / len(at)
                back = (g @ self.w2.T) * (h > 0)
                steps = (x[at].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))
                for p, d, (m, v) in zip(self._all(), steps, state, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def _all(self):
        return (self.w1, self.b1, self.w2, self.b2)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top
        return x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def shares(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self._unit(x) @ self.w1 + self.b1, 0)
        return self._softmax(h @ self.w2 + self.b2)


def fit_router(x: np.ndarray, part_sample: int = PART_SAMPLE) -> Router:
    """Partitions of the neighbour graph of sampled vectors, and the router that learns them."""
    parts = 1
    while 2 * parts * part_sample <= len(x):
        parts *= 2
    if parts == 1:
        return Router(x[:1], np.ones((1, 1)), rounds=0)
    part = partition_graph(neighbour_graph(Router._unit(x)), parts)
    target = np.zeros((len(x), parts))
    near = neighbour_graph(Router._unit(x) if not np.isfinite(x @ x.T).all() else x, TOP)
    for k in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[near[:, k]]), 1)
    target[np.arange(len(x)), part] += 2
    return Router(x, target / target.sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, sample: int = SAMPLE, part_sample: int = PART_SAMPLE) -> Router:
    """Partitions and router from ``sample`` vectors: those with the smallest hashes of vector and id."""
    some = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    return fit_router(_matrix(some), part_sample)


def fit_within(placed: DataFrame, large: DataFrame, sample: int = SAMPLE, part_sample: int = PART_SAMPLE) -> dict[int, Router]:
    """A router for each of the partitions ``large`` (``part, rows``), each fitted in a task on a sample of its rows."""
    rate = F.lit(float(sample)) / F.col("rows")
    drawn = (F.xxhash64("vec_id", "v", F.lit(5)) / F.lit(float(1 << 63)) + 1) / 2 < rate
    some = placed.join(F.broadcast(large), "part").where(drawn).select("part", "v")

    def train(table: pa.Table) -> pa.Table:
        made = fit_router(_matrix(table.column("v").combine_chunks())[: 2 * sample], part_sample)
        return pa.table({"part": table.column("part").slice(0, 1), "router": pa.array([pickle.dumps(made)], pa.binary())})

    return {r.part: pickle.loads(r.router) for r in some.groupBy("part").applyInArrow(train, "part int, router binary").collect()}


def _matrix(column) -> np.ndarray:
    flat = column.values if hasattr(column, "values") else column.flatten()
    return flat.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _routed(rows: DataFrame, routers: dict[int, Router], mass: float | None) -> DataFrame:
    """``vec_id, part, nth, v``: the most probable partition, or with ``mass`` each of the most probable up to it.

    ``routers`` has the first router by -1, and by the number of a partition of that one its own, if it has one.
    """
    sent = rows.sparkSession.sparkContext.broadcast(routers)

    def visits(router: Router, x: np.ndarray):
        """Rows of ``x``, partitions and their places in the order of a row."""
        shares = router.shares(x)
        if mass is None:
            return np.arange(len(shares)), shares.argmax(axis=1), np.zeros(len(shares), np.int64)
        order = np.argsort(-shares, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(shares, order, 1), axis=1) - np.take_along_axis(shares, order, 1)
        at, k = np.nonzero(before < mass)
        return at, order[at, k], k

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            found = []
            at, part, nth = visits(sent.value[-1], x)
            for p in np.unique(part):
                here = part == p
                if int(p) in sent.value:
                    inner, sub, k = visits(sent.value[int(p)], x[at[here]])
                    found.append((at[here][inner], (p + 1) * MOST_PARTS + sub, nth[here][inner] + k))
                else:
                    found.append((at[here], part[here], nth[here]))
            at, part, nth = (np.concatenate(c) for c in zip(*found, strict=True))
            pick = pa.array(at)
            columns = [batch.column(0).take(pick), pa.array(part.astype(np.int32)), pa.array(nth.astype(np.int32)), batch.column(1).take(pick)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "part", "nth", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, part int, nth int, v array<double>")


def best(query_id: np.ndarray, query: np.ndarray, floor: np.ndarray, row_id: np.ndarray, row: np.ndarray, top: int):
    """Yield (query_id, vec_id, score) arrays of the ``top`` rows of each query by exact score, ties to smaller ids.

    Rows that score less than the query's ``floor`` are left out: it has ``top`` others from elsewhere.
    """
    # Very large components would overflow the product: both sides are scaled for it, the scores are not.
    scale, width = np.abs(query).max(axis=1), np.abs(row).max()
    approx = (query / scale[:, None]) @ (row / width).T
    least = floor / scale / width
    same = query_id[:, None] == row_id[None, :]
    approx[same] = -np.inf
    k = min(top, approx.shape[1])
    last = np.partition(approx, approx.shape[1] - k, axis=1)[:, approx.shape[1] - k]
    last = np.maximum(last, least)
    near = (approx >= (last - CLOSE * (1 + np.abs(last)))[:, None]) & ~same
    for i in range(len(query_id)):
        at = np.flatnonzero(near[i])
        with np.errstate(over="ignore", invalid="ignore"):
            score = (row[at] * query[i]).sum(axis=1)
        keep = ~(score < floor[i])  # a sum of infinities is no number, but a candidate
        at, score = at[keep], score[keep]
        order = np.lexsort((row_id[at], -score))[:top]
        yield np.full(len(order), query_id[i]), row_id[at][order], score[order]


def search(
    vectors: DataFrame,
    every: int = EVERY,
    top: int = TOP,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    mass: float = MASS,
    sample: int = SAMPLE,
    part_sample: int = PART_SAMPLE,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest rows found for each row whose id ``every`` divides.

    Every row is in the partition that the router finds most probable for it. A query visits its most
    probable partitions, enough for ``mass`` of its expected neighbours, and all rows in them. A partition of
    more than ``split_rows`` rows has partitions and a router of its own. Partitions are cut into blocks by a
    hash of the id, so one that holds a third of all rows (copies of a vector, say) is many tasks' work.
    Scores are exact inner products in double precision. Null, zero and non-finite vectors take no part; nor
    do null ids. Vectors of different lengths have no inner product: those of each length are searched by
    themselves. A repeated id gives repeated candidates, and a query never finds its own id. Empty in, empty out.
    """
    spark = ship(vectors.sparkSession)
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for (length,) in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        out = out.unionByName(_search(rows.where(F.size("v") == length), length, every, top, mass, sample, part_sample, split_rows))
    return out


def _search(rows: DataFrame, length: int, every: int, top: int, mass: float, sample: int, part_sample: int, split_rows: int) -> DataFrame:
    routers = {-1: fit(rows, sample, part_sample)}
    placed = materialize(_routed(rows, routers, None))
    large = materialize(placed.groupBy("part").agg(F.count("*").alias("rows")).where(F.col("rows") > split_rows))
    if not large.isEmpty():
        routers |= fit_within(placed, large, sample, part_sample)
        first, placed = placed, materialize(_routed(rows, routers, None))
        drop_table(first)
    size = max(QUERY_BLOCK // 4, BLOCK // length)
    blocks = materialize(placed.groupBy("part").count().select("part", F.ceil(F.col("count") / size).cast("int").alias("blocks")))
    asked = materialize(_routed(rows.where(F.col("vec_id") % every == 0), routers, mass))
    met = _met(placed, asked.where("nth = 0").withColumn("floor", F.lit(float("-inf"))), blocks, top, size)
    # The first partition of a query has most of its neighbours: the others send only what beats them.
    near = materialize(_ranked(met, top))
    floors = near.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = asked.where("nth > 0").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    both = near.drop("rank").unionByName(_met(placed, rest, blocks, top, size))
    return _ranked(both, top).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)


def _met(placed: DataFrame, asked: DataFrame, blocks: DataFrame, top: int, size: int) -> DataFrame:
    """``query_id, vec_id, score``: best rows of each query of ``asked`` in each block of its partition.

    A block of rows meets a block of queries in one task, both of ``size`` at most on average. A partition's
    rows are sent once for each block of its queries, and partitions grow in number with the table.
    """
    asked = asked.drop("blocks")
    groups = materialize(asked.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("groups")))
    # A row a partition: MOST_PARTS of them, or its square where all are partitioned again.
    groups, blocks = F.broadcast(groups), F.broadcast(blocks)
    of_id = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col(n)).cast("int")
    left = placed.join(blocks, "part").join(groups, "part").withColumn("b", of_id(1, "blocks")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = asked.join(blocks, "part").join(groups, "part").withColumn("g", of_id(2, "groups")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def compare(_, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = []
        if len(mine) and len(theirs):
            take = lambda t: (t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks()))
            (row_id, row), (query_id, query) = take(mine), take(theirs)
            floor = theirs.column("floor").to_numpy()
            for a in range(0, len(query_id), QUERY_BLOCK):
                at = slice(a, a + QUERY_BLOCK)
                for b in range(0, len(row_id), ROW_SLICE):
                    part = slice(b, b + ROW_SLICE)
                    found += best(query_id[at], query[at], floor[at], row_id[part], row[part], top)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(p) for p in parts], names=["query_id", "vec_id", "score"])

    key = ("part", "b", "g")
    mine, theirs = left.select(*key, "vec_id", "v"), right.select(*key, "vec_id", "v", "floor")
    return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_ann": op4_ann}
ORACLE_SQL: dict[str, str] = {}
