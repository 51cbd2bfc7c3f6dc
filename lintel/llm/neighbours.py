"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on at most `sample` distinct vectors (those with the smallest hashes of their ids) and every vector is put into a
leaf. A query goes down best bin first: a priority queue holds nodes by an estimate of their best inner product, inner nodes are
replaced by their children, and leaves come out in the order of their promise. How many leaves to visit is calibrated: for
`calibrate` of the queries the true neighbours are found by a blocked scan of all vectors, and visits are widened until the mean
recall on them reaches `recall`.

Leaves grow once there are more than most_leaves * leaf_size vectors; what a query visits grows with them from there on.

Leaves are dealt out in runs of neighbouring leaves of about `block` vectors; larger ones, and more than `per_task` queries of a
run, are split into several blocks, so a task's memory is bounded whatever the data. Equal vectors are one candidate that keeps its
k + 1 smallest ids, which is all that any answer can hold of them; equal queries are searched once.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
rows that repeat an id and a vector count once; ties go to the smaller id; with fewer candidates than k all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.llm.common import staged


class Tree:
    """Nodes in arrays: centre, spread, first and last child (or leaf number); leaves are numbered in tree order."""

    def __init__(self, vectors: np.ndarray, leaf_size: int, branching: int = 8, seed: int = 3):
        self.rng, self.leaf_size, self.branching = np.random.default_rng(seed), leaf_size, branching
        self.centres, self.spread, self.children, self.leaf = [], [], [], []
        self.n_leaves = 0
        self._grow(vectors)
        self.centres, self.spread, self.leaf = np.array(self.centres), np.array(self.spread), np.array(self.leaf)
        self.rng = None

    def _grow(self, x: np.ndarray) -> int:
        me = len(self.centres)
        centre = x.mean(0)
        self.centres.append(centre)
        self.spread.append(float(np.sqrt(((x - centre) ** 2).sum(1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        member = self._kmeans(x, min(self.branching, max(2, -(-len(x) // self.leaf_size)))) if len(x) > self.leaf_size else None
        if member is None or len(set(member.tolist())) < 2:
            self.leaf[me], self.n_leaves = self.n_leaves, self.n_leaves + 1
            return me
        for j in sorted(set(member.tolist())):
            self.children[me].append(self._grow(x[member == j]))
        return me

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
        c = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            member = self._nearest(x, c)
            size = np.bincount(member, minlength=k)
            c = np.where(size[:, None] > 0, np.stack([np.bincount(member, x[:, j], k) for j in range(x.shape[1])], 1) / np.maximum(size, 1)[:, None], c)
        return self._nearest(x, c)

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest centre at every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            pick = self._nearest(x[rows], self.centres[kids])
            todo.extend((int(kids[j]), rows[pick == j]) for j in set(pick.tolist()))
        return out

    def order(self, q: np.ndarray, visits: int) -> list[int]:
        """The `visits` most promising leaves, best first."""
        promise = self.centres @ q + 0.5 * np.sqrt(q @ q) * self.spread
        queue, found = [(-promise[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
            for kid in self.children[node]:
                heapq.heappush(queue, (-promise[kid], kid))
        return found


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of rows that take part."""
    big = F.lit(float("inf"))
    ok = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & ok)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def _best(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "cid"))).where(F.col("_k") <= k).drop("_k")


def _found(q_ids: np.ndarray, q: np.ndarray, cids: np.ndarray, x: np.ndarray, scores: np.ndarray, k: int, pairs: int = 1 << 20) -> pd.DataFrame:
    """The k best columns of each row of scores, ties to the smaller id; scores are computed anew, each pair alike wherever it is met."""
    least = np.full(len(q), -np.inf)
    if scores.shape[1] > k:
        # all that may tie with the k-th place, whatever the product of blocks rounds
        least = np.partition(scores, -k, axis=1)[:, -k] - 1e-9 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    out, step = [], max(1, pairs // max(1, scores.shape[1]))
    for a in range(0, len(q), step):
        row, col = np.nonzero((scores[a : a + step] >= least[a : a + step, None]) & np.isfinite(scores[a : a + step]))
        row += a
        exact = np.concatenate([np.zeros(0), *((q[row[i : i + 65536]] * x[col[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536))])
        order = np.lexsort((cids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append(pd.DataFrame({"qid": q_ids[row[first]], "cid": cids[col[first]], "score": exact[first]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"qid": [], "cid": [], "score": []}).astype({"qid": "int64", "cid": "int64"})


def true_neighbours(classes: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """qid, cid, score, leaf of the k best classes of a bounded block of queries, by a scan of all vectors."""
    block = classes.sparkSession.sparkContext.broadcast((queries["cid"].to_numpy(), matrix(queries["vec"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = block.value
        for pdf in batches:
            x = matrix(pdf["vec"])
            out = _found(ids, q, pdf["cid"].to_numpy(), x, q @ x.T, k)
            yield out.merge(pdf[["cid", "leaf"]], on="cid")

    return _best(classes.select("cid", "vec", "leaf").mapInPandas(scan, "qid long, cid long, score double, leaf long"), "qid", k)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, sample: int = 100_000, calibrate: int = 200,
    leaf_size: int = 256, most_leaves: int = 16384, block: int = 8192, per_task: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score for every usable row of `queries` (rows of the same kind as `vectors`)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    # equal vectors: one class with its k + 1 smallest ids
    ranked = rows.withColumn("_k", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_k") <= k + 1)
    classes = staged(ranked.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "ids", "vec"), "classes")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = classes.select("cid", "vec").orderBy(F.xxhash64(F.lit(5), "cid"), "cid").limit(sample).toPandas()
    leaves = min(most_leaves, max(1, total // leaf_size))
    tree = spark.sparkContext.broadcast(Tree(matrix(picked["vec"]), max(4, -(-len(picked) // leaves))))

    @F.pandas_udf("long")
    def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vecs in batches:
            yield pd.Series(tree.value.assign(matrix(vecs)) if len(vecs) else np.zeros(0, np.int64))

    classes = staged(classes.withColumn("leaf", leaf_of("vec")), "leaves")
    asked = usable(queries, id_col, vec_col).join(classes.select("vec", "cid"), "vec")
    asked = staged(asked.select(F.col("id").alias("query_id"), "cid").distinct(), "asked")
    starts = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "vec", "leaf")
    tested = starts.orderBy(F.xxhash64(F.lit(9), "cid"), "cid").limit(calibrate).join(classes.select("cid", (F.size("ids") > 1).alias("shared")), "cid").toPandas()
    if not len(tested):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the query's own vector is no neighbour, unless it has another id
    alone = tested.loc[~tested["shared"], "cid"].tolist()
    truth = true_neighbours(classes, tested, min(k + 1, total)).toPandas()  # calibrate * (k + 1) rows
    truth = truth[(truth["qid"] != truth["cid"]) | ~truth["qid"].isin(alone)].sort_values(["qid", "score"], ascending=[True, False], kind="stable").groupby("qid").head(k)
    place = {c: {leaf: i for i, leaf in enumerate(tree.value.order(v, tree.value.n_leaves))} for c, v in zip(tested["cid"], matrix(tested["vec"]), strict=True)}
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["qid"], truth["leaf"], strict=True)] or [1])
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])

    # runs of leaves: about `block` vectors each, or one larger leaf split into parts
    size = {r["leaf"]: r["n"] for r in classes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most most_leaves rows
    run_of, parts, run, held = np.zeros(tree.value.n_leaves, np.int64), {}, 0, 0
    for leaf in range(tree.value.n_leaves):
        n = size.get(leaf, 0)
        if held and held + n > block:
            run, held = run + 1, 0
        run_of[leaf], held = run, held + n
        parts[run] = -(-held // block) or 1

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cid, vec, q in zip(pdf["cid"], pdf["vec"], matrix(pdf["vec"]), strict=True):
                by_run: dict[int, list[int]] = {}
                for leaf in tree.value.order(q, visits):
                    by_run.setdefault(int(run_of[leaf]), []).append(leaf)
                out.extend((cid, vec, r, x) for r, x in by_run.items())
            yield pd.DataFrame(out, columns=["qid", "vec", "run", "leaves"])

    trips = staged(starts.select("cid", "vec").mapInPandas(visit, f"qid long, vec {classes.schema['vec'].dataType.simpleString()}, run long, leaves array<long>"), "trips")
    callers = {r["run"]: -(-r["n"] // per_task) for r in trips.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    # where each leaf, and each run, lies: at most most_leaves rows
    layout = [(leaf, int(run_of[leaf]), parts[int(run_of[leaf])], callers[int(run_of[leaf])]) for leaf in range(tree.value.n_leaves) if int(run_of[leaf]) in callers]
    of_leaf = F.broadcast(spark.createDataFrame(layout, "leaf long, run long, ms int, qs int"))
    of_run = F.broadcast(spark.createDataFrame(sorted({x[1:] for x in layout}), "run long, ms int, qs int"))
    block_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    members = classes.select("cid", "vec", "leaf").join(of_leaf, "leaf").withColumn("m", block_of("cid", "ms")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    calls = trips.join(of_run, "run").withColumn("q", block_of("qid", "qs")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    members, calls = members.select("cid", "vec", "leaf", "run", "q", "m"), calls.select("qid", "vec", "leaves", "run", "q", "m")

    def meet(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"qid": [], "cid": [], "score": []}).astype({"qid": "int64", "cid": "int64"})
        q, x = matrix(qs["vec"]), matrix(xs["vec"])
        here, member = np.unique(xs["leaf"].to_numpy(), return_inverse=True)
        seen = np.zeros((len(q), len(here) + 1), bool)
        asks = np.concatenate([np.asarray(v) for v in qs["leaves"]])
        at = np.minimum(np.searchsorted(here, asks), len(here) - 1)
        seen[np.repeat(np.arange(len(q)), [len(v) for v in qs["leaves"]]), np.where(here[at] == asks, at, len(here))] = True
        scores = np.where(seen[:, member], q @ x.T, -np.inf)
        return _found(qs["qid"].to_numpy(), q, xs["cid"].to_numpy(), x, scores, k + 1)

    keys = ["run", "q", "m"]
    met = calls.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(meet, "qid long, cid long, score double")
    best = _best(met, "qid", k + 1)
    ids = best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), "vec_id"]
    nearest = ids.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("_k") <= k + 1).drop("_k")
    pairs = asked.join(nearest, asked["cid"] == nearest["qid"]).where(F.col("vec_id") != F.col("query_id"))
    final = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
