"""Approximate nearest neighbours by inner product: an NN-descent graph built by Spark joins, and greedy search on it.

Equal vectors are one node. In each round the links of a node meet there: its neighbours hear of each other, by node
numbers only, unless both links met before. Workers compare the vectors in arrays that they map into memory. The search walks the finished graph, mapped likewise,
from the query's own node, best node first, until none of the ``beam`` best is left to expand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.arrays import mapped, put
from flowloom.llm.common import drop, map_batches, shared_dir, written


def usable(vector: Column) -> Column:
    """Vectors that aren't null or zero and have only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Vectors:
    """The nodes' vectors, in files of consecutive numbers, with a last component that makes all norms equal."""

    def __init__(self, top: str, firsts: list[int], dim: int, most: float, kind: str):
        self.top, self.firsts, self.dim, self.most, self.kind = top, firsts, dim, most, kind

    @property
    def count(self) -> int:
        return self.firsts[-1]

    def file(self, k: int) -> np.ndarray:
        return mapped(f"{self.top}/vectors-{k:05d}").view(self.kind).reshape(-1, self.dim)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The original vectors of some numbers."""
        if len(self.firsts) == 2:
            return self.file(0)[numbers]
        out = np.empty((len(numbers), self.dim), self.kind)
        owner = np.searchsorted(self.firsts, numbers, "right") - 1
        for k in np.unique(owner):
            own = owner == k
            out[own] = self.file(int(k))[numbers[own] - self.firsts[k]]
        return out

    def even(self, numbers: np.ndarray) -> np.ndarray:
        """Vectors in single precision, with the component that makes all norms the largest norm."""
        x = self.take(numbers).astype(np.float32)
        rest = np.maximum(0, self.most**2 - np.einsum("ij,ij->i", x, x, dtype=np.float64))
        return np.column_stack([x, np.sqrt(rest).astype(np.float32)])


def numbered(rows: DataFrame, top: str, dim: int, kind: str) -> tuple[DataFrame, list[int]]:
    """(number, a, b) of the nodes in ``rows`` (a, b, v), whose vectors go to files; and each file's first number."""

    def save(batches):
        from pyspark import TaskContext

        part, parts, keys = TaskContext.get().partitionId(), [], []
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.select(["a", "b"]))
                parts.append(batch.column("v").flatten().to_numpy().reshape(-1, dim))
        at = 0
        if parts:
            put(f"{top}/vectors-{part:05d}", [np.concatenate(parts).astype(kind)])
        for k in keys:
            yield pa.RecordBatch.from_arrays([*k.columns, pa.array(np.full(k.num_rows, part, np.int32)), pa.array(np.arange(at, at + k.num_rows))], names=["a", "b", "part", "at"])
            at += k.num_rows

    saved = written(map_batches(rows, save, "a long, b long, part int, at long"), "nodes")
    sizes = dict(saved.groupBy("part").count().collect())  # one row for each partition
    firsts = [0]
    for k in range(max(sizes, default=-1) + 1):
        firsts.append(firsts[-1] + sizes.get(k, 0))
    base = F.array(*map(F.lit, firsts)) if len(firsts) < 2000 else F.lit(None)
    if len(firsts) >= 2000:
        table = rows.sparkSession.createDataFrame(list(enumerate(firsts)), "part int, base long")
        return saved.join(F.broadcast(table), "part").select((F.col("base") + F.col("at")).alias("number"), "a", "b"), firsts
    return saved.select((F.element_at(base, F.col("part") + 1).cast("long") + F.col("at")).alias("number"), "a", "b"), firsts


def both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """(v, near): each node's neighbours and up to ``degree`` of the nodes that have it as one, chosen by a hash."""
    ahead = graph.select("v", F.explode("near").alias("w"))
    first = Window.partitionBy("w").orderBy(F.xxhash64("v", "w"), "v")
    back = ahead.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= degree).select(F.col("w").alias("v"), F.col("v").alias("w"))
    return ahead.unionByName(back).groupBy("v").agg(F.collect_set("w").alias("near"))


def meetings(graph: DataFrame, sample: int, turn: int) -> DataFrame:
    """(v, links): the links that meet at each node in this round; links holds (w, fresh, met, back).

    A node's own links are all among them, and up to ``sample`` fresh and as many other ones of the nodes that have it as
    a neighbour (back). Such a link is met from both ends. A node offers at most ``sample`` of its fresh links a round, and
    a node that very many have as a neighbour takes only so many; the rest stay fresh and come up in a later round.
    """
    order = F.array_sort(F.transform("fresh", lambda w: F.struct(F.xxhash64(w, F.lit(turn)).alias("h"), w.alias("w"))))
    offered = F.transform(F.slice(order, 1, sample), lambda x: x["w"])
    links = graph.withColumn("offered", offered).select("v", "fresh", "offered", F.explode("near").alias("w"))
    links = links.select("v", "w", F.array_contains("fresh", F.col("w")).alias("fresh"), F.array_contains("offered", F.col("w")).alias("offered"))
    first = Window.partitionBy("w", "fresh").orderBy(F.xxhash64("v", "w", F.lit(turn)), "v")
    # the limit acts before the shuffle, too, so a node that all have as a neighbour isn't one large group
    taken = links.where("offered OR NOT fresh").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    link = lambda w, met, back: F.struct(w.alias("w"), F.col("fresh").alias("fresh"), F.lit(met).alias("met"), F.lit(back).alias("back"))
    ends = [
        links.select("v", link(F.col("w"), False, False).alias("link")),
        taken.select("v", link(F.col("w"), True, False).alias("link")),
        taken.select(F.col("w").alias("v"), link(F.col("v"), True, True).alias("link")),
    ]
    return ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("v").agg(F.collect_list("link").alias("links"))


def improved(met: DataFrame, vectors: Vectors, degree: int) -> DataFrame:
    """(v, near, fresh, gained): the ``degree`` nearest among each node's neighbours and those it hears of.

    Where links meet, each end hears of the others; two links that both met before have nothing to tell each other. fresh:
    neighbours whose link hasn't been met yet; gained: how many weren't neighbours before.
    """
    ends = lambda test: F.array_distinct(F.transform(F.filter("links", test), lambda x: x["w"]))
    known = met.select("links", "v", ends(lambda x: ~x["back"]).alias("near"), ends(lambda x: x["fresh"]).alias("fresh"), ends(lambda x: F.lit(True)).alias("all"))
    hears = F.array_distinct(F.filter("links", lambda x: x["met"]))
    told = known.select(F.explode(hears).alias("x"), "fresh", "all").select(F.col("x.w").alias("u"), F.when(F.col("x.fresh"), F.col("all")).otherwise(F.col("fresh")).alias("near"), F.lit(False).alias("own")).where(F.size("near") > 0)
    done = ends(lambda x: x["met"] & ~x["back"])
    unmet = F.array_except(ends(lambda x: x["fresh"] & ~x["back"]), done)
    own = known.select(F.col("v").alias("u"), "near", F.lit(True).alias("own"), unmet.alias("unmet"))
    told = own.unionByName(told.withColumn("unmet", F.array().cast("array<long>")))

    def best(batches):
        heard: list[np.ndarray] = []
        mine = unmet = np.zeros(0, np.int64)
        node = None
        for batch in batches:
            nodes, is_own = batch.column("u").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            (ends, values), (stops, left) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("near"), batch.column("unmet")))
            cuts = np.append(0, np.flatnonzero(nodes[1:] != nodes[:-1]) + 1) if len(nodes) else []
            found = []
            for a, b in zip(cuts, [*cuts[1:], len(nodes)], strict=True):
                if node is not None and nodes[a] != node:
                    found.append(nearest(node, heard, mine, unmet))
                    heard, mine, unmet = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
                node = int(nodes[a])
                heard.append(values[ends[a] : ends[b]])
                for k in a + np.flatnonzero(is_own[a:b]):
                    mine, unmet = values[ends[k] : ends[k + 1]], left[stops[k] : stops[k + 1]]
            if found:
                yield table(found)
        if node is not None:
            yield table([nearest(node, heard, mine, unmet)])

    def nearest(node, heard, mine, unmet):
        others = np.unique(np.concatenate(heard))
        others = others[others != node]
        if len(others) > degree:
            # row by row, so that a pair's product is the same in each round; ties go to the smaller number
            sims = np.einsum("ij,j->i", vectors.even(others), vectors.even(np.array([node]))[0])
            others = others[np.lexsort((others, -sims))[:degree]]
        new = ~np.isin(others, mine)
        return node, others, others[new | np.isin(others, unmet)], int(new.sum())

    def table(found):
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["v", "near", "fresh", "gained"])

    return map_batches(told.repartition("u").sortWithinPartitions("u"), best, "v long, near array<long>, fresh array<long>, gained long")


def build(nodes: DataFrame, vectors: Vectors, degree: int, rounds: int, sample: int, settled: float) -> DataFrame:
    """(v, near) of all nodes: from random neighbours, again and again the best of their neighbours' neighbours.

    Ends after the first round, from the ``rounds``-th on, that changes at most a share ``settled`` of all neighbours.
    Nodes only ever get better neighbours, by a total order, so there is such a round.
    """
    n = vectors.count
    if n == 1:
        return nodes.select(F.col("number").alias("v"), F.array().cast("array<long>").alias("near"))
    start = [F.pmod(F.xxhash64("number", F.lit(j)), F.lit(n)) for j in range(degree)]
    near = F.filter(F.array_distinct(F.array(*start)), lambda w: w != F.col("number"))
    graph = written(nodes.select(F.col("number").alias("v"), near.alias("near"), near.alias("fresh")), "graph")
    turn, share = 0, 1.0
    while turn < rounds or share > settled:
        before, met = graph, written(meetings(graph, sample, turn), "meetings")
        graph = written(improved(met, vectors, degree), "graph")
        turn += 1
        gained, total = graph.agg(F.sum("gained"), F.sum(F.size("near"))).first()
        share = gained / total if total else 0.0
        drop(before, met)
    return both_ways(graph, degree)


SHARD = 1 << 16


def saved_graph(around: DataFrame, top: str, width: int) -> None:
    """Writes the neighbours as rows of ``width`` numbers, filled up with -1, in files of SHARD nodes."""

    def save(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            v, near = batch.column("v").to_numpy(), batch.column("near")
            ends, values = near.offsets.to_numpy(), near.values.to_numpy()
            for s in np.unique(v // SHARD):
                for k in np.flatnonzero(v // SHARD == s):
                    parts.setdefault(int(s), []).append((int(v[k]) % SHARD, values[ends[k] : ends[k + 1]]))
        for s, rows in parts.items():
            out = np.full((max(at for at, _ in rows) + 1, width), -1, np.int64)
            for at, near in rows:
                out[at, : len(near)] = near
            put(f"{top}/graph-{s:05d}", [out])
            yield pa.RecordBatch.from_pydict({"shard": [s]})

    map_batches(around.repartition(F.floor(F.col("v") / SHARD)), save, "shard long").agg(F.count("*")).collect()


def walk(x: np.ndarray, start: int, vectors: Vectors, top: str, width: int, beam: int, step: int = 32) -> np.ndarray:
    """The ``beam`` best nodes met on the way from ``start``, which is among them."""

    def around(numbers: np.ndarray) -> np.ndarray:
        out = []
        for s in np.unique(numbers // SHARD):
            out.append(mapped(f"{top}/graph-{s:05d}").view(np.int64).reshape(-1, width)[numbers[numbers // SHARD == s] % SHARD].ravel())
        out = np.unique(np.concatenate(out))
        return out[out >= 0]

    seen = np.array([start])
    best, sims, open_ = np.array([start]), np.array([np.inf], np.float32), np.array([True])
    query = x.astype(np.float32)
    while open_.any():
        todo = np.flatnonzero(open_)[:step]  # best first
        open_[todo] = False
        new = around(best[todo])
        new = new[~np.isin(new, seen, assume_unique=True)]
        if not len(new):
            continue
        seen = np.union1d(seen, new)
        best, sims, open_ = np.append(best, new), np.append(sims, vectors.take(new).astype(np.float32) @ query), np.append(open_, np.ones(len(new), bool))
        order = np.argsort(-sims, kind="stable")[:beam]
        best, sims, open_ = best[order], sims[order], open_[order]
    return best


def search(vecs: DataFrame, every: int = 20, k: int = 20, degree: int = 24, rounds: int = 4, sample: int = 16, beam: int = 768, settled: float = 0.01) -> DataFrame:
    """query_id, rank, vec_id and score: for each vec_id divisible by ``every`` the ``k`` nearest other rows found.

    Nearness is the inner product in double precision, ties go to the smaller vec_id; a query with fewer candidates gets
    them all. Null and zero vectors, such with null or non-finite components, and rows without an id take no part, nor do
    vectors of another length than the smallest id's. Of rows with the same vec_id and vector one counts; several vectors
    of one vec_id make one query, whose candidates are ranked by the best of them. An empty table
    gives an empty one; other columns are left out.
    """
    spark = vecs.sparkSession
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    first = rows.orderBy("vec_id").select(F.size("v")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if first is None:
        return empty
    dim = first[0]
    kind = "float32" if dict(vecs.dtypes)["embedding"] == "array<float>" else "float64"
    rows = rows.where(F.size("v") == dim).select("vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), F.col("v").cast(f"array<{'float' if kind == 'float32' else 'double'}>").alias("v"))
    # of equal vectors, the k + 1 smallest ids can be among the k nearest of a row; the first stands for all
    own = Window.partitionBy("a", "b").orderBy("vec_id")
    members = written(rows.dropDuplicates(["vec_id", "a", "b"]).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1), "members")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    most = members.where("nth = 1").agg(F.max(norm)).first()[0]
    top = shared_dir(spark)
    nodes, firsts = numbered(members.where("nth = 1").select("a", "b", "v"), top, dim, kind)
    vectors = Vectors(top, firsts, dim, most, kind)
    saved_graph(build(nodes, vectors, degree, rounds, sample, settled), top, 2 * degree)

    def find(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            out = []
            for query, start, v in zip(batch.column("query_id").to_pylist(), batch.column("number").to_pylist(), x, strict=True):
                near = walk(v, start, vectors, top, 2 * degree, beam)
                scores = (vectors.take(near).astype(np.float64) * v.astype(np.float64)).sum(axis=1)
                order = np.lexsort((near, -scores))
                cut = scores[order[min(len(order), k + 1) - 1]]
                keep = order[scores[order] >= cut]  # all that tie with the last
                out.append((np.full(len(keep), query), near[keep], scores[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "number", "score"])

    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "a", "b"]).join(nodes, ["a", "b"]).select(F.col("vec_id").alias("query_id"), "number", "v")
    queries = queries.repartition(spark.sparkContext.defaultParallelism * 2, "query_id")
    found = map_batches(queries, find, "query_id long, number long, score double")
    ids = members.join(nodes, ["a", "b"]).select("number", "vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = found.join(ids, "number").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
