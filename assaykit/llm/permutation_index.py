"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its pivots, nearest first. The index is cut into shards; a shard keeps one inverted file per pivot, in which
each member is posted with the pivot's rank if the pivot is among the member's ``POSTED`` nearest. A query reads the files of its own ``READ`` nearest
pivots alone and adds up, for each member met there, how close the two ranks are (the footrule distance, where a pivot that one of them lacks
counts as the farthest); it takes the nearest ``share`` of the shard and reranks those by the exact inner product. The shards' answers are
merged by a window over 20 rows a shard.

Queries meet shards in blocks: a task holds one shard and one block of queries, both bounded. Equal vectors are one
member with its smallest ids, so copies of one vector do not crowd a shard. Members of equal footrule are taken in the order of their ids.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of several lengths are compared as
if zeros made them equally long; rows that share an id are rows of their own, and a query leaves out its own row alone (a query that is there
twice with one vector is answered once); fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import hash_sample

#: Rows of a shard and queries of a block.
SHARD, BLOCK = 4096, 4096
#: Pivots by which a member is posted, and pivots whose files a query reads.
POSTED, READ = 32, 64


def clean(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v (array of double, of one length): the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    sizes = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes.low == sizes.high:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes.high) - F.size("v"))))


def pivots(rows: DataFrame, count: int) -> np.ndarray:
    """A bounded sample: the ``count`` vectors with the least hash."""
    return np.array(hash_sample(rows, F.xxhash64("v", F.lit(3)), F.col("v"), count), np.float64)


def nearest_pivots(vectors: np.ndarray, pivot: np.ndarray, count: int) -> np.ndarray:
    """[i, r]: the pivot of rank r for vector i (by direction; ties by pivot number), for the ``count`` nearest."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ (pivot / np.linalg.norm(pivot, axis=1, keepdims=True)).T), axis=1, kind="stable")[:, :count]


class Files:
    """The inverted files of a shard: for each pivot its postings (member, rank)."""

    def __init__(self, data: np.ndarray, pivot: np.ndarray) -> None:
        near = nearest_pivots(data, pivot, POSTED)
        of = near.ravel()
        order = np.argsort(of, kind="stable")
        self.size, self.pivots = len(data), len(pivot)
        self.member, self.rank = order // near.shape[1], order % near.shape[1]
        self.edge = np.searchsorted(of[order], np.arange(len(pivot) + 1))
        #: By the rank that a query gives a pivot: how much nearer its postings come to the query than without it.
        self.saved = (len(pivot) - np.abs(np.arange(min(READ, len(pivot)))[:, None] - self.rank[None])).astype(np.float32)

    def closest(self, near: np.ndarray, take: int) -> np.ndarray:
        """The ``take`` members of the least footrule distance to a query with these nearest pivots."""
        if take >= self.size:
            return np.arange(self.size)
        begin, end = self.edge[near], self.edge[near + 1]
        files = list(zip(begin.tolist(), end.tolist(), strict=True))
        member = np.concatenate([self.member[a:b] for a, b in files])
        saved = np.concatenate([self.saved[r, a:b] for r, (a, b) in enumerate(files)])
        saved = np.bincount(member, weights=saved, minlength=self.size).astype(np.int64)
        key = saved * self.size + (self.size - 1 - np.arange(self.size))  # ties to the smaller member
        return np.argpartition(key, self.size - take)[self.size - take :]


def search_shard(members: pd.DataFrame, queries: pd.DataFrame, pivot: np.ndarray, k: int, share: float) -> pd.DataFrame:
    """Answers of one shard to one block of queries."""
    out = {"query_id": [], "place": [], "id": [], "score": []}
    if len(members) and len(queries):
        members = members.sort_values("ids", key=lambda ids: ids.map(lambda x: (x[0], x[-1], len(x))), kind="stable")
        data = np.stack(members["v"].to_numpy()).astype(np.float64)
        files = Files(data, pivot)
        wanted = np.stack(queries["v"].to_numpy()).astype(np.float64)
        asked = nearest_pivots(wanted, pivot, READ)
        take = min(len(data), max(k + 1, int(np.ceil(share * len(data)))))
        ids = members["ids"].to_numpy()
        for q, place, v, near in zip(queries["id"].to_numpy(), queries["place"].to_numpy(), wanted, asked, strict=True):
            close = files.closest(near, take)
            score = (data[close] * v).sum(1)
            best = close if len(close) <= k + 1 else close[score >= np.partition(score, -(k + 1))[-(k + 1)]]
            found = []
            for m in best:
                s, others = float((data[m] * v).sum()), ids[m].tolist()
                if q in others and (data[m] == v).all():
                    others.remove(q)  # its own row
                found += [(-s, int(i)) for i in others]
            found.sort()
            for s, i in found[:k]:
                out["query_id"].append(q)
                out["place"].append(place)
                out["id"].append(i)
                out["score"].append(-s)
    return pd.DataFrame(out).astype({"query_id": "int64", "place": "int64", "id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector: str = "embedding", n_pivots: int = 128, share: float = 0.4) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of each row whose id is divisible by ``every``.

    share: the part of each shard, nearest by footrule, that is reranked exactly, whatever its size.
    """
    rows = clean(vectors, id_column, vector)
    pivot = pivots(rows, n_pivots)
    if not len(pivot):
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_column), F.lit(0.0).alias("score")).where("false")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).distinct().withColumn("place", F.xxhash64("v"))  # tells apart queries of one id
    # of equal vectors the k + 1 smallest ids are enough: a query needs k besides itself, ties to smaller ids
    order = Window.partitionBy("salt", "v").orderBy("id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    members = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("q")).first()
    shards, blocks = -(-sizes.n // SHARD), max(1, -(-sizes.q // BLOCK))
    members = members.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    work = functools.partial(search_shard, pivot=pivot, k=k, share=share)
    tasks = min(shards * blocks, 10_000)
    found = members.repartition(tasks, "shard", "block").groupBy("shard", "block").cogroup(queries.repartition(tasks, "shard", "block").groupBy("shard", "block")).applyInPandas(lambda a, b: work(a, b), "query_id long, place long, id long, score double")
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
