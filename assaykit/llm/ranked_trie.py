"""Ranked lexical search: for each item of a query set, the documents with the highest scores among all documents, exactly.

Method: a document FP-tree. Documents are cut down to the terms that items have, as vectors ordered by falling document frequency, so that documents which
share their commonest terms share a path. The tree is dealt over Spark tasks by ranges of paths. A task holds a stretch of it at a time: nodes at growing
depths, each a run of neighbours with equal path heads, with the largest tf of each term in its subtree, the smallest m and the smallest id. An item is searched depth first:
children are bounded by the score of a document that had all largest tf's and the smallest m, those that cannot reach the item's last place are cut off, and the best go first. Documents
at the bottom are scored exactly. A task keeps its best over all its stretches; the best of tasks are ranked at the end. No bound is estimated and nothing is capped, so
what is found is what scoring all documents would find.

Scores: a term is a maximal run of characters other than ASCII signs and white space, A-Z lower-cased. N documents have terms, L terms in all; a document has n, and
df documents a term. w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25 n N div L, a term with tf occurrences gives w ((10^9 tf) div (1000 tf + 12 m)), items' repeats count.

Items are taken in blocks of at most ``ITEMS`` rows and about ``TERMS`` distinct terms, so what is sent to tasks is bounded by the parameters or by a single item.

Edge cases: null and empty texts have no terms and are never found; an item without terms, or whose terms no document has, has no rows; repeated item rows are ranked each for
itself, repeated documents tie; ties go to the smaller doc_id, a null doc_id after all others; empty tables give no rows; very long texts are read whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import kept, list_column, spread

#: Items and distinct terms of a block; documents and postings of a stretch of the tree; tasks that the tree is dealt to.
ITEMS, TERMS = 1024, 1 << 16
DOCS, POSTINGS = 8192, 1 << 21
TASKS = 4096
#: Depths of the tree's nodes: all common terms, then longer steps.
DEPTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Siblings whose children are bounded in one step.
WIDTH = 64
NONE = np.iinfo(np.int64).max

_SIGNS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_SIGNS + bytes(range(0x41, 0x5B)), b" " * len(_SIGNS) + bytes(range(0x61, 0x7B)))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    number = vocabulary.value
    for batch in batches:
        n, sizes, terms, tfs = [], [], [], []
        for text in batch.column("text"):
            words = terms_of(text.as_py())
            held = Counter(map(number.get, words))
            held.pop(None, None)
            n.append(len(words))
            sizes.append(len(held))
            terms += held.keys()
            tfs += held.values()
        size = np.array(sizes, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), list_column(np.array(terms, np.int32), size, pa.int32()), list_column(np.array(tfs, np.int32), size, pa.int32())], names=["doc_id", "n", "terms", "tfs"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(offsets).astype(np.int64)


def _paths(batches: Iterator[pa.RecordBatch], rank: Broadcast, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    """Vectors with terms as ranks, the commonest first, as big-endian numbers that sort as paths do."""
    ranks = rank.value
    for batch in batches:
        (terms, size), (tfs, _) = _lists(batch.column("terms")), _lists(batch.column("tfs"))
        owner, _ = spread(size)
        mine = ranks[terms]
        order = np.lexsort((mine, owner))
        path, tf = mine[order].astype(">u4").tobytes(), tfs[order].astype("<i4").tobytes()
        edge = (4 * np.concatenate([[0], np.cumsum(size)])).tolist()
        m = [75 + 25 * n * documents // total for n in batch.column("n").to_pylist()]
        cells = [pa.array([raw[a:b] for a, b in zip(edge, edge[1:], strict=False)], pa.binary()) for raw in (path, tf)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m, pa.int64()), *cells], names=["doc_id", "m", "path", "tf"])


def gain(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; it grows with tf and falls with m, so largest tf's and the smallest m bound a subtree."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Level:
    """Nodes of one depth, in order: least m and id, where their children lie in the next level, and the largest tf of each term below, as a table sorted by term and node."""

    def __init__(self, key: np.ndarray, tf: np.ndarray, m: np.ndarray, least: np.ndarray, first: np.ndarray | None = None) -> None:
        self.key, self.tf, self.m, self.least, self.first, self.n = key, tf, m, least, first, len(m)


class Tree:
    """A stretch of the tree: documents in the order of their paths."""

    def __init__(self, rank: np.ndarray, size: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, depths: tuple[int, ...] = DEPTHS) -> None:
        n = len(size)
        owner, _ = spread(size)
        order = np.lexsort((owner, rank)) if n else np.zeros(0, np.int64)
        self.levels = [Level(rank[order].astype(np.int64) * n + owner[order], tf[order].astype(np.int64), m, ids)]
        self.shared = shared_heads(rank, size)
        for depth in sorted(depths, reverse=True):
            below = self.levels[-1]
            # a node is a run of neighbours whose paths agree up to the depth, or to their ends
            fresh = np.concatenate([[True], self.shared < depth]) if n else np.zeros(0, bool)
            first = np.flatnonzero(fresh[self.starts()] if len(self.levels) > 1 else fresh)
            if len(first) < below.n:
                self._over(first)
        self._over(np.zeros(min(1, n), np.int64))

    def starts(self) -> np.ndarray:
        """The first document of each node of the highest level."""
        at = np.arange(self.levels[-1].n)
        for level in reversed(self.levels[1:]):
            at = level.first[at]
        return at

    def _over(self, first: np.ndarray) -> None:
        """A level above the highest one; ``first``: the first child of each node."""
        below = self.levels[-1]
        term, node = np.divmod(below.key, max(1, below.n))
        key = term * len(first) + np.searchsorted(first, node, "right") - 1
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        large = np.maximum.reduceat(below.tf, heads) if len(heads) else below.tf
        self.levels.append(Level(key[heads], large, np.minimum.reduceat(below.m, first), np.minimum.reduceat(below.least, first), first))

    def bounds(self, level: int, low: np.ndarray, high: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes in the ranges [low, high) of a level, and the most that a document below each can score (at the bottom: its score)."""
        at = self.levels[level]
        owner, rank = spread(high - low)
        nodes = low[owner] + rank
        place = np.cumsum(high - low) - (high - low)
        a, b = (np.searchsorted(at.key, (term[:, None] * at.n + edge[None]).ravel()) for edge in (low, high))
        which, k = spread(b - a)
        entry = a[which] + k
        node, cell = at.key[entry] % at.n, which % len(low)
        out = np.zeros(len(nodes), np.int64)
        np.add.at(out, place[cell] + node - low[cell], gain(weight[which // len(low)], at.tf[entry], at.m[node]))
        return nodes, out

    def search(self, term: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of ``best`` and the documents of this tree."""
        top = len(self.levels) - 1
        stack = [(top, *self.bounds(top, np.zeros(1, np.int64), np.array([self.levels[top].n]), term, weight))] if self.levels[top].n else []
        while stack:
            level, nodes, bound = stack.pop()
            scores, ids = best
            least = self.levels[level].least[nodes]
            open_ = bound > 0 if len(scores) < k else (bound > scores[-1]) | (bound == scores[-1]) & (bound > 0) & (least < ids[-1])
            nodes, bound = nodes[open_], bound[open_]
            if not len(nodes):
                continue
            if level == 0:
                scores, ids = np.concatenate([scores, bound]), np.concatenate([ids, least[open_]])
                order = np.lexsort((ids, -scores))[:k]
                best = scores[order], ids[order]
                continue
            if len(nodes) > width:
                order = np.argsort(-bound, kind="stable")
                rest = order[width:]
                stack.append((level, nodes[rest], bound[rest]))
                nodes = np.sort(nodes[order[:width]])
            here, below = self.levels[level], self.levels[level - 1]
            stop = np.append(here.first, below.n)[nodes + 1]
            stack.append((level - 1, *self.bounds(level - 1, here.first[nodes], stop, term, weight)))
        return best


def shared_heads(rank: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading terms each document shares with the one before, but for the first; a whole path that equals it counts as shared without end."""
    if len(size) < 2:
        return np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    both = np.minimum(size[1:], size[:-1])
    owner, k = spread(both)
    differ = np.flatnonzero(rank[start[1:][owner] + k] != rank[start[:-1][owner] + k])
    out = np.where(size[1:] == size[:-1], NONE, both)
    # the first difference of each pair is written last
    out[owner[differ][::-1]] = k[differ][::-1]
    return out


def _search(batches: Iterator[pa.RecordBatch], items: Broadcast, k: int, docs: int, postings: int) -> Iterator[pa.RecordBatch]:
    queries = items.value
    best = {row: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for row, *_ in queries}
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        if held:
            path, size, tf, m, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            tree = Tree(path, size, tf, m, ids)
            for row, term, weight in queries:
                best[row] = tree.search(term, weight, best[row], k)

    count = 0
    for batch in batches:
        for k0 in range(0, batch.num_rows, docs):
            part = batch.slice(k0, docs)
            raw, tf = part.column("path").to_pylist(), part.column("tf").to_pylist()
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ids = part.column("doc_id").fill_null(NONE).to_numpy()
            held.append((np.frombuffer(b"".join(raw), ">u4").astype(np.int64), size, np.frombuffer(b"".join(tf), "<i4"), part.column("m").to_numpy(), ids))
            count += int(size.sum())
            if count >= postings or sum(len(h[1]) for h in held) >= docs:
                flush()
                count = 0
    flush()
    rows = [(row, i, s) for row, (scores, ids) in best.items() for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([None if i == NONE else i for i in columns[1]], pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])


def blocks_of(items: DataFrame, most: int, terms: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items as (id, terms), a block at a time; the driver holds one block."""
    block, seen = [], set()
    for row in items.toLocalIterator():
        held = Counter(terms_of(row.text))
        if block and (len(block) == most or len(seen | held.keys()) > terms):
            yield block
            block, seen = [], set()
        block.append((row.item_id, held))
        seen |= held.keys()
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_items: int = ITEMS, most_terms: int = TERMS, stretch: int = DOCS, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) its k best of docs (doc_id, text). Ids are whole numbers."""
    spark = docs.sparkSession
    found = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in blocks_of(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), most_items, most_terms):
        made = _search_block(spark, texts, block, k, stretch, postings)
        found = made if found is None else found.unionByName(made)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_block(spark, texts: DataFrame, block: list, k: int, stretch: int, postings: int) -> DataFrame:  # noqa: ANN001
    terms = sorted({t for _, held in block for t in held})
    number = {t: i for i, t in enumerate(terms)}
    words = spark.sparkContext.broadcast(number)
    vectors = kept(texts.mapInArrow(functools.partial(_vectors, vocabulary=words), "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
    whole = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.size("terms") > 0).alias("held")).first()
    # a row for each term of the block
    df = np.zeros(len(terms), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[row.t] = row["count"]
    order = np.lexsort((np.arange(len(terms)), -df))
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * whole.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = []
    for row, (_, held) in enumerate(block):
        index = np.array(sorted(number[t] for t in held), np.int64)
        times = np.array([held[terms[i]] for i in index.tolist()], np.int64)
        queries.append((row, rank[index], weight[index] * times if len(index) else index))
    ranks, asked = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast([q for q in queries if len(q[1])])
    paths = vectors.where(F.size("terms") > 0).mapInArrow(functools.partial(_paths, rank=ranks, documents=whole.documents, total=max(1, whole.total)), "doc_id long, m long, path binary, tf binary")
    # equal paths are told apart by their ids, so copies are dealt over tasks too
    tasks = max(1, min(TASKS, -(-whole.held // 2048)))
    dealt = paths.repartitionByRange(tasks, F.substring("path", 1, 64), F.xxhash64("doc_id")).sortWithinPartitions("path", "doc_id")
    best = dealt.mapInArrow(functools.partial(_search, items=asked, k=k, docs=stretch, postings=postings), "item long, doc_id long, score long")
    order_by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(row, i) for row, (i, _) in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
