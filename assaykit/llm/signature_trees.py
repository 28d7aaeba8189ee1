"""N-gram Jaccard join with signature trees: which texts share enough word shingles.

1. Every text becomes its set of distinct word shingles (64-bit hashes, sorted); equal sets are one node from there on.
2. Routing, without loss: a set is dealt by hash range into so many parts that two sets which may link must have some part in
   common (their difference is smaller than the number of parts). Each set posts its largest parts, as many as the bound asks
   for. Sets that share a part are joined to the part's first set, and the components of that graph are the groups to search.
3. Inside a group a signature tree: leaves hold single sets, nodes hold the OR of their token bitmaps and a size range. A dual
   traversal drops node pairs whose sizes or whose largest possible overlap rule a link out, and pairs that are one component
   already; what is left is compared exactly.
4. Wide groups are cut into blocks. First each block is searched with some sets of the whole group in it, so a family of near copies is
   one component at a cost linear in its size. Chance ties chain unrelated sets to groups that grow faster than the input, so from there on their sets meet by
   their parts: the sets that share a part and are not one component yet are a cell, once for parts of the same sets. Sets that share a part with very many others form
   groups of their own; in these, and in wide groups where it deals out fewer rows, the sets outside the largest component, few in a family, meet all blocks and each other. Every pair that shares a part is in some cell, or
   in one component before.
5. Components of the links found.

No partner or candidate is capped. Edge cases: null or blank text has an empty set and links with nothing; fewer words than
``words`` make one shingle; repeated rows and equal sets link; a null id never becomes a component id unless all are null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import CHUNK, Rolling, Words, components, cut, free_name, mix, pieces, sieve, sieved, text_groups

#: Upper ends of the size levels; each is half as large again as the one before.
LEVELS = np.array([1, 2, 3, 4] + [int(4 * 1.5**i) for i in range(1, 50)], np.int64)
#: A task's share of one group: sets, and bytes of sets.
BLOCK_SETS, BLOCK_BYTES = 2048, 16 << 20
#: A part of a wide group that more than one set in so many of a block shares is no cell of its own.
HOT = 8
#: Sets of a wide group that all its blocks see.
SEEN_BY_ALL = 8
FAN = 16
#: Sets that a task remembers to have posted.
REMEMBERED = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted within each text, and how many each text has."""
    words = Words(data, offsets, lower=True)
    rolling = Rolling(words.hash)
    count = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    row = np.repeat(np.arange(len(count)), count)
    start = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hashes = rolling.of(start, np.minimum(start + k, words.first[row + 1]))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(count))


def set_ids(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A name for each set; its low six bits are the size's level. Empty sets get -1."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(11)), dtype=np.uint64)])
    end = np.cumsum(size)
    name = mix(total[end] - total[end - size] + mix(size.astype(np.uint64)))
    level = np.searchsorted(LEVELS, size).astype(np.uint64)
    name = ((name << np.uint64(6)) | level).view(np.int64)
    return np.where(size > 0, name, -1)


def difference(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most by which linked sets of at most these sizes can differ: (a + b)(1 - t) / (1 + t)."""
    return (a + b) * (den - num) // (den + num)


def part_keys(hashes: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the parts that each set posts, for the size level of its own and the next ones it can reach."""
    rows, keys = [], []
    own = np.searchsorted(LEVELS, size)
    reach = np.searchsorted(LEVELS, size * den // num)
    begin = np.cumsum(size) - size
    for step in range(int((reach - own).max(initial=0)) + 1):
        who = np.flatnonzero((size > 0) & (own + step <= reach))
        if not len(who):
            break
        level = own[who] + step
        top = LEVELS[level]
        most = difference(top, top, num, den)
        parts = most + 1 + most // 4
        s = size[who]
        post = difference(s, np.minimum(top, s * den // num), num, den) + 1
        at = np.repeat(np.arange(len(who)), s)
        token = hashes[np.repeat(begin[who], s) + np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s)]
        part = ((token >> np.uint64(32)) * parts[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(first)
        of, part_of = at[first], part[first]
        weight = np.diff(np.append(first, len(at)))
        name = np.add.reduceat(mix(token), first)
        filled = np.bincount(of, minlength=len(who))
        short = np.flatnonzero(filled < post)  # too few parts have tokens: empty ones count as well
        for i in short.tolist():
            have = set(part_of[of == i].tolist())
            gaps = np.array([p for p in range(int(parts[i])) if p not in have], np.int64)
            of, part_of = np.append(of, np.full(len(gaps), i)), np.append(part_of, gaps)
            weight, name = np.append(weight, np.zeros(len(gaps), np.int64)), np.append(name, np.zeros(len(gaps), np.uint64))
        key = mix(name + mix((level[of].astype(np.uint64) << np.uint64(40)) + part_of.astype(np.uint64)))
        order = np.lexsort((key, -weight, of))
        of, key = of[order], key[order]
        total = np.bincount(of, minlength=len(who))
        rank = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
        keep = rank < post[of]
        rows.append(who[of[keep]])
        keys.append(key[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def post_parts(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Texts -> (key, set). A set that this task has posted before is not posted again, as far as the task remembers."""
    seen: set[int] = set()
    for _, data, offsets in text_groups(batches):
        hashes, size = shingle_sets(data, offsets, k)
        ids = set_ids(hashes, size)
        fresh = np.zeros(len(ids), bool)
        if len(seen) > REMEMBERED:
            seen.clear()
        for i, x in enumerate(ids.tolist()):
            if x != -1 and x not in seen:
                seen.add(x)
                fresh[i] = True
        hashes, size, ids = hashes[np.repeat(fresh, size)], size[fresh], ids[fresh]
        row, key = part_keys(hashes, size, num, den)
        yield from pieces(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row])], names=["key", "s"]))


def star_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, set) -> an edge from a key's first set to each other set."""
    last_key = last_set = None
    for batch in batches:
        key, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead = s[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if last_key is not None and key[0] == last_key:
            lead[: int(np.searchsorted(key, last_key, "right"))] = last_set
        last_key, last_set = key[-1], lead[-1]
        edge = np.flatnonzero(lead != s)
        if len(edge):
            pair = np.unique(np.stack([lead[edge], s[edge]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def add_sets(batches: Iterator[pa.RecordBatch], k: int, columns: list[str], names: list[str], text: str) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_groups(batches, text):
        hashes, size = shingle_sets(data, offsets, k)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(set_ids(hashes, size)), pa.array(size.astype(np.int64))], names=[*columns, *names])


def open_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_groups(batches):
        hashes, size = shingle_sets(data, offsets, k)
        ends = np.cumsum(size) * 8
        raw = hashes.tobytes()
        body = pa.array([raw[a:b] for a, b in zip((ends - size * 8).tolist(), ends.tolist(), strict=True)], pa.binary())
        names = [c for c in batch.schema.names if c != "text"]
        yield from pieces(pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), body], names=[*names, "tokens"]), 2000)


def post_sets(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The parts of sets (s, tokens) -> (key, s)."""
    for batch, data, offsets in text_groups(batches, "tokens", 4 * CHUNK):
        row, key = part_keys(data.view(np.uint64), np.diff(offsets) // 8, num, den)
        yield from pieces(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column("s").to_numpy()[row])], names=["key", "s"]))


class Union:
    def __init__(self, of: np.ndarray) -> None:
        self.of = of  # a label per component
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)
            self.links.append((a, b))


class SignatureTree:
    """Sets sorted by size; each level groups FAN nodes of the one below."""

    def __init__(self, tokens: list[np.ndarray], num: int, den: int) -> None:
        size = np.array([len(t) for t in tokens], np.int64)
        low = np.array([t[0] if len(t) else 0 for t in tokens], np.uint64)
        order = np.lexsort((low, size))
        self.order, self.size, self.num, self.den = order, size[order], num, den
        self.tokens = [tokens[i] for i in order]
        bits = 256
        while bits < min(4 * int(self.size[-1]), 1 << 14):
            bits *= 2
        maps = np.zeros((len(tokens), bits // 8), np.uint8)
        place = [(t % np.uint64(bits)).astype(np.int64) for t in self.tokens]
        for i, p in enumerate(place):
            np.bitwise_or.at(maps[i], p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        maps = maps.view(np.uint64)
        clash = self.size - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, self.size, self.size, clash)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, c = self.levels[-1]
            at = np.arange(0, len(m), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(c, at)))

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Node pairs that sizes and the largest possible overlap don't rule out.

        Common tokens of two sets set common bits; tokens of one set that fall on one bit add at most its clashes.
        """
        m, lo, hi, clash = self.levels[level]
        ok = (hi[x] * self.den >= lo[y] * self.num) & (hi[y] * self.den >= lo[x] * self.num)
        at = np.flatnonzero(ok)
        for part in np.array_split(at, len(at) // 4096 + 1):
            a, b = x[part], y[part]
            most = np.bitwise_count(m[a] & m[b]).sum(1) + np.minimum(clash[a], clash[b])
            most = np.minimum(most, np.minimum(hi[a], hi[b]))
            ok[part] = most * (self.num + self.den) >= (lo[a] + lo[b]) * self.num
        return ok

    def linked(self, a: int, b: int) -> bool:
        s, t = self.tokens[a], self.tokens[b]
        if len(s) > len(t):
            s, t = t, s
        at = np.searchsorted(t, s)
        both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        return both * self.den >= self.num * (len(s) + len(t) - both)

    def pivots(self, union: Union, most: int) -> None:
        """Links some sets with all others first: families of near copies then are one component before the traversal."""
        flat = np.concatenate(self.tokens)
        starts = np.cumsum(self.size) - self.size
        step = max(1, len(self.tokens) // most)
        for p in range(0, len(self.tokens), step):
            t = self.tokens[p]
            at = np.searchsorted(t, flat)
            both = np.add.reduceat((t[np.minimum(at, len(t) - 1)] == flat).astype(np.int64), starts)
            for q in np.flatnonzero((both * self.den >= self.num * (self.size + len(t) - both)) & (union.of != union.of[p])).tolist():
                union.join(p, q)

    def traverse(self, union: Union, side: np.ndarray) -> None:
        """side: two sets of one side need no look; side 0 is none."""
        top = len(self.levels) - 1
        x = y = np.zeros(1, np.int64)
        for level in range(top - 1, -1, -1):
            n = len(self.levels[level][0])
            next_x, next_y = [], []
            lo = np.minimum.reduceat(union.of, np.arange(0, len(union.of), FAN**level))
            hi = np.maximum.reduceat(union.of, np.arange(0, len(union.of), FAN**level))
            low = np.minimum.reduceat(side, np.arange(0, len(side), FAN**level))
            high = np.maximum.reduceat(side, np.arange(0, len(side), FAN**level))
            for i in range(0, len(x), 2048):
                cx = (x[i : i + 2048, None] * FAN + np.arange(FAN)).repeat(FAN, 1)
                cy = np.tile(y[i : i + 2048, None] * FAN + np.arange(FAN), (1, FAN))
                cx, cy = cx.ravel(), cy.ravel()
                fine = (cx < n) & (cy < n) & (cx <= cy if level else cx < cy)
                cx, cy = cx[fine], cy[fine]
                apart = ~((lo[cx] == hi[cx]) & (lo[cy] == hi[cy]) & (lo[cx] == lo[cy])) & ~((low[cx] > 0) & (low[cx] == high[cx]) & (low[cx] == low[cy]) & (low[cy] == high[cy]))
                cx, cy = cx[apart], cy[apart]
                ok = self.may_link(level, cx, cy)
                cx, cy = cx[ok], cy[ok]
                if level:
                    next_x.append(cx)
                    next_y.append(cy)
                else:
                    for p, q in zip(cx.tolist(), cy.tolist(), strict=True):
                        if union.of[p] != union.of[q] and self.linked(p, q):
                            union.join(p, q)
            if not level or not sum(map(len, next_x)):
                return
            x, y = np.concatenate(next_x), np.concatenate(next_y)

    def links(self, labels: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join the components of all sets. labels: components known before; side: see traverse."""
        n = len(self.tokens)
        union = Union(np.arange(n) if labels is None else np.unique(labels[self.order], return_inverse=True)[1])
        if n > 1:
            self.pivots(union, 16)
            self.traverse(union, np.zeros(n, np.int8) if side is None else side[self.order])
        return [(int(self.order[a]), int(self.order[b])) for a, b in union.links]


CELL = ("root", "kind", "i", "j")


def search_cells(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, each a set -> the links that join each cell's sets into components."""

    def search(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        ids, known, side, tokens = zip(*rows, strict=True)
        tree = SignatureTree([np.frombuffer(t, np.uint64) for t in tokens], num, den)
        return [(ids[a], ids[b]) for a, b in tree.links(np.array(known, np.int64), np.array(side, np.int8))]

    cell, rows, found = None, [], []
    for batch in batches:
        for *at, s, known, side, t in zip(*(batch.column(c).to_pylist() for c in (*CELL, "s", "known", "side", "tokens")), strict=True):
            if at != cell:
                found += search(rows)
                cell, rows = at, []
            rows.append((s, known, side, t))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
            found = []
    found = search(rows)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _links(sets: DataFrame, cells: Column, num: int, den: int) -> DataFrame:
    """The links of all cells. cells: an array of (kind, i, j, side) for each row of sets (root, s, known, tokens)."""
    each = sets.withColumn("cell", F.explode(cells)).select("root", "cell.*", "s", "known", "tokens")
    return each.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(functools.partial(search_cells, num=num, den=den), "a long, b long")


def _cell(kind: int, i: Column, j: Column, side: int = 0) -> Column:
    return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))


def _level_bytes(s: str) -> Column:
    """The bytes of a set of the level that its name has: its own bytes at most."""
    return F.element_at(F.array(*[F.lit(int(8 * x)) for x in LEVELS]), (F.col(s).bitwiseAND(63) + 1).cast("int"))


def _blocks(s: str) -> Column:
    """The blocks that a group of sets needs."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(_level_bytes(s)) / BLOCK_BYTES)).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("s"), F.col(blocks)).cast("int")


def _across(held: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of wide groups. held: the sets of wide groups; found: components of the links within blocks.

    Either a cell for each part that several components share, one for parts of the same sets, or the group's blocks, whichever deals out fewer rows: parts
    for chains of unrelated sets, blocks for a family of near copies with few sets outside its largest component.
    """
    lead = found.select(F.col("node").alias("s"), F.col("root").alias("lead"))
    ids = cut(held.select("root", "blocks", "s").join(lead, "s", "left").select("root", "blocks", "s", F.coalesce("lead", "s").alias("known")))
    posted = cut(held.select("s", "tokens").mapInArrow(functools.partial(post_sets, num=num, den=den), "key long, s long").join(ids, "s").select("root", "key", "s", "known"))
    hot = (F.count("*") * HOT > BLOCK_SETS) | (F.sum(_level_bytes("s")) > BLOCK_BYTES)
    same = F.struct(F.count("*"), F.min("s"), F.max("s"), F.bit_xor(F.xxhash64("s")))
    shared = posted.groupBy("root", "key").agg((F.min("known") != F.max("known")).alias("open"), hot.alias("hot"), same.alias("same"), F.count("*").alias("n")).where("open")
    shared = cut(shared.groupBy("root", "hot", F.when(F.col("hot"), F.col("key")).alias("each"), "same", "n").agg(F.min("key").alias("key")))
    outside = F.sum("n") - F.max("n")
    rest = F.ceil(outside / BLOCK_SETS)
    by_blocks = ids.groupBy("root", "blocks", "known").agg(F.count("*").alias("n")).groupBy("root", "blocks").agg((outside * (rest + F.col("blocks")) + F.max("n") * rest).alias("most"))
    by_parts = shared.groupBy("root").agg(F.sum("n").alias("rows"))
    chosen = cut(by_blocks.join(by_parts, "root").select("root", (F.col("rows") < F.col("most")).alias("parts")))  # a group without open parts needs no more search
    cells = shared.join(chosen.where("parts"), "root").select("root", "key", "hot")
    cold = posted.join(cells.where("not hot").select("key"), "key").select(F.col("key").alias("root"), "s", "known")
    links = _links(cold.join(held.select("s", "tokens"), "s"), F.array(_cell(0, F.lit(0), F.lit(0))), num, den)
    edges = posted.join(cells.where("hot").select("key"), "key").select("key", "s").repartition("key").sortWithinPartitions("key", "s").mapInArrow(star_edges, "a long, b long")
    groups = components(edges).withColumnRenamed("node", "s")
    hot_ids = groups.join(groups.groupBy("root").agg(_blocks("s").alias("blocks")), "root").join(ids.select("s", "known"), "s")
    blocked = ids.join(chosen.where("not parts").select("root"), "root").select(hot_ids.columns)
    return links.unionByName(_between_blocks(held.select("s", "tokens"), cut(hot_ids.unionByName(blocked)), num, den))


def _between_blocks(held: DataFrame, ids: DataFrame, num: int, den: int) -> DataFrame:
    """Links in groups. held: sets (s, tokens); ids: (root, blocks, s, known), known being a label of each set's component so far.

    A group's largest component needs no search in itself. Sets outside it are dealt to blocks of their own, which meet each other
    (cells of kind 0) and the largest component's blocks (kind 1).
    """
    per = ids.groupBy("root", "known").agg(F.count("*").alias("n"))
    largest = per.groupBy("root").agg(F.max_by("known", F.struct("n", "known")).alias("largest"))
    ids = ids.join(largest, "root").withColumn("inner", F.col("known") == F.col("largest"))
    rest = ids.where("not inner").groupBy("root").agg(_blocks("s").alias("rest"))
    ids = ids.join(rest, "root").select("root", "blocks", "rest", "s", "known", "inner")
    own, mine = _block("blocks"), F.pmod(F.xxhash64("s", F.lit(1)), F.col("rest")).cast("int")
    all_rest, all_blocks = F.sequence(F.lit(0), F.col("rest") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    outside = F.concat(F.transform(all_rest, lambda q: _cell(0, F.least(mine, q), F.greatest(mine, q))), F.transform(all_blocks, lambda j: _cell(1, mine, j, 1)))
    inside = F.transform(all_rest, lambda q: _cell(1, q, own, 2))
    return _links(held.join(ids, "s"), F.when(F.col("inner"), inside).otherwise(outside), num, den)


def set_components(texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, root) for the sets of ``texts.text`` that link with another set."""
    texts = texts.select("text")
    posted = texts.mapInArrow(functools.partial(post_parts, k=words, num=num, den=den), "key long, s long")
    edges = posted.repartition("key").sortWithinPartitions("key", "s").mapInArrow(star_edges, "a long, b long")
    groups = components(edges).withColumnRenamed("node", "s")
    wide = cut(groups.groupBy("root").agg(_blocks("s").alias("blocks")).where("blocks > 1"))
    some_wide = not wide.isEmpty()
    if some_wide:
        seen = groups.join(wide, "root").groupBy("root", F.pmod(F.xxhash64("s", F.lit(2)), F.lit(SEEN_BY_ALL))).agg(F.min("s").alias("s"))
        groups = groups.join(wide, "root", "left").join(seen.select("s", F.lit(True).alias("seen")), "s", "left")
    else:
        groups = groups.withColumns({"blocks": F.lit(1), "seen": F.lit(False)})
    groups = groups.select("root", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("seen", F.lit(False)).alias("seen"), "s")
    named = texts.mapInArrow(functools.partial(add_sets, k=words, columns=["text"], names=["s", "size"], text="text"), "text string, s long, size long")
    named = sieved(named, ["s"], sieve(groups.select("s")), "grouped").where("grouped and s <> -1")  # most texts are in no group, and go no further
    members = named.groupBy("s").agg(F.first("text").alias("text")).join(groups, "s").select("root", "blocks", "seen", "s", "text")
    sets = members.mapInArrow(functools.partial(open_sets, k=words), "root long, blocks int, seen boolean, s long, tokens binary")
    if some_wide:
        sets = cut(sets)  # read again below
    own = _block("blocks")
    cells = F.when(F.col("seen"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: _cell(0, i, i))).otherwise(F.array(_cell(0, own, own)))
    found = components(_links(sets.withColumn("known", F.col("s")), cells, num, den))
    if not some_wide:
        return found
    across = _across(sets.where("blocks > 1"), found, num, den)
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))


def with_sets(docs: DataFrame, columns: list[str], words: int, s: str, size: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(s, T.LongType()), T.StructField(size, T.LongType())])
    return docs.mapInArrow(functools.partial(add_sets, k=words, columns=columns, names=[s, size], text="text"), schema)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (of them ``columns``, all if none are named) with n_shingles and component_id.

    Two texts link when den * |A and B| >= num * |A or B| for their sets of ``words``-word shingles. component_id is the
    smallest doc_id that links lead to.
    """
    columns = columns or docs.columns
    s, n, c, root, lead = (free_name([*docs.columns, "node"], x) for x in ("set_id", "n_shingles", "component_id", "root", "lead"))
    found = set_components(docs, words, num, den).select(F.col("node").alias(s), F.col("root").alias(root))
    first = [] if "doc_id" in columns else ["doc_id"]
    rows = cut(with_sets(docs, [*columns, *first], words, s, n))  # read twice below, and made of whole texts
    labelled = rows.join(found, s, "left").withColumn(root, F.coalesce(root, s))
    leads = labelled.where(F.col(s) != -1).groupBy(root).agg(F.min("doc_id").alias(lead))
    return labelled.join(leads, root, "left").withColumn(c, F.when(F.col(s) == -1, F.col("doc_id")).otherwise(F.col(lead))).select(*[F.col(f"`{x}`") for x in columns], n, c)


def keep_one(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that with the smallest doc_id (nulls last). Rows without words stay.

    Only rows whose set another row has too, or that links, are shuffled: a sieve lets the others stay where they are.
    """
    found = set_components(docs, words, num, den)
    s, n, doubt = (free_name([*docs.columns, "root", "node", "lead", "row"], x) for x in ("set_id", "n_shingles", "doubt"))
    copies = with_sets(docs.select("text"), [], words, s, n).groupBy(s).agg(F.count("*").alias(n)).where(f"{n} > 1")
    rows = sieved(with_sets(docs, docs.columns, words, s, n), [s], sieve(copies.select(s).unionByName(found.select(F.col("node").alias(s)))), doubt)
    doubtful = F.col(doubt) & (F.col(s) != -1)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"))
    first = rows.where(doubtful).groupBy(s).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    named = first.join(found.select(F.col("node").alias(s), "root"), s, "left").withColumn("root", F.coalesce("root", s))
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col(s))
    lead = named.groupBy("root").agg(F.min_by(s, order).alias("lead"))
    kept = named.join(lead.select(F.col("lead").alias(s)), s, "left_semi").select("row.*")
    return kept.unionByName(rows.where(~doubtful).select(*[F.col(f"`{c}`") for c in docs.columns]))
