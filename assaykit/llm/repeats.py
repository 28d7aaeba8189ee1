"""Long repeats between and inside texts: what the byte index and the word index share.

1. A family picks anchors in each text: places that any repeated window must contain at the same offset in both copies.
   An anchor has a name (its own content) and a context name (all content that a window with it can reach).
2. ``IndexFamily`` takes the anchors of one slice of the name space and says which are met again.
3. Anchors with equal contexts are settled. For those with equal names but unequal contexts, the windows themselves are compared: rows meet by
   the half of their surroundings that the windows share, and a large group is dealt anew by single windows.
4. Covered spans are merged per text, or joined to the rows of the texts that have any.

Hot groups: a task sends two anchors of a class at most, and deals the others out evenly, as they are met again for certain; names that many of a sample
of texts hold are dealt by class instead of by name, and always compared by windows. Which names these are changes the work and never the result.

Texts are named by a 96-bit hash, so equal texts are worked on once and rows need no unique id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import cut, free_name, mix, pieces, sieve, sieved, spread, text_key

#: route: what an anchor is dealt by. order: its first bytes as numbers, by which the index is sorted. sure: it is met again for certain.
ANCHORS = "route long, order1 long, order2 long, name long, context long, h1 long, h2 int, pos int, sure boolean"
_ANCHORS = pa.schema([("route", pa.int64()), ("order1", pa.int64()), ("order2", pa.int64()), ("name", pa.int64()), ("context", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("pos", pa.int32()), ("sure", pa.bool_())])
FOUND = "name long, h1 long, h2 int, pos int, settled boolean"
WINDOWS = "name long, h1 long, h2 int, pos int, lo int, windows binary"
REACH = "key long, h1 long, h2 int, first int, last int, single boolean"
_FOUND = pa.schema([("name", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("pos", pa.int32()), ("settled", pa.bool_())])
_REACH = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("single", pa.bool_())])

#: Rows that make up one new batch of the index, classes that a task remembers, and rows of a group whose windows are compared in memory.
BATCH, CLASSES, GROUP = 1 << 17, 1 << 20, 1 << 13
#: Of the texts one in so many is sampled for frequent names; a name is frequent if so large a part of the sampled anchors has it.
SAMPLED, FREQUENT = 64, 1 / 1000


class Classes:
    """How often a task has met each class: once, or more. It forgets when it is full, which only costs rows."""

    def __init__(self) -> None:
        self.keys, self.twice = np.zeros(0, np.uint64), np.zeros(0, bool)

    def surplus(self, keys: np.ndarray) -> np.ndarray:
        """Which of these are at least the third of their class."""
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(ranked)))
        rank = np.arange(len(ranked)) - np.repeat(first, size)
        fresh = ranked[first]
        at = np.searchsorted(self.keys, fresh)
        known = np.zeros(len(fresh), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == fresh[inside]
        before = np.where(known, 1 + self.twice[np.minimum(at, max(0, len(self.keys) - 1))] if len(self.keys) else 0, 0)
        out = np.zeros(len(keys), bool)
        out[order] = rank + np.repeat(before, size) >= 2
        if len(self.keys) + len(fresh) > CLASSES:
            self.keys, self.twice = np.zeros(0, np.uint64), np.zeros(0, bool)
            known[:] = False
        self.twice[at[known]] |= before[known] + size[known] >= 2
        new = np.flatnonzero(~known)
        at = np.searchsorted(self.keys, fresh[new])
        self.keys, self.twice = np.insert(self.keys, at, fresh[new]), np.insert(self.twice, at, size[new] >= 2)
        return out


def deal(batches: Iterator[pa.RecordBatch], anchors: Callable, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The anchors of texts with what they are dealt by. anchors(batches) gives order1, order2, name, context, h1, h2, pos."""
    classes = Classes()
    for batch in anchors(batches):
        order1, order2, name, context, h1, h2, pos = (batch.column(i).to_numpy() for i in range(7))
        one = mix(name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + context.view(np.uint64))
        sure = classes.surplus(one)
        place = mix(h1.view(np.uint64) + pos.astype(np.uint64))
        route = np.where(sure, place, np.where(np.isin(name, frequent), one, name.view(np.uint64))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(route), *(pa.array(c) for c in (order1, order2, name, context, h1, h2, pos)), pa.array(sure)], schema=_ANCHORS)


class Level:
    """One sorted run of the index: a row for each class, with the first anchor that had it."""

    def __init__(self, columns: list[np.ndarray], again: np.ndarray) -> None:
        self.columns, self.again = columns, again

    def __len__(self) -> int:
        return len(self.again)


class IndexFamily:
    """A logarithmic family of sorted anchor arrays over one slice of the name space.

    Each new batch is sorted by (order1, order2, name, context) and merge-scanned against every level. An anchor whose class is there is a match: it is
    given out at once and not stored, so the index holds one row per class however often it occurs. The rest becomes a new level;
    levels of like size merge, so each row is merged O(log n) times.
    """

    #: Columns that make up a class, and all.
    KEYS, ALL = 4, 7

    def __init__(self) -> None:
        self.levels: list[Level] = []

    @classmethod
    def _same(cls, columns: list[np.ndarray], keys: int) -> np.ndarray:
        """Which rows equal the one before in the first ``keys`` columns."""
        same = np.ones(len(columns[0]), bool)
        same[:1] = False
        for c in columns[:keys]:
            same[1:] &= c[1:] == c[:-1]
        return same

    def add(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Indexes a batch (order1, order2, name, context, h1, h2, pos); returns the anchors that were there already."""
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        same_class, same_place = self._same(columns, self.KEYS), self._same(columns, self.ALL)
        first = np.flatnonzero(~same_class)
        size = np.diff(np.append(first, len(same_class)))
        given = [[c[same_class & ~same_place] for c in columns]]
        rows, again = [c[first] for c in columns], size > 1
        for level in self.levels:
            at, hit = self._scan(level, rows)
            if len(hit):
                level.again[at] = True
                given.append([c[hit] for c in rows])
                rest = np.ones(len(again), bool)
                rest[hit] = False
                rows, again = [c[rest] for c in rows], again[rest]
        if len(again):
            self.levels.append(Level(rows, again))
            while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
                self._merge()
        return [np.concatenate(c) for c in zip(*given, strict=True)]

    @classmethod
    def _scan(cls, level: Level, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A merge scan: the places in the level and in the rows of classes that both have. Either has a class once, so equals are neighbours."""
        both = [np.concatenate([a, b]) for a, b in zip(level.columns[: cls.KEYS], rows[: cls.KEYS], strict=True)]
        order = np.lexsort([np.arange(len(both[0])), *both[::-1]])
        meet = np.flatnonzero(cls._same([c[order] for c in both], cls.KEYS))
        return order[meet - 1], order[meet] - len(level)

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        columns = [np.concatenate(c) for c in zip(a.columns, b.columns, strict=True)]
        order = np.lexsort(columns[::-1])
        self.levels.append(Level([c[order] for c in columns], np.concatenate([a.again, b.again])[order]))

    def finish(self, frequent: Callable) -> tuple[list[np.ndarray], np.ndarray]:
        """First anchors of classes. Settled: a class met again. Not settled: a class whose name has others, or is frequent; its windows are to
        be compared with theirs. An anchor can be given as both."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return [np.zeros(0, np.int64)] * self.ALL, np.zeros(0, bool)
        level = self.levels.pop()
        same = self._same(level.columns, self.KEYS - 1)
        alone = ~same
        alone[:-1] &= ~same[1:]
        again, mixed = np.flatnonzero(level.again), np.flatnonzero(~alone | frequent(level.columns[2]))
        return [c[np.concatenate([again, mixed])] for c in level.columns], np.arange(len(again) + len(mixed)) < len(again)


def match_anchors(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors of one slice of the name space -> those that occur again."""
    index, waiting, held = IndexFamily(), [], 0

    def out(columns: list[np.ndarray], settled: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(settled):
            yield from pieces(pa.RecordBatch.from_arrays([pa.array(columns[2], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int32()), pa.array(settled)], schema=_FOUND))

    def add() -> Iterator[pa.RecordBatch]:
        nonlocal waiting, held
        table = pa.Table.from_batches(waiting)
        waiting, held = [], 0
        columns = [table.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(1, 8)]
        sure = table.column(8).combine_chunks().to_numpy(zero_copy_only=False)
        yield from out([c[sure] for c in columns], np.ones(int(sure.sum()), bool))
        found = index.add([c[~sure] for c in columns])
        yield from out(found, np.ones(len(found[0]), bool))

    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= BATCH:
            yield from add()
    if held:
        yield from add()
    yield from out(*index.finish(lambda name: np.isin(name, frequent)))


def windows_reach(batches: Iterator[pa.RecordBatch], expand: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, each with its windows -> first and last window that occurs twice.

    ``lo`` is the offset of the first window; a window only equals one with the same offset to the same anchor.
    A key's rows are taken together; the hashes are compared column by column (offset by offset), never row by row. A key with more than GROUP rows is
    given on as single windows, a part at a time, so memory is bounded.
    """

    def opened(tables: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(tables).combine_chunks()
        name, h1, h2, pos, lo = (t.column(i).to_numpy() for i in range(5))
        raw = t.column("windows").to_pylist()
        count, values = expand(b"".join(raw), np.array([len(x) for x in raw], np.int64))
        owner, rank = spread(count)
        return name, h1, h2, pos, owner, lo[owner] + rank, values

    def rows(key: np.ndarray, h1: np.ndarray, h2: np.ndarray, first: np.ndarray, last: np.ndarray, single: bool) -> Iterator[pa.RecordBatch]:
        yield from pieces(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h1), pa.array(h2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.full(len(key), single))], schema=_REACH))

    def flush(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h1, h2, pos, owner, offset, values = opened(tables)
        order = np.lexsort((values, offset, name[owner]))
        o, v, f = owner[order], values[order], offset[order]
        same = (v[1:] == v[:-1]) & (f[1:] == f[:-1]) & (name[o[1:]] == name[o[:-1]])
        twice = np.zeros(len(v), bool)
        twice[1:] |= same
        twice[:-1] |= same
        o, f = o[twice], f[twice]
        if len(o):
            first, last = np.full(len(pos), 1 << 30), np.full(len(pos), -(1 << 30))
            np.minimum.at(first, o, f)
            np.maximum.at(last, o, f)
            hit = np.flatnonzero(last >= first)
            yield from rows(mix(h1[hit].view(np.uint64) + pos[hit].astype(np.uint64)), h1[hit], h2[hit], pos[hit] + first[hit], pos[hit] + last[hit], False)

    def singles(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h1, h2, pos, owner, offset, values = opened(tables)
        key = mix(values + mix(name[owner].view(np.uint64) + offset.astype(np.uint64)))
        yield from rows(key, h1[owner], h2[owner], pos[owner] + offset, pos[owner] + offset, True)

    waiting: list[pa.RecordBatch] = []
    held, large = 0, None  # rows that wait; the key whose rows are given on
    for batch in batches:
        while batch.num_rows:
            names = batch.column(0).to_numpy()
            if large is not None:
                cut = int(np.searchsorted(names, large, "right"))
                if cut:
                    yield from singles([batch.slice(0, cut)])
                    batch = batch.slice(cut)
                    continue
                large = None
            cut = int(np.searchsorted(names, names[-1]))  # the last key may go on in the next batch
            done = batch.slice(0, cut)
            if held and (cut or waiting[-1].column(0)[-1].as_py() != int(names[0])):
                # what waits is complete with the rows of its last key at the head of this batch
                head = int(np.searchsorted(names, waiting[-1].column(0)[-1].as_py(), "right"))
                yield from flush([*waiting, batch.slice(0, head)] if head else waiting)
                done, waiting, held = batch.slice(head, max(0, cut - head)), [], 0
                batch = batch.slice(max(cut, head))
            else:
                batch = batch.slice(cut)
            if done.num_rows:
                yield from flush([done])
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
                if held > GROUP:
                    large = waiting[-1].column(0)[-1].as_py()
                    for part in waiting:
                        yield from singles([part])
                    waiting, held = [], 0
            break
    if held:
        yield from flush(waiting)


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key. Single windows -> those whose key another row has too; what is decided passes."""
    last = None  # the row before this batch, and whether it was given
    for batch in batches:
        decided = ~batch.column("single").to_numpy(zero_copy_only=False)
        if decided.any():
            yield batch.filter(pa.array(decided))
        batch = batch.filter(pa.array(~decided))
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        if last is not None and last[0].column(0)[0].as_py() == int(key[0]):
            twice[0] = True
            if not last[1]:
                yield last[0]
        if twice.any():
            yield batch.filter(pa.array(twice))
        last = (batch.slice(batch.num_rows - 1), bool(twice[-1]))


def merge_spans(first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [first, last + width) intervals, sorted."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + width)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] if len(start) else end


def frequent_names(texts: DataFrame, anchors: Callable) -> np.ndarray:
    """Names that many of the sampled texts hold, 1 / FREQUENT at most; what comes to the driver has that bound."""
    some = texts.where(F.pmod("h1", F.lit(SAMPLED)) == 0).mapInArrow(lambda batches: deal(batches, anchors, np.zeros(0, np.int64)), ANCHORS)
    counts = some.groupBy("name").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(16), F.col("total") * FREQUENT)
    found = counts.where("n >= 16").crossJoin(counts.agg(F.sum("n").alias("total"))).where(F.col("n") > least)  # one row on the right
    return np.array(sorted(r.name for r in found.select("name").collect()), np.int64)


def _found(keyed: DataFrame, anchors: Callable) -> DataFrame:
    """The lists of marks of texts (h1, h2, text) that have any: anchors that are met again, settled or not."""
    frequent = frequent_names(keyed, anchors)
    dealt = keyed.mapInArrow(lambda batches: deal(batches, anchors, frequent), ANCHORS).repartition("route")
    found = dealt.mapInArrow(lambda batches: match_anchors(batches, frequent), FOUND)
    return found.groupBy("h1", "h2").agg(F.collect_set(F.struct("pos", "name", "settled")).alias("marks"))


def _reached(opened: DataFrame, expand: Callable) -> DataFrame:
    """The lists of spans of texts whose windows occur twice. opened: WINDOWS."""
    reach = opened.repartition("name").sortWithinPartitions("name").mapInArrow(lambda batches: windows_reach(batches, expand), REACH)
    reach = reach.repartition("key").sortWithinPartitions("key").mapInArrow(single_windows, REACH)
    return reach.groupBy("h1", "h2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def per_text(docs: DataFrame, anchors: Callable, windows: Callable, expand: Callable, finish: Callable, schema: str) -> DataFrame:
    """One row per distinct text of ``docs``: h1, h2 and what ``finish`` makes of the text and its repeated windows.

    anchors(batches of h1, h2, text) gives what ``deal`` takes. windows(batches with text and marks) gives WINDOWS for the marks that
    are not settled. expand(bytes, lengths) gives their window hashes. finish(batches with text, marks and spans) gives ``schema``.
    The marked texts and the final join read the same two shuffles: ``texts`` and ``lists`` keep all their columns in both.
    """
    keyed = docs.select(*text_key(F.col("text")), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lists = _found(keyed, anchors)
    texts = keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    spans = _reached(texts.join(lists, ["h1", "h2"]).mapInArrow(windows, WINDOWS), expand)
    whole = texts.join(lists, ["h1", "h2"], "left").join(spans, ["h1", "h2"], "left")
    return whole.mapInArrow(finish, f"h1 long, h2 int, {schema}")


def per_row(docs: DataFrame, anchors: Callable, windows: Callable, expand: Callable, finish: Callable, schema: str) -> DataFrame:
    """The rows of ``docs`` with the columns of ``schema``, renamed where docs has such a name; arguments as in ``per_text``.

    finish(batches, keep=, marks=, spans=) gives the columns keep before those of schema. Only texts with marks are shuffled: once for the windows of those with
    marks that are not settled, and once with their rows; a sieve lets the other rows stay where they are.
    """
    keyed = docs.select(*text_key(F.col("text")), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lists = cut(_found(keyed, anchors))
    unsettled = lists.where(F.exists("marks", lambda m: ~m["settled"]))
    texts = sieved(keyed, ["h1", "h2"], sieve(unsettled.select("h1", "h2")), "open").where("open").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    spans = _reached(texts.join(unsettled, ["h1", "h2"]).mapInArrow(windows, WINDOWS), expand)
    h1, h2, marks, reached, hit = (free_name([*docs.columns, "word", "bits"], c) for c in ("h1", "h2", "marks", "spans", "hit"))
    lost = lists.join(spans, ["h1", "h2"], "left").select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("marks").alias(marks), F.col("spans").alias(reached))
    rows = sieved(docs.withColumns(dict(zip((h1, h2), text_key(F.col("text")), strict=True))), [h1, h2], sieve(lists.select("h1", "h2")), hit)
    some = rows.where(hit).drop(hit).join(lost, [h1, h2], "left").drop(h1, h2)
    others = rows.where(~F.col(hit)).drop(hit, h1, h2).withColumns({c: F.lit(None).cast(lost.schema[c].dataType) for c in (marks, reached)})
    out = T.StructType([*docs.schema, *(T.StructField(free_name(docs.columns, f.name), f.dataType) for f in T.StructType.fromDDL(schema))])
    columns = docs.columns
    return some.unionByName(others).mapInArrow(lambda batches: finish(batches, keep=columns, marks=marks, spans=reached), out)


def open_marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, name) of the marks that are not settled."""
    count, (pos, name, settled) = marked(batch, "marks", "pos", "name", "settled")
    row = np.repeat(np.arange(batch.num_rows), count)
    return row[~settled], pos[~settled].astype(np.int64), name[~settled]


def window_rows(batch: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, name: np.ndarray, lo: np.ndarray, values: list[bytes]) -> Iterator[pa.RecordBatch]:
    key = [batch.column(k).to_numpy()[row] for k in ("h1", "h2")]
    yield from pieces(pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(key[0], pa.int64()), pa.array(key[1], pa.int32()), pa.array(pos, pa.int32()), pa.array(lo, pa.int32()), pa.array(values, pa.binary())], names=["name", "h1", "h2", "pos", "lo", "windows"]), 4096)


def row_spans(batch: pa.RecordBatch, sizes: np.ndarray, width: int, back: int, ahead: int = 0, marks: str = "marks", spans: str = "spans") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the merged covered spans; a settled mark stands for all windows from ``back`` to ``ahead`` before it."""
    count, (pos, settled) = marked(batch, marks, "pos", "settled")
    row = np.repeat(np.arange(batch.num_rows), count)[settled]
    pos = pos[settled].astype(np.int64)
    more, (first, last) = marked(batch, spans, "first", "last")
    row = np.concatenate([row, np.repeat(np.arange(batch.num_rows), more)])
    first = np.concatenate([pos - back, first.astype(np.int64)])
    last = np.concatenate([pos - ahead, last.astype(np.int64)])
    first, last = np.maximum(first, 0), np.minimum(last, sizes[row] - width)
    ok = first <= last
    row, first, last = row[ok], first[ok], last[ok]
    gap = int(sizes.max(initial=0)) + width + 1  # rows laid end to end, so that no span meets the next row's
    start, end = merge_spans(row * gap + first, row * gap + last, width)
    return start // gap, start % gap, start % gap + (end - start)


def marked(batch: pa.RecordBatch, column: str, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts per row and flat arrays of the fields of a list-of-structs column; a null list is empty."""
    lists = batch.column(column)
    count = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
    flat = lists.flatten()
    return count, [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]
