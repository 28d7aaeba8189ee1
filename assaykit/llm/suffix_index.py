"""Suffix-array dedup: every byte inside a 200-byte string that starts anywhere else is found and removed.

Method: a logarithmic index family. The suffix space is dealt over Spark tasks; in each task new batches of suffixes are sorted (by their first 16
bytes, then by a hash of GRAM bytes, then of all that a window can reach), merge-scanned against the sorted levels for long matches, and levels of
like size merge (``repeats.IndexFamily``). Suffixes are sampled by content: the least of all ``GRAM``-byte strings of each
window, so that both copies of any repeated window have the same suffix in the index and about 1.3 % of all
suffixes are stored. Whether a match is long enough is decided on the bytes around the suffixes, for every window.

``SuffixIndex`` keeps such a family of levels in Parquet between batches.

Edge cases: null text counts as empty; texts shorter than ``width`` bytes have no window and lose nothing; repeated rows
are copies of each other, so all of a text of at least ``width`` bytes that occurs twice is removed; a clashing extra column
of the input stays as it is, and the operator's own column gets an underscore.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import Rolling, cut, free_name, mix, pieces, text_groups, text_key
from assaykit.llm.repeats import open_marks, per_row, per_text, row_spans, window_rows

GRAM = 48
#: Bits of a window's sort key that hold the position, so that the leftmost of equal strings is chosen.
PLACE = np.uint64(28)


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i:i + width] for each i, by block-wise prefix and suffix minima."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def sample(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """Places of the least of each ``span`` hashes in a row, for runs [start, end) of places where all ``span`` fit."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    keys = (hashes >> PLACE << PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = least_in_window(keys, span)
    edge = np.zeros(len(least) + 1, np.int64)
    np.add.at(edge, np.minimum(starts, len(least)), 1)
    np.add.at(edge, np.minimum(np.maximum(ends, starts), len(least)), -1)
    chosen = np.zeros(len(hashes), bool)
    chosen[(least[np.cumsum(edge[:-1]) > 0] & np.uint64((1 << 28) - 1)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def first_bytes(data: np.ndarray, pos: np.ndarray, skip: int) -> np.ndarray:
    """Eight bytes from ``skip`` behind each place, as numbers in the order of the bytes; 0 behind the end."""
    at = pos[:, None] + skip + np.arange(8)
    raw = np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    return (np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def byte_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    gram = min(GRAM, width)
    for batch, data, offsets in text_groups(batches):
        if len(data) < width:
            continue
        rolling = Rolling(data)
        names = rolling.every(gram)
        pos = sample(names, offsets[:-1], offsets[1:] - width + 1, width - gram + 1)
        row = np.searchsorted(offsets, pos, "right") - 1
        low, high = np.maximum(pos - (width - gram), offsets[row]), np.minimum(pos + width, offsets[row + 1])
        context = mix(rolling.of(low, high) + (pos - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        key = [batch.column(k).to_numpy()[row] for k in ("h1", "h2")]
        order = [first_bytes(data, pos, skip) if gram >= skip + 8 else np.zeros(len(pos), np.int64) for skip in (0, 8)]  # within the gram, so that equal grams have equal ones
        yield from pieces(pa.RecordBatch.from_arrays([*map(pa.array, order), pa.array(names[pos].view(np.int64)), pa.array(context.view(np.int64)), pa.array(key[0]), pa.array(key[1]), pa.array((pos - offsets[row]).astype(np.int32))], names=["order1", "order2", "name", "context", "h1", "h2", "pos"]))


def byte_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes that the windows over an unsettled anchor can reach, in two rows.

    Every window holds the half of the surroundings before the anchor or that behind it. Rows meet by the half that their windows hold, not by
    the anchor's name alone: so a common line in many surroundings is no hot group.
    """
    gram = min(GRAM, width)
    half = (width - gram) // 2
    for batch, data, offsets in text_groups(batches):
        row, pos, name = open_marks(batch)
        if not len(row):
            continue
        size, base, rolling, raw = np.diff(offsets)[row], offsets[row], Rolling(data), data.tobytes()
        for side in (0, 1):
            first = np.maximum(pos - (width - gram), 0) if side == 0 else np.maximum(pos - half + 1, 0)
            last = np.minimum(pos - half if side == 0 else pos, size - width)
            low, high = (pos - half, pos + gram) if side == 0 else (pos, pos - half + 1 + width)
            ok = np.flatnonzero(first <= last)
            at, first, end = base[ok], first[ok], last[ok] + width
            shared = rolling.of(at + low[ok], at + np.minimum(high[ok], size[ok]))
            key = mix(name[ok].view(np.uint64) + shared * np.uint64(0x9E3779B97F4A7C15) + np.uint64(side)).view(np.int64)
            yield from window_rows(batch, row[ok], pos[ok], key, first - pos[ok], [raw[x:y] for x, y in zip((at + first).tolist(), (at + end).tolist(), strict=True)])


def byte_hashes(raw: bytes, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.maximum(lengths - width + 1, 0)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(count)), count)
    start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return count, Rolling(np.frombuffer(raw, np.uint8)).of(start, start + width)


def byte_finish(batches: Iterator[pa.RecordBatch], width: int, keep: Sequence[str] = ("h1", "h2"), marks: str = "marks", spans: str = "spans") -> Iterator[pa.RecordBatch]:
    back = width - min(GRAM, width)
    for batch, data, offsets in text_groups(batches):
        sizes = np.diff(offsets)
        row, start, end = row_spans(batch, sizes, width, back, marks=marks, spans=spans)
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, offsets[row] + start, 1)
        np.add.at(gone, offsets[row] + end, -1)
        kept = np.cumsum(gone[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(kept)])[offsets]
        ends = np.searchsorted(row, np.arange(len(sizes) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["start", "end"])
        body = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[kept].tobytes())])
        yield from pieces(pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes), body, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], names=[*keep, *(free_name(list(keep), c) for c in ("n_bytes", "kept", "spans"))]), 1000)


def _family(width: int) -> tuple:
    """What ``per_text`` and ``per_row`` take after docs."""
    steps = (functools.partial(f, width=width) for f in (byte_anchors, byte_windows, byte_hashes, byte_finish))
    return *steps, "n_bytes long, kept binary, spans array<struct<start: long, end: long>>"


def repeated_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """Per distinct text: h1, h2, n_bytes, kept (binary), spans (the removed runs as byte start and end)."""
    return per_text(docs, *_family(width))


def remove_repeated_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """The rows of ``docs`` with added columns n_bytes, kept (binary) and spans."""
    return per_row(docs, *_family(width))


class SuffixIndex:
    """A family of levels in a shared folder, to which batches of documents are added.

    A level is a Parquet table of suffixes (name, h1, h2), sorted by name within files; the texts lie beside them. ``add_batch`` merge-joins the new suffixes with every
    level, takes the old texts that share one, and compares these with the batch; then the batch becomes a level, and levels of like size
    are rewritten as one, so that each suffix is written O(log n) times. A manifest is written last, so a lost run leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = 200) -> None:
        self.spark, self.folder, self.width = spark, folder, width

    def levels(self) -> list[tuple[str, int]]:
        """Folder and number of suffixes of each level, the oldest first."""
        try:
            newest = self.spark.read.parquet(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [(r.level, r.rows) for r in newest.levels]

    def _suffixes(self, texts: DataFrame) -> DataFrame:
        made = texts.mapInArrow(functools.partial(byte_anchors, width=self.width), "order1 long, order2 long, name long, context long, h1 long, h2 int, pos int")
        return made.select("name", "h1", "h2").distinct()

    def _read(self, level: str, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{level}/{what}")

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """Per distinct text of the batch what ``repeated_bytes`` gives, over the batch and all batches before."""
        keyed = docs.select(*text_key(F.col("text")), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("copies", F.lit(1))
        here, version = uuid.uuid4().hex, 1
        keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).write.parquet(f"{self.folder}/{here}/texts")
        texts = self._read(here, "texts")
        self._suffixes(texts).repartition("name").sortWithinPartitions("name").write.parquet(f"{self.folder}/{here}/suffixes")
        new, old = self._read(here, "suffixes"), self.levels()
        both = docs.select("text")
        for level, _ in old:
            met = self._read(level, "suffixes").join(new.select("name").distinct(), "name", "left_semi").select("h1", "h2").distinct()
            both = both.unionByName(self._read(level, "texts").join(met, ["h1", "h2"], "left_semi").select("text"))
        made = cut(repeated_bytes(both, self.width).join(texts.select("h1", "h2"), ["h1", "h2"], "left_semi"))
        now = [*old, (here, new.count())]
        while len(now) > 1 and now[-2][1] <= 2 * now[-1][1]:
            (a, n), (b, m) = now[-2], now[-1]
            merged = uuid.uuid4().hex
            self._read(a, "texts").unionByName(self._read(b, "texts")).groupBy("h1", "h2").agg(F.first("text").alias("text"), F.sum("copies").alias("copies")).write.parquet(f"{self.folder}/{merged}/texts")
            self._read(a, "suffixes").unionByName(self._read(b, "suffixes")).distinct().repartition("name").sortWithinPartitions("name").write.parquet(f"{self.folder}/{merged}/suffixes")
            now[-2:] = [(merged, n + m)]
        if old:
            version = self.spark.read.parquet(f"{self.folder}/manifest").agg(F.max("version")).first()[0] + 1
        self.spark.createDataFrame([(version, now)], "version int, levels array<struct<level: string, rows: long>>").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return made

