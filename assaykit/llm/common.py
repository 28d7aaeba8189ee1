"""Byte and word arithmetic on Arrow text columns, shared by the operators of this subpackage.

Everything here runs inside Spark tasks on one Arrow batch at a time. Texts are cut into groups of whole
rows of about ``CHUNK`` bytes, so memory is bounded by the group or by the longest single text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 19
#: A prime modulus, two bases, and their inverses. Modulo a power of two, words such as that of Thue and Morse collide whatever the base is.
PRIME = (1 << 31) - 1
BASES = (1_386_744_713, 907_531_889)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)

#: The six ASCII white-space bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

WORD_GAP = r"[\x20\x09-\x0D]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P, _BITS = np.uint64(PRIME), np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, but for some multiples of it: under 2**33 for x under 2**64."""
    low = x & _P
    low += x >> _BITS
    return low


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x under 2**63."""
    x = _fold(_fold(x))
    return np.minimum(x, x - _P)  # below the prime the difference wraps around to a huge number


#: Slices that are hashed at once, so that they stay in a core's cache.
BLOCK = 1 << 13


class Powers:
    """Powers of the bases and of their inverses, grown on demand by doubling."""

    def __init__(self) -> None:
        self.up, self.down = ([np.ones(1, np.uint64) for _ in BASES] for _ in range(2))

    def reach(self, n: int) -> None:
        for powers, bases in ((self.up, BASES), (self.down, INVERSES)):
            for k, base in enumerate(bases):
                while len(powers[k]) <= n:
                    size = len(powers[k])
                    powers[k] = np.concatenate([powers[k], _mod(powers[k] * np.uint64(pow(base, size, PRIME)))])


_POWERS = Powers()


class Rolling:
    """Hashes of any slice of a sequence of integers, from prefix sums: two polynomials modulo a prime, 62 bits together."""

    def __init__(self, values: np.ndarray) -> None:
        _POWERS.reach(len(values) + 1)
        if values.dtype != np.uint8:  # a wide value goes into each sum as another 31 bits of it
            wide = mix(values)
            parts = [wide & np.uint64(PRIME), wide >> np.uint64(33)]
        else:
            parts = [values.astype(np.uint64) + np.uint64(1)] * 2
        self.sums = []
        for part, up in zip(parts, _POWERS.up, strict=True):
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(_fold(part * up[: len(values)]), out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for k in range(0, len(start), BLOCK):
            a, b = start[k : k + BLOCK], end[k : k + BLOCK]
            out[k : k + BLOCK] = self._made([sums[b] - sums[a] for sums in self.sums], [down[a] for down in _POWERS.down], (b - a).astype(np.uint64))
        return out

    def every(self, width: int) -> np.ndarray:
        """The hashes of all slices of one width, in order."""
        n = max(0, len(self.sums[0]) - width)
        out = np.empty(n, np.uint64)
        for k in range(0, n, BLOCK):
            end = min(k + BLOCK, n)
            out[k:end] = self._made([sums[k + width : end + width] - sums[k:end] for sums in self.sums], [down[k:end] for down in _POWERS.down], np.array([width], np.uint64))
        return out

    @staticmethod
    def _made(sums: list[np.ndarray], down: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        first, second = (_mod(_fold(s) * d) for s, d in zip(sums, down, strict=True))
        first <<= _BITS
        first |= second
        first += length * np.uint64(0x9E3779B97F4A7C15)
        return mix(first)


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets into those) for groups of whole rows; a null text has no bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
            raw, width = texts.buffers(), np.int32
        else:
            texts = texts.cast(pa.large_binary())
            raw, width = texts.buffers(), np.int64
        offsets = np.frombuffer(raw[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


class Words:
    """The maximal runs of non-space bytes in a group of texts. ``first[i]:first[i+1]`` are text i's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = _LOWER[data]
        inside = ~_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        after[ends] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = Rolling(data).of(self.start, self.end)
        self.count = np.diff(self.first)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(lengths) items: the index of its owner, and its rank under that owner."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - np.repeat(starts, lengths)


def pieces(table: pa.Table | pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    yield from table.to_batches(max_chunksize=rows)


def text_key(text: Column) -> list[Column]:
    """96 bits that name a text, so that rows with equal texts need no row id. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.hash(text, F.lit(17)).alias("h2")]


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores until no column of the input has it (Spark's names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where none is set, a folder of its own in local mode, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)


def hash_sample(df: DataFrame, key: Column, value: Column, rows: int) -> list:
    """Values of the ``rows`` keys with the least hashes, of all keys if there are fewer; what comes to the driver does not grow with df or its partitions.

    key: a hash that spreads evenly over 64 bits; rows with one hash count once, so the bound follows an estimate of the distinct hashes.
    """
    share = 2 * rows / max(1, df.select(F.approx_count_distinct(key, 0.02).alias("n")).first().n)
    while True:
        low = df.select(key.alias("h"), value.alias("v"))
        if share < 1:
            low = low.where(F.col("h") < -(1 << 63) + int((1 << 64) * share))
        got = low.groupBy("h").agg(F.first("v").alias("v")).collect()
        if share >= 1 or len(got) >= rows:
            return [r.v for r in sorted(got, key=lambda r: r.h)[:rows]]
        share *= 2


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once, in columns, to a folder of its own in the shared place, and read again: compact, and never computed twice."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bits of a sieve.
SIEVE = 1 << 24


def sieve(keys: DataFrame) -> DataFrame:
    """(word, bits): which hashes the rows of ``keys`` have, in SIEVE / 64 rows at most however many keys there are."""
    slots = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(SIEVE)).alias("slot"))
    return cut(slots.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))


def sieved(df: DataFrame, keys: list[str], made: DataFrame, name: str) -> DataFrame:
    """df with a boolean column ``name``, false only where the keys are certainly not among those of the sieve ``made``. A full sieve lets all rows through, which costs rows alone."""
    word, bits = (free_name(df.columns, c) for c in ("word", "bits"))
    slot = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    met = df.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(made.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left")
    return met.withColumn(name, F.coalesce(F.getbit(bits, slot.bitwiseAND(63).cast("int")) == 1, F.lit(False))).drop(word, bits)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, most: int = 1000) -> DataFrame:
    """left outer join of strings ``key``, which are unique in right; ``weight`` (dropped): how many rows of left have the key.

    The ``most`` heaviest keys are broadcast, so no key with over 1 / most of left's rows is shuffled to one task; their rows are dealt by ``spread``.
    right should be cheap to read twice.
    """
    rest = [c for c in right.columns if c not in (key, weight)]
    heavy = right.orderBy(F.desc(weight), key).limit(most)
    hot = heavy.select(key, F.struct(*rest).alias("_hot"))
    cold = right.join(F.broadcast(hot.select(key)), key, "left_anti").select(F.col(key).alias("_key"), F.struct(*rest).alias("_cold"))
    met = left.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("#"), F.xxhash64(spread).cast("string"))))
    both = met.join(cold, "_key", "left").withColumn("_hot", F.coalesce("_hot", "_cold"))
    return both.select(*left.columns, *[F.col("_hot")[c].alias(c) for c in rest])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the edges; root is the smallest node of its component.

    Alternating large-star and small-star rounds. Each round takes the smallest neighbour of every node as a
    partial aggregate and joins it back, so a hub is never gathered in one group.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = cut(small)
        if after.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() == now.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first():
            break
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
