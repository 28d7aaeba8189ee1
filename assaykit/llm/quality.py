"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated score.

``fit`` builds one dictionary from texts labelled 1 and one from texts labelled 0. A text is compressed in blocks with each; the
difference of the two sizes over their sum is the evidence, next to how much further than usual the good dictionary shrinks it (text
that repeats itself). A logistic curve, fitted on labelled texts that built no dictionary, turns both into the chance of label 1. ``score`` compresses whole texts.

The fit takes a bounded sample of labelled rows: at most ``per_class`` a class, least hash of doc_id first, each with its whole text, which is read in Spark
tasks; to the driver come the dictionaries' blocks (at most ``DICT_SAMPLE`` bytes a class, spread evenly over the sampled texts) and three numbers a row.
Edge cases: null and empty texts get the share of label 1 among the labels; rows whose label or id is null aren't learned from;
if a class has no sample, every score is the share of label 1 (0.5 without labels); repeated label rows count once, and a row labelled both ways is learned from as both; the added columns get
an underscore where the input has their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, free_name

BLOCK = 2048
#: Bytes of blocks of a class that a dictionary is built from.
DICT_SAMPLE = 4 << 20
DICT_BYTES = 64 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    share: float
    usual: float = 0.0  # the median log of good size over bytes


def _dictionary(blocks: list[bytes]) -> bytes:
    """zstandard picks the segments when there are enough blocks; else the blocks themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:]


class Sizer:
    def __init__(self, model: Model) -> None:
        self.by = []
        for data in (model.good, model.bad):
            kind = zstandard.DICT_TYPE_AUTO if data else zstandard.DICT_TYPE_RAWCONTENT
            held = zstandard.ZstdCompressionDict(data, dict_type=kind)
            if data:
                held.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held if data else None, write_content_size=False, write_checksum=False, write_dict_id=False))

    def measure(self, text: str | None) -> tuple[float, int, float]:
        """(bad size - good size) / (bad size + good size) over all blocks, the text's bytes, log of good size over bytes."""
        data = (text or "").encode()
        good, bad = (sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.by)
        return (bad - good) / max(1, bad + good), len(data), float(np.log(max(good, 1) / max(len(data), 1)))


def _features(x: np.ndarray, usual: float) -> np.ndarray:
    """Short texts give weaker evidence: their difference counts in proportion to how much of a block they fill."""
    sure = np.minimum(1, np.sqrt(x[:, 1] / BLOCK))
    return np.stack([np.ones(len(x)), x[:, 0], x[:, 0] * sure, np.minimum(0, x[:, 2] - usual + 0.1)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """labels: doc_id and quality (1 good, 0 bad) of the rows to learn from."""
    labels = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    taken = [labels.where(F.col("quality") == q).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # at most 2 * per_class rows: a proven bound for the broadcast and for what comes to the driver
    taken = F.broadcast(taken[0].unionByName(taken[1]))
    rows = docs.select("doc_id", "text").where("text <> ''").join(taken, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))))
    # a block of a text's bytes, each with a number that spreads evenly; the least make the sample
    data = F.encode("text", "utf-8")
    spread = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / BLOCK).cast("int"))).alias("k")
    blocks = rows.where("part = 0").select("quality", "doc_id", data.alias("data"), spread)
    blocks = blocks.select("quality", "doc_id", "k", F.substring("data", F.col("k") * BLOCK + 1, F.lit(BLOCK)).alias("block"), F.xxhash64("doc_id", "k").alias("h"))
    built = [[bytes(r.block) for r in blocks.where(F.col("quality") == q).orderBy("h", "doc_id", "k").limit(DICT_SAMPLE // BLOCK).collect()] for q in (1, 0)]
    held = rows.where("part = 1")
    if not all(built) or held.select("quality").distinct().count() < 2:
        return Model(b"", b"", (), share)
    model = Model(_dictionary(built[0]), _dictionary(built[1]), (), share)

    @F.pandas_udf("array<double>")
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(model)
        for texts in parts:
            yield pd.Series([list(map(float, sizer.measure(t))) for t in texts])

    rows = held.select("quality", "doc_id", measured("text").alias("x")).collect()
    rows.sort(key=lambda r: (str(r.doc_id), r.quality))
    x = np.array([r.x for r in rows])
    y = np.array([r.quality for r in rows], float)
    usual = float(np.median(x[y == 1, 2]))
    w = _logistic(_features(x, usual), y)
    # from the sample's shares to those of the labels
    mean = min(max(share, 1e-3), 1 - 1e-3)
    w[0] += np.log(mean / (1 - mean)) - np.log(y.mean() / (1 - y.mean()))
    return Model(model.good, model.bad, tuple(w.tolist()), share, usual)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (chance of label 1) and predicted (1 if score >= threshold)."""

    @F.pandas_udf("double")
    def chance(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer = Sizer(model)
        for texts in parts:
            if not model.weights:
                yield pd.Series(np.full(len(texts), model.share))
                continue
            x = np.array([sizer.measure(t) for t in texts]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(_features(x, model.usual) @ np.array(model.weights), -30, 30)))
            yield pd.Series(np.where(x[:, 1] == 0, model.share, p))

    s, p = free_name(docs.columns, "score"), free_name(docs.columns, "predicted")
    return docs.withColumn(s, chance("text")).withColumn(p, (F.col(s) >= threshold).cast("int"))
