import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import repeats
from assaykit.llm.recompression import Parse, remove_repeated_words
from assaykit.llm.suffix_index import SuffixIndex, remove_repeated_bytes


def spans_of(gone):
    return sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))


def brute(sequences, width):
    """Which places of each sequence are covered by a window that occurs twice."""
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def texts():
    rng = random.Random(5)
    few = ["the", "of", "and", "a"]
    words = few + [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 300))] for _ in range(25)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = [" ".join(b) for b in base]
    for b in base[:10]:
        c = list(b)
        for _ in range(3):
            if c:
                c[rng.randrange(len(c))] = "changed"
        docs.append(" ".join(c))
        at = rng.randint(0, len(b))
        docs.append(" ".join(b[:at] + passage + b[at:]))
    docs += [docs[3], docs[3], None, "", " \t\n", "x", "ab " * 400, "ab " * 37, "aa aa bb " * 60, "é" * 150, "é" * 100, "é" * 99, "z" * 199]
    docs += [" ".join(rng.choice(few) for _ in range(400)) for _ in range(4)]
    docs += ["of the of the a a " * 30 + "end", "the of a a " * 20]
    return docs


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, h1 int").repartition(5)


def test_bytes_against_brute_force(frame):
    got = {r.h1: r for r in remove_repeated_bytes(frame).collect()}
    data = [(t or "").encode() for t in texts()]
    for i, gone in enumerate(brute(data, 200)):
        kept = bytes(b for b, g in zip(data[i], gone) if not g)
        assert (got[i].n_bytes, bytes(got[i].kept), len(got[i].spans)) == (len(data[i]), kept, spans_of(gone)), i


@pytest.mark.parametrize("width", [35, 50, 12, 3])
def test_words_against_brute_force(frame, width):
    got = {r.h1: r for r in remove_repeated_words(frame, width).collect()}
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts()]
    for i, gone in enumerate(brute(data, width)):
        kept = [w for w, g in zip(data[i], gone) if not g]
        assert got[i].n_words == len(data[i])
        assert re.findall(r"[^\x20\x09-\x0D]+", got[i].kept) == kept, i
        assert len(got[i].spans) == spans_of(gone)
        if not any(gone):
            assert got[i].kept == (texts()[i] or "")


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute([r.text.encode() for r in rows], 200)
    got = {r.doc_id: r for r in remove_repeated_bytes(docs).collect()}
    for r, gone in zip(rows, want):
        kept = bytes(b for b, g in zip(r.text.encode(), gone) if not g)
        assert hashlib.sha256(bytes(got[r.doc_id].kept)).digest() == hashlib.sha256(kept).digest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(none).count() == 0
    assert remove_repeated_words(none).count() == 0


def test_equal_windows_share_an_anchor():
    """The guarantee of the rounds, on windows put into other surroundings."""
    rng = np.random.default_rng(3)
    for width in (10, 20, 35, 64):
        parse = Parse(width)
        assert parse.back - parse.margin + 1 >= parse.longest
        for alphabet in (2, 3, 50):
            inner = rng.integers(0, alphabet, width).astype(np.uint64)
            seen = set()
            for _ in range(20):
                names = np.concatenate([rng.integers(0, alphabet, 30).astype(np.uint64), inner, rng.integers(0, alphabet, 30).astype(np.uint64)])
                at = parse.boundaries(names, np.zeros(len(names), int)) - 30
                seen.add(tuple(at[(at >= parse.margin) & (at <= width - parse.margin)]))
            assert len(seen) == 1


def test_third_of_a_class_and_later_is_surplus():
    rng, seen = random.Random(1), Counter()
    classes = repeats.Classes()
    for _ in range(30):
        keys = [rng.randrange(40) for _ in range(rng.randrange(30))]
        want = []
        for k in keys:
            want.append(seen[k] >= 2)
            seen[k] += 1
        assert classes.surplus(np.array(keys, np.uint64)).tolist() == want


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_groups_over_the_bound_go_on_as_single_windows(monkeypatch, size):
    """windows_reach and single_windows against all pairs, whatever batches the rows come in."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "GROUP", 8)
    rng = random.Random(size)
    rows = []
    for key, n in ((1, 3), (2, 30), (3, 1), (5, 9), (6, 40), (7, 2)):
        for _ in range(n):
            lo = rng.choice((-3, -2))
            rows.append((key, len(rows), 0, 100, lo, np.array([rng.choice((1, 2, 3, rng.randrange(1 << 40))) for _ in range(4)], np.uint64).tobytes()))
    names = ["name", "h1", "h2", "pos", "lo", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], names=names) for i in range(0, len(rows), size)]
    made = pa.Table.from_batches(list(repeats.windows_reach(iter(batches), lambda raw, n: (n // 8, np.frombuffer(raw, np.uint64)))), schema=repeats._REACH).sort_by("key")
    cover = {}
    for r in pa.Table.from_batches(list(repeats.single_windows(iter(made.to_batches(max_chunksize=size)))), schema=repeats._REACH).to_pylist():
        low, high = cover.get(r["h1"], (10**9, -1))
        cover[r["h1"]] = (min(low, r["first"]), max(high, r["last"]))
    values = {h: (key, lo, np.frombuffer(raw, np.uint64)) for key, h, _, _, lo, raw in rows}
    count = Counter((key, lo + i, int(v)) for key, lo, vs in values.values() for i, v in enumerate(vs))
    want = {}
    for h, (key, lo, vs) in values.items():
        hit = [100 + lo + i for i, v in enumerate(vs) if count[key, lo + i, int(v)] > 1]
        if hit:
            want[h] = (min(hit), max(hit))
    assert cover == want


def test_frequent_names_change_no_result(frame, monkeypatch):
    plain = {r.h1: bytes(r.kept) for r in remove_repeated_bytes(frame).collect()}
    monkeypatch.setattr(repeats, "frequent_names", lambda texts, anchors: np.array(sorted({r.name for r in texts.mapInArrow(lambda b: repeats.deal(b, anchors, np.zeros(0, np.int64)), repeats.ANCHORS).collect()})[::2], np.int64))
    assert {r.h1: bytes(r.kept) for r in remove_repeated_bytes(frame).collect()} == plain


def test_batches_meet_a_stored_index(spark, tmp_path):
    data = [t for t in texts()]
    random.Random(2).shuffle(data)
    index, seen = SuffixIndex(spark, str(tmp_path / "index")), []
    for k in range(0, len(data), 20):
        batch = data[k : k + 20]
        seen += batch
        made = index.add_batch(spark.createDataFrame([(t,) for t in batch], "text string")).collect()
        want = brute([(t or "").encode() for t in seen], 200)[-len(batch) :]
        kept = sorted({bytes(b for b, g in zip((t or "").encode(), gone) if not g) for t, gone in zip(batch, want)})
        assert sorted({bytes(r.kept) for r in made}) == kept
    assert len(index.levels()) < len(range(0, len(data), 20)) and sum(n for _, n in index.levels()) > 0
