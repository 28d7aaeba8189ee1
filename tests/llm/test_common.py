import random

import numpy as np

from assaykit.llm.common import Rolling, Words
from assaykit.llm.recompression import remove_repeated_words
from assaykit.llm.signature_trees import near_duplicates
from assaykit.llm.suffix_index import remove_repeated_bytes


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_slices_hash_as_themselves():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 256, 3000).astype(np.uint8), rng.integers(0, 1 << 63, 3000).astype(np.uint64)):
        twice = np.concatenate([values, values[:5], values])
        start = rng.integers(0, 2900, 500)
        end = start + rng.integers(0, 100, 500)
        rolling = Rolling(twice)
        assert (rolling.of(start, end) == rolling.of(start + 3005, end + 3005)).all()
        assert (rolling.of(start, end) == Rolling(values).of(start, end)).all()
    seen = {}
    data = np.frombuffer(bytes(random.Random(2).choices(b"ab", k=20_000)), np.uint8)
    for n in (17, 18):
        at = np.arange(len(data) - n)
        for i, h in zip(at.tolist(), Rolling(data).of(at, at + n).tolist()):
            assert seen.setdefault(h, data[i : i + n].tobytes()) == data[i : i + n].tobytes()


def test_words_that_collide_modulo_powers_of_two(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        data = (one[:n] + " " + other[:n]).encode()
        a, b = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash
        assert a != b
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{one[:1024]} {rest}"), (2, f"{other[:1024]} {rest}"), (3, one[:300]), (4, other[:300])], "doc_id long, text string")
    assert [r.spans for r in remove_repeated_words(docs, 35).collect()] == [[]] * 4
    pair = spark.createDataFrame([(1, f"{one[:1024]} a b c"), (2, f"{other[:1024]} a b c")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(pair, words=4, num=85, den=100).collect()} == {1, 2}
    blocks = spark.createDataFrame([(1, one[:256] + "x" * 199), (2, "y" * 199 + other[:256])], "doc_id long, text string")
    got = {r.doc_id: len(r.kept) for r in remove_repeated_bytes(blocks, 256).collect()}
    assert got == {1: 455, 2: 455}
