import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from assaykit.llm import common, signature_trees
from assaykit.llm.signature_trees import SignatureTree, difference, keep_one, near_duplicates, part_keys


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)), key=str)


def made():
    rng = random.Random(2)
    words = [f"W{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(30)]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 200]))]
        rows.append(base)
        for _ in range(rng.randint(0, 6)):
            c = list(base)
            for _ in range(rng.randint(0, 1 + len(c) // 60)):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(c if rng.random() < 0.7 else c + passage)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[0][1].upper()), (3, rows[3][1]), (None, rows[5][1]), (None, "alone here"), (n + 4, "a a a a a a"), (n + 5, "a a a a")]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_against_brute_force(spark, k, num, den):
    docs = spark.createDataFrame(made(), "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(docs, k, num, den, ["doc_id"]).collect()), key=str)
    assert got == brute(made(), k, num, den)


@pytest.mark.parametrize("block", [3, 20])
def test_wide_groups_against_brute_force(spark, monkeypatch, block):
    """Groups over several blocks: a family of near copies, smaller families that a common passage ties to it, and sets on their own."""
    monkeypatch.setattr(signature_trees, "BLOCK_SETS", block)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    passage, rows = [rng.choice(words) for _ in range(60)], []
    for family, edits in ((90, 1), (25, 4), (12, 8), *[(2, 6)] * 12):
        base = passage + [rng.choice(words) for _ in range(60)]
        for _ in range(family):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(60, 120)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, num, den in ((4, 85, 100), (5, 4, 5), (2, 1, 2)):
        got = sorted((tuple(r) for r in near_duplicates(docs, k, num, den, ["doc_id"]).collect()), key=str)
        assert got == brute(rows, k, num, den)
    rows = made()
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 1, 2, ["doc_id"]).collect()), key=str)
    assert got == brute(rows, 2, 1, 2)


def test_chained_sets_take_cells_in_proportion(spark, monkeypatch):
    """Unrelated sets, each tied to the next by a passage, are one wide group; they do not meet block by block."""
    monkeypatch.setattr(signature_trees, "BLOCK_SETS", 40)
    links, dealt = signature_trees._links, []

    def counted(sets, cells, num, den):
        dealt.append(sets.select(F.explode(cells)).count())
        return links(sets, cells, num, den)

    monkeypatch.setattr(signature_trees, "_links", counted)
    rng = random.Random(9)
    passages = [[f"w{rng.randrange(3000)}" for _ in range(30)] for _ in range(403)]
    rows = [(i, " ".join(w for p in passages[i : i + 4] for w in p)) for i in range(400)]
    rows += [(400 + i, f"{t} end") for i, (_, t) in enumerate(rows[::20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in near_duplicates(docs, 5, 4, 5, ["doc_id"]).collect()), key=str)
    assert got == brute(rows, 5, 4, 5)
    assert len(dealt) >= 2 and sum(dealt) < 10 * len(rows), dealt


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_sieve(spark, monkeypatch, bits):
    """No key is lost, and a large sieve lets few others through."""
    monkeypatch.setattr(common, "SIEVE", bits)
    made = common.sieve(spark.range(0, 3000, 3).select(F.col("id").alias("s")))
    rows = common.sieved(spark.range(3000).select(F.col("id").alias("word")), ["word"], made, "inside")
    assert rows.columns == ["word", "inside"] and rows.count() == 3000 and made.count() <= bits / 64
    assert rows.where("word % 3 = 0 and not inside").count() == 0
    assert (rows.where("word % 3 <> 0 and inside").count() < 20) == (bits > 64)


def test_sides_of_a_tree():
    """Sets of one side are not compared, and sets of components that are known are not linked again."""
    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in range(4)]
    tree = SignatureTree(sets, 85, 100)
    tree.pivots = lambda union, most: None
    assert tree.links(side=np.array([1, 1, 1, 1])) == [] == tree.links(np.zeros(4, np.int64))
    assert len(tree.links(side=np.array([1, 1, 2, 2]))) == len(tree.links(np.array([7, 7, 8, 9]), np.zeros(4, np.int8))) + 1 == 3


def test_tree_of_one_component():
    """A large family that is one component, by labels or after the pivots, leaves upper levels without pairs."""
    sets = [np.arange(i % 5, i % 5 + 100, dtype=np.uint64) for i in range(1500)]
    assert len(SignatureTree(sets, 85, 100).links()) == 1499
    assert SignatureTree(sets, 85, 100).links(np.zeros(1500, np.int64)) == []
    assert SignatureTree(sets, 85, 100).links(np.arange(1500), np.ones(1500, np.int8)) != []  # pivots see all


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_duplicates(docs, 4, 85, 100, ["doc_id"]).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


def test_keep_one(spark):
    rows = [(i, t, "x") for i, t in made()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = [(r.doc_id, r.text) for r in keep_one(docs).collect()]
    want = brute(made(), 5, 4, 5)
    blank = sum(1 for _, n, _ in want if not n)
    assert sum(1 for _, t in kept if not shingles(t, 5)) == blank
    ids = sorted(i for i, t in kept if shingles(t, 5) and i is not None)
    assert ids == sorted({c for _, n, c in want if n and c is not None})
    assert sum(1 for i, _ in kept if i is None) == 1


def test_keep_one_with_a_full_sieve(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE", 64)
    test_keep_one(spark)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    assert keep_one(none).count() == 0


def test_tree_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, (12, 90)).astype(np.uint64)
    sets = []
    for b in base:
        for _ in range(40):
            keep = b[rng.random(90) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, int(rng.integers(0, 6))).astype(np.uint64)])))
    root = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both * 100 >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[root == root[a]] = root[b]
    mine = np.arange(len(sets))
    links = SignatureTree(sets, 85, 100).links()
    for a, b in links:
        mine[mine == mine[a]] = mine[b]
    assert len(links) == len(sets) - len(np.unique(root))
    assert len(set(zip(root.tolist(), mine.tolist()))) == len(np.unique(root)) == len(np.unique(mine))


def test_parts_never_lose_a_link():
    """Sets that differ by as much as a link allows post a common part."""
    rng = np.random.default_rng(4)
    for num, den in ((85, 100), (4, 5), (1, 2)):
        for _ in range(300):
            both = int(rng.integers(1, 60))
            extra = both * den // num - both  # the largest union that still links
            left = int(rng.integers(0, extra + 1))
            pool = np.unique(rng.integers(0, 1 << 63, both + extra + 5).astype(np.uint64))[: both + extra]
            rng.shuffle(pool)
            a, b = np.sort(pool[: both + left]), np.sort(np.concatenate([pool[:both], pool[both + left :]]))
            assert len(a) + len(b) - 2 * both <= difference(np.array([len(a)]), np.array([len(b)]), num, den)[0]
            row, key = part_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), num, den)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_every_inner_name_as_an_extra_column(spark):
    """near_duplicates with all columns kept, under all names that the operator uses itself."""
    extra = ["root", "lead", "node", "s", "size", "set_id", "n_shingles", "component_id", "key", "known", "blocks", "seen", "cell", "tokens", "h1", "h2"]
    rows = [(1, "one two three four five six", *range(16)), (2, "one two three four five six", *range(16)), (3, "", *range(16)), (4, None, *range(16))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    made = near_duplicates(df)
    got = {r.doc_id: r for r in made.collect()}
    assert made.columns[: len(df.columns)] == df.columns and all(got[i][c] == k for i in got for k, c in enumerate(extra))
    assert [got[i][made.columns[-1]] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
