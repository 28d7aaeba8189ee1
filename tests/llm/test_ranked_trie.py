"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from assaykit.llm import ranked_trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m, score = 75 + 25 * sum(c.values()) * n_docs // total, 0
            for t in TERM.findall((text or "").translate(LOW)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def made(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "Straße", "x1", "東京"]
    docs = [(k, " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(1, 60)))) for k in range(n)]
    docs += [(1000 + k, "W1 w2, w3. w1") for k in range(90)] + [(None, "w1 w2 w3 w1"), (5000, None), (5001, ""), (5002, "... !"), (5003, "long " * 30_000 + "w5"), (7, docs[7][1])]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(30)] + [(30, None), (31, "absent"), (32, "W1 w1 W2"), (32, "W1 w1 W2"), (None, "w3"), (33, ""), (34, "ÉÉ É é")]
    return docs, items


def test_against_all_documents(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"k": 3, "stretch": 16, "most_items": 7, "most_terms": 20}):
        got = ranked_trie.search(d, q, **options).collect()
        assert sorted(map(tuple, got), key=str) == plain(docs, items, options.get("k", 20))


def test_empty_and_clashing(spark):
    d = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, n int, terms int")
    q = spark.createDataFrame([(1, "a", 5, 6)], "item_id long, text string, rank int, score int")
    assert [tuple(r)[:3] for r in ranked_trie.search(d, q).collect()] == [(1, 1, 1)]
    assert ranked_trie.search(d.limit(0), q).count() == 0 and ranked_trie.search(d, q.limit(0)).count() == 0


def test_tree_prunes_and_bounds_hold():
    """Each node's bound is no less than any score below it, and a search looks at a part of the documents."""
    rng = np.random.default_rng(4)
    size = rng.integers(1, 12, 3000)
    rank = np.concatenate([np.sort(rng.choice(40, s, replace=False)) for s in size])
    edge = np.concatenate([[0], np.cumsum(size)])
    rows = sorted((rank[a:b].tolist(), k) for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)))
    path = np.concatenate([r for r, _ in rows])
    size = np.array([len(r) for r, _ in rows])
    tf, m, ids = rng.integers(1, 5, len(path)), rng.integers(75, 300, 3000), np.array([k for _, k in rows])
    tree = ranked_trie.Tree(path, size, tf, m, ids)
    term, weight = np.array([0, 7, 21]), np.array([10, 900, 4000])
    nodes, exact = tree.bounds(0, np.zeros(1, np.int64), np.array([3000]), term, weight)
    for k in range(1, len(tree.levels)):
        level = tree.levels[k]
        _, bound = tree.bounds(k, np.zeros(1, np.int64), np.array([level.n]), term, weight)
        at = np.arange(level.n)
        for below in reversed(tree.levels[1 : k + 1]):
            at = below.first[at]
        assert (bound >= np.maximum.reduceat(exact, at)).all()
    seen = []
    inner = tree.bounds
    tree.bounds = lambda level, low, high, *rest: (seen.append(int((high - low).sum()) if level == 0 else 0), inner(level, low, high, *rest))[1]
    scores, found = tree.search(term, weight, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 20)
    order = np.lexsort((ids, -exact))[:20]
    assert scores.tolist() == exact[order].tolist() and found.tolist() == ids[order].tolist() and sum(seen) < 2000
