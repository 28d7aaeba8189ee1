"""Alignment against token-by-token offsets from the libraries themselves."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tokenizers

from assaykit.llm.alignment import align_documents, lanes, lockstep
from assaykit.llm.queries import op12_lockstep_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """Straight from the contract, one text at a time."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in shown}
    byte |= {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    found = []
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a, raw_b = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        at_b = {e: k for k, e in enumerate(end_b)}
        cuts = [(k, at_b[e]) for k, e in enumerate(end_a) if e in at_b]
        found.append((doc_id, ids_a, ids_b, cuts, [(ids_a[x], ids_b[y]) for x, y in cuts]))
    count = Counter(p for *_, links in found for p in links)
    high = {}
    for (_, y), n in count.items():
        high[y] = max(high.get(y, 0), n)
    out = []
    for doc_id, ids_a, ids_b, cuts, links in found:
        parts, x0, y0 = [], 0, 0
        for x, y in cuts:
            parts.append(",".join(map(str, ids_a[x0 : x + 1])) + "|" + ",".join(map(str, ids_b[y0 : y + 1])))
            x0, y0 = x + 1, y + 1
        text = ";".join(parts)
        out.append((doc_id, len(ids_a), len(ids_b), len(cuts), len(links), sum(count[p] == high[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  ", "a", " lead", "trail ", "two  spaces", "tab\t x", "line\n\nfeed \n y", "<|endoftext|> <s> </s> <unk>", "▁ sign", "naïve café 東京 😀 \U0001f469‍\U0001f52c", "x" * 5000, "don't we'll 12,345.6", " nbsp   x", "\x00\x1c \x1c", "a  b", "é" * 700 + " " + "ü" * 700, "0 1 2", "a a a a", "a a a a"]


def test_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for lane, block in ((512, 1 << 20), (7, 100)):
        got = align_documents(df, A, B, lane=lane, block=block).select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows)


def test_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_lockstep_alignment(spark, sf).select(COLUMNS).collect()), key=str) == plain(rows)


def test_clashing_names_and_empty(spark):
    extra = ["n_a", "n_best", "block", "pair_numbers", "number", "best", "total", "h1"]
    df = spark.createDataFrame([(1, "one two", *[5] * len(extra))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    row = align_documents(df, A, B).first()
    assert [row[c] for c in extra] == [5] * len(extra) and row["n_a_"] == 2
    assert align_documents(df.limit(0), A, B).count() == 0


def test_lockstep_against_sets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(0, 60, 6)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ends = []
        for _ in range(2):
            pick = np.flatnonzero(rng.random(edges[-1] + 1) < 0.4)
            ends.append(np.union1d(pick[pick > 0], edges[edges > 0]))
        a, b = lockstep(ends[0], ends[1], *lanes(edges, int(rng.integers(1, 40))))
        both = np.intersect1d(*ends)
        assert (ends[0][a] == both).all() and (ends[1][b] == both).all() and len(a) == len(both)
