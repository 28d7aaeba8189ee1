"""Pieces: the library's ids, exact round trips, and the scan against a run from left to right."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from assaykit.llm import pieces_scan
from assaykit.llm.pieces_scan import FRESH, Pieces, best_states, compose, pieces_of
from tests.llm.test_operators import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram() -> bytes:
    """A small model of the other kind, written by hand."""
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, False, True
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(300)} | set("abcd"))
    names += ["▁", "▁▁"] + ["▁" + n for n in names[::3]]
    for name, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256)] + [(n, 1) for n in names]:
        piece = model.pieces.add()
        piece.piece, piece.type, piece.score = name, kind, -rng.uniform(1, 9) if kind == 1 else 0.0
    return model.SerializeToString()


@pytest.fixture(scope="module", params=["bpe", "unigram"])
def model(request):
    return pieces_of(PATH) if request.param == "bpe" else Pieces(proto=unigram())


def cut(model, text, chunk):
    """Chunks as _cut makes them."""
    text = " " + text
    out = []
    for a in range(0, len(text), chunk):
        low, b = max(0, a - model.longest), min(a + chunk, len(text))
        out.append((text[low : b + model.longest], a - low, b - low, pieces_scan.lead_of(text, low), a == 0, b == len(text)))
    return out


def scanned(model, text, chunk):
    chunks = cut(model, text, chunk)
    matrices = [model.transfer(*c) for c in chunks]
    for a, b in zip(matrices, matrices[1:]):
        assert a.shape[1] == b.shape[0]
    between = best_states(matrices, 0, 0)
    return np.concatenate([model.chunk_path(*c, e, x) for c, e, x in zip(chunks, [0, *between], [*between, 0])]).tolist()


def samples():
    rng = random.Random(4)
    for n in (1, 5, 60, 400):
        for alphabet in ("abcd", "ab", "abc  ", "the cat sat on é", "zé日本語 ", "\n\t. x"):
            yield "".join(rng.choice(alphabet) for _ in range(n))
    yield from ("x" * 300, "ab" * 150, " " * 100, "wordsthatrunonandon" * 12, "日本語テスト" * 30)


@pytest.mark.parametrize("chunk", [17, 40, 1000])
def test_scan_gives_the_librarys_ids(model, chunk):
    for text in samples():
        got, want = scanned(model, text, chunk), model.library.encode(text)
        if model.kind == pieces_scan.BPE:
            assert got == want, (text[:60], chunk)
        else:  # of equally good segmentations the library takes one by its rounding, the scan one that cuts don't change
            assert got == scanned(model, text, 10_000) and model.decode(got) == text
            score = lambda ids: sum((model.fallback / 2**36 if i in model.byte else model.score[i]) for i in ids)
            assert abs(score(got) - score(want)) < 1e-3 * len(text)


def test_sign_is_kept(model):
    for text in ("▁a ▁▁ b", "a▁b" * 30, "▁"):
        ids = scanned(model, text, 17)
        assert model.decode(ids) == text and ids == model.words([w for w in pieces_scan._UNIT.findall(" " + text)])


def test_greedy_merging(model):
    if model.kind == pieces_scan.BPE:
        for text in samples():
            got = [[model.piece[p]] if p in model.piece else [model.byte[b] for b in p.encode()] for p in model.merged(" " + text)]
            assert [i for part in got for i in part] == model.library.encode(text)


def test_unigram_against_plain_search():
    model, rng = Pieces(proto=unigram()), random.Random(8)
    for _ in range(40):
        word = " " + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))

        def best(at, word=word):
            return 0 if at == len(word) else max(w + best(at + n) for n, _, w in model.steps(word, at, at))

        reach, _ = model.sweep(word, 0, len(word), model.places(word, 0), [FRESH])
        assert max(v[0] for v in reach[len(word)].values()) == best(0)


def test_products_are_associative(model):
    a, b, c, d = [model.transfer(*x) for x in cut(model, "wordsthatrunonandonabcdabcdabacadwithoutanend" * 2, 23)][:4]
    left, right = compose(compose(compose(a, b), c), d), compose(compose(a, b), compose(c, d))
    assert (left == right).all() and left.max() == 0


def test_table_and_edges(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*ODD, ODD[3]])], "doc_id long, text string")
    both = spark.createDataFrame(docs.collect() + odd.collect(), docs.schema).withColumn("ids", F.lit("kept")).repartition(3)
    for chunk in (1 << 15, 700):
        made = pieces_scan.decode(pieces_scan.encode(both, PATH, chunk=chunk, fan=3), PATH, "ids_").collect()
        assert len(made) == 60 + len(ODD) + 1
        for r in made:
            assert r.decoded == (r.text or "") and r.ids == "kept"
            if "▁" not in (r.text or ""):
                assert r.ids_ == library.encode(r.text or "")
            assert r.score == sum(map(library.get_score, r.ids_))
    assert pieces_scan.encode(both.where("false"), PATH).count() == 0


def test_giant_text_without_spaces(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("etaoinshrdlu日本é") for _ in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces_scan.encode(df, PATH).collect()}
    want = sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
    assert got[1] == got[2] == want
