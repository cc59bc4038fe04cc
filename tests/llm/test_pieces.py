"""Ids and decoded texts equal those of the tokenizer library."""

import random

import numpy as np
import pytest

from strandloom.llm import pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.read_model(pieces.default_model()))


def test_documents(rows, documents, library):
    path, texts = pieces.default_model(), dict(documents)
    got = pieces.decode(pieces.encode(rows(documents), path), path).collect()
    assert len(got) == len(documents)
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id], add_eos=True)
        assert r.decoded == library.decode(list(r.ids)) == texts[r.doc_id]


def test_odd_cases(rows, library):
    path = pieces.default_model()
    texts = [None, "", " ", "   a  ", "▁x ▁", "</s><unk><0x41>", "​\x00 \t\r\n", "x" * 5000, "ab" * 20_000, " " * 999, "日本語のテキスト 😀", "x.’s.a»b12   3!a", "É(é)"]
    got = pieces.decode(pieces.encode(rows([(None if i == 2 else i, t) for i, t in enumerate(texts)] * 2), path), path).collect()
    wanted = {(None if i == 2 else i, tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or ""))) for i, t in enumerate(texts)}
    assert len(got) == 2 * len(texts)
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in got} == wanted
    assert pieces.encode(rows([(1, "a")]).limit(0), path).count() == 0


def test_random_texts_and_ids(model, library):
    rng = random.Random(5)
    vocabulary = list(model.normal)
    forms = [
        lambda: rng.choice(vocabulary).replace("▁", " "), lambda: rng.choice("ab  \n\t12é日😀▁\x00.,’"), lambda: rng.choice("aeinrst "),
        lambda: chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])), lambda: rng.choice(["ing", "the ", "tion", "s ", "er", "re", "\n", "  "]),
    ]
    for i in range(2000):
        text = "".join(forms[i % len(forms)]() for _ in range(rng.randint(0, 60)))
        ids = np.frombuffer(model.encode(text), np.int32)
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert model.decode(ids) == library.decode(ids.tolist())
        drawn = [rng.choice(model.byte_id) if rng.random() < 0.5 else rng.randrange(model.size) for _ in range(20)]
        assert model.decode(np.array(drawn)) == library.decode(drawn)


def test_every_letter_of_a_prefix_has_one_last_piece(model, library):
    text = "▁unbelievably▁well"
    last = model.last_pieces(text)
    for n in range(2, len(text) + 1):
        assert last[n - 1] == library.encode(text[1:n].replace("▁", " "))[-1]


def test_small_limits_change_nothing(library, documents, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    small = pieces.Model(pieces.read_model(pieces.default_model()))
    for _, text in documents[:20]:
        assert np.frombuffer(small.encode(text), np.int32).tolist() == library.encode(text, add_eos=True)


def test_query(spark, small, library):
    from hashlib import sha256

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = pieces.op13_pieces(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        wanted = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        pieces.Model(b"")
