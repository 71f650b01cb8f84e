"""SentencePiece: ids against the library, whole texts."""

import hashlib
import random

import pytest
import public_tokenizers

from afluente.llm.pieces import CheckedIds, Merger, encode_documents, load, summarise_encoding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def checked():
    return CheckedIds(Merger(load(MODEL)))


def _texts():
    rnd = random.Random(3)
    odd = ["", " ", "  ", "\n", " a", "a ", "a   b \n c", "▁x", "x▁▁y", " \n\n ", "日本語テキスト" * 30, "x" * 500, "ab" * 400, "\x00",
           "😀 hi", "é", "a\tb\r\nc", " ▁ ", "<s> </s> <unk> <0x41>"]
    odd += ["".join(rnd.choice(" ab\n▁é.,😀th") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    return odd + ["".join(rnd.choice("thenofading") for _ in range(300)) for _ in range(20)]


def test_ids_are_the_librarys(checked):
    for text in _texts():
        numbers = checked.table.numbers(checked.merger.chunks(text))
        assert checked.table.ids(numbers).tolist() == checked.merger.library.encode(text), repr(text)
    assert checked.mended == 0


def test_heap_and_steps_agree(checked):
    merger = checked.merger
    for text in ("▁thtionbleness", "▁▁▁▁▁a", "\nWord", "▁éàü😀"):
        assert merger.finish(merger.agenda(text)).tolist() == merger.encode([text])[0].tolist()


def test_documents(spark):
    texts = [*_texts(), None, "many words " * 20_000]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(0, "again", "x", "y"), (None, "no id", "x", "y")]
    table = spark.createDataFrame(rows, SCHEMA)
    library = load(MODEL)
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((-1 if k is None else k, ids, library.decode(ids)))
    found = [(-1 if r.doc_id is None else r.doc_id, r.ids, r.text) for r in encode_documents(table, MODEL).collect()]
    assert sorted(found) == sorted(want)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    summed = summarise_encoding(table, MODEL).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in summed) == sorted(
        (k, len(ids), digest(",".join(map(str, ids))), digest(text)) for k, ids, text in want
    )
    assert {r.n_mended for r in summed} == {0}
    assert summarise_encoding(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
