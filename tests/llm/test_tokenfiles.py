"""Token files: exact round trip, order, offsets."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from afluente.llm.tokenfiles import ByteEncoder, index_of, read_token_files, token_checksums, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_ids string, frame string, part string"


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def _texts():
    rnd = random.Random(4)
    odd = ["", " ", "\n", "a", "a\nb", "a \nb", "a\n b", "\na", "a b ", "it's 's x", "a,b. c, d.", "é, ß.", "x y", "a b", "\x1c", "日本, 語.",
           "<|endoftext|> a"]
    return odd + ["".join(rnd.choice(" ab\n.,'s1é\t 😀") for _ in range(rnd.randint(1, 40))) for _ in range(500)]


def test_ids_are_the_librarys(library):
    texts = _texts()
    for text, ids in zip(texts, ByteEncoder(PATH).encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark, library, monkeypatch):
    from afluente.llm import tokenfiles

    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 3000)
    rows = [(k * 3 % 521, t, "a", "b", "c") for k, t in enumerate(_texts())]
    rows += [(9000, None, "a", "b", "c"), (5, "again", "a", "b", "c"), (None, "no id", "a", "b", "c"), (8000, "long text " * 40_000, "a", "b", "c")]
    files = write_token_files(spark.createDataFrame(rows, SCHEMA), PATH, end_id=2)
    assert files.manifest.count() > 4
    want = sorted((-1 if d is None else d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows)
    read = sorted((r.start, -1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read_token_files(files).collect())
    assert [r[1] for r in read] == [w[0] for w in want]
    assert sorted(r[1:] for r in read) == want
    assert [r[0] for r in read] == np.cumsum([0] + [len(r[2]) for r in read])[:-1].tolist()
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in token_checksums(files).collect()}
    assert sums == {(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, _, i in read}
    one = files.manifest.first()
    raw = open(f"{files.folder.removeprefix('file://')}/{one.path}", "rb").read()
    assert len(index_of(raw)[0]) == one.n_docs and len(raw) == one.n_bytes


def test_empty_table(spark):
    files = write_token_files(spark.createDataFrame([], SCHEMA), PATH, end_id=2)
    assert token_checksums(files).count() == 0


def test_ids_must_fit_the_width(spark):
    from afluente.llm.tokenfiles import fitted

    assert fitted(np.array([0, 65_535], np.int32), 2).tolist() == [0, 65_535]
    with pytest.raises(ValueError):
        fitted(np.array([65_536], np.int32), 2)
    rows = spark.createDataFrame([(1, "some words of a text", "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="does not fit"):
        write_token_files(rows, PATH, 2, width=1)


def test_recurring_words_stay_known():
    from afluente.llm.words import ChunkIds

    asked = []

    def encode(chunks):
        asked.extend(chunks)
        return [np.array([len(c), *c.encode()], np.int32) for c in chunks]

    table = ChunkIds(encode, limit=40, decimal=True)
    rnd = random.Random(3)
    for k in range(60):
        words = ["often", "again", *(f"w{rnd.randrange(10**6)}" for _ in range(10)), "", "often"]
        numbers = table.numbers(words)
        assert table.ids(numbers).tolist() == [x for w in words for x in (len(w), *w.encode())]
        assert [table.texts[n] for n in numbers] == [",".join(map(str, (len(w), *w.encode()))) for w in words]
        assert len(table.index) <= 40 + len(words)
    assert asked.count("often") == asked.count("again") == asked.count("") == 1
    for k in range(50):  # more recurring words than may stay
        table.numbers([f"r{k}"] * 3)
    assert len(table.index) <= 41


def test_encoder_stays_with_the_worker(library):
    from afluente.llm.tokenfiles import worker_encoder

    assert worker_encoder(PATH) is worker_encoder(PATH)
    texts = _texts()
    for _ in range(2):
        assert [i.tolist() for i in worker_encoder(PATH).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_plain_signs_go_to_the_model_at_once(library, monkeypatch):
    import pyarrow as pa

    from afluente.llm import tokenfiles

    monkeypatch.setattr(tokenfiles, "BLOCK_WORDS", 7)
    rnd = random.Random(8)
    signs = "abcXYZ0189éßñȣ.,;!?#$%&*|<>()-_=\"/@"
    words = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts = ["left out", *("".join(w + rnd.choice([" ", " ", "\n"]) for w in words[k : k + 30])[:-1] for k in range(0, 3000, 30)), "<|endoftext|>", "a"]
    want = [e.ids for e in library.encode_batch_fast(texts[1:], add_special_tokens=False)]
    encoder, asked = ByteEncoder(PATH), []
    whole = encoder._all
    encoder._all = lambda some: asked.extend(some) or whole(some)
    for _ in range(2):
        assert [i.tolist() for i in encoder.encode(pa.array(texts)[1:])] == want
    assert not asked
    odd = ["it's we'll", "a\x00b c", "日本 “c” ½ ª×", "x ²", "'s\n't"]
    assert [i.tolist() for i in encoder.encode(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]
    assert asked


def test_blanks_that_leave_a_text_whole():
    import pyarrow as pa

    from afluente.llm.tokenfiles import as_one

    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = as_one(pa.array([f"a{c}b" for c in signs]))
    assert [c for c, f in zip(signs, found) if f] == [c for c in signs if c.isspace() and c not in " \n"]
    texts = ["", " a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n b", "a\n\nb", "a", "a b\nc"]
    assert as_one(pa.array(texts)).tolist() == [True] * 9 + [False] * 2


def test_recurring_chunks_of_arrays_stay_known():
    import pyarrow as pa

    from afluente.llm.words import ArrowChunkIds

    asked = []

    def encode(chunks):
        asked.extend(chunks.to_pylist())
        ids = [[len(c), *c.encode()] for c in chunks.to_pylist()]
        return np.array([x for i in ids for x in i], np.int32), np.array([len(i) for i in ids])

    table = ArrowChunkIds(encode, limit=40)
    rnd = random.Random(3)
    for k in range(60):
        words = ["often", "again", *(f"w{rnd.randrange(10**6)}" for _ in range(10)), "", "often"]
        numbers = table.numbers(pa.array(["x", *words])[1:])
        assert table.ids(numbers).tolist() == [x for w in words for x in (len(w), *w.encode())]
        assert len(table.chunks) <= 40 + len(words)
    assert asked.count("often") == asked.count("again") == asked.count("") == 1
    assert table.numbers(pa.array([], pa.string())).tolist() == []
