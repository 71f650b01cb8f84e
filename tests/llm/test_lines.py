"""Line dedup: filters, results, insertions and deletions."""

import random
from collections import defaultdict

import pytest

from afluente.llm.lines import CuckooFilter, build_index, delete_documents, drop_repeated_lines, insert_documents
from afluente.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

SCHEMA = "doc_id long, text string, lang string, n_lines string, key string, doc string, lost string"
BLANKS = " \t\n\x0b\x0c\r"


def _plain(rows):
    """Brute force: (doc_id, text) to (doc_id, lines, dropped, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(BLANKS).translate(lower)
    order = lambda d: float("-inf") if d is None else d
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == order(doc)]
        out.append((order(doc), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def _rows(seed, first, count):
    rnd = random.Random(seed)
    pool = [f"{'Shared Line' if k % 2 else 'É shared line'} number {k:04d} with some length" for k in range(12)]
    pool += ["short", "", "   ", "exactly nineteen ch", "exactly twenty chars"]
    pick = lambda: rnd.choice(pool)
    line = lambda: f"{rnd.choice(['', ' ', chr(9)])}{pick().upper() if rnd.random() < 0.2 else pick()}{rnd.choice(['', ' ', chr(13)])}"
    return [(first + k, "\n".join(line() for _ in range(rnd.randint(1, 7)))) for k in range(count)]


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", "b", "c", "d") for d, t in rows], SCHEMA)


def _found(frame):
    return sorted((float("-inf") if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect())


def test_filter_holds_and_gives_up_keys():
    rnd = random.Random(1)
    keys = [rnd.randbytes(16) for _ in range(5000)]
    import numpy as np

    words = lambda some: np.frombuffer(b"".join(some), np.uint64).reshape(-1, 2)
    made = CuckooFilter.of_bytes(CuckooFilter.for_keys(keys).to_bytes())
    assert made.holds(words(keys)).all()
    others = [rnd.randbytes(16) for _ in range(20_000)]
    assert made.holds(words(others)).mean() < 0.001
    for key in keys[:2500]:
        made.delete(key)
    assert made.holds(words(keys[2500:])).all()
    assert made.holds(words(keys[:2500])).mean() < 0.001
    assert CuckooFilter.for_keys([]).holds(words(keys)).sum() == 0


def test_cases(spark):
    rows = _rows(1, 0, 40) + [(90, None), (91, ""), (92, "\n\n"), (None, "a line held by somebody without id")]
    rows += [(93, "a line held by somebody without id"), (94, "A LINE held by somebody without id\nx")]
    rows += [(7, "a line in a repeated row, once more"), (7, "a line in a repeated row, once more"), (8, "a line in a repeated row, once more")]
    rows += [(95, "\n".join(["the same line over and over again"] * 30_000)), (96, "the same line over and over again")]
    found = drop_repeated_lines(_frame(spark, rows))
    assert found.columns == ["doc_id", "lang", "key", "doc", "lost", "text", "n_lines", "n_dropped"]
    assert _found(found) == _plain(rows)
    assert drop_repeated_lines(_frame(spark, [])).count() == 0


def test_insertions_and_deletions_are_those_of_a_new_index(spark):
    first, second = _rows(2, 0, 25), _rows(3, 100, 25)
    index = insert_documents(build_index(_frame(spark, first)), _frame(spark, second))
    assert _found(drop_repeated_lines(_frame(spark, first + second), index)) == _plain(first + second)
    gone = {d for d, _ in first[::2] + second[1::3]}
    left = [r for r in first + second if r[0] not in gone]
    index = delete_documents(index, spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    assert _found(drop_repeated_lines(_frame(spark, left), index)) == _plain(left)
    filters = {r.shard: r.filter for r in index.filters.collect()}
    assert sum(sum(1 for k in range(0, len(f), 2) if f[k : k + 2] != b"\0\0") for f in filters.values()) == index.active.count()
    index = delete_documents(index, spark.createDataFrame([(d,) for d, _ in left], "doc_id long"))
    assert index.active.count() == 0 and index.references.count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(spark, connect(folder), folder, "op5", QUERIES["op5_line_dedup"], ORACLES["op5_line_dedup"]) is None


@pytest.mark.parametrize("limit", [0])
def test_filters_too_large_to_send(spark, monkeypatch, limit):
    from afluente.llm import lines

    monkeypatch.setattr(lines, "FILTER_LIMIT_BYTES", limit)
    rows = _rows(4, 0, 30)
    assert _found(drop_repeated_lines(_frame(spark, rows))) == _plain(rows)
