"""SimHash: fingerprints, links and components against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from afluente.llm.components import smallest_reachable
from afluente.llm.simhash import fingerprint, fingerprint_of, links, near_duplicates, near_pairs, parts_for, visits

SCHEMA = "doc_id long, text string, fingerprint int, component_id string"


def _components(values, radius):
    above = {v: v for v in values}

    def top(v):
        while above[v] != v:
            v = above[v]
        return v

    array = np.array(sorted(values), np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(array[:, None] ^ array[None, :]) <= radius)):
        a, b = top(int(array[i])), top(int(array[j]))
        above[max(a, b)] = min(a, b)
    return {v: top(v) for v in values}


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_links_join_all_near_fingerprints(spark, parts):
    rnd = random.Random(parts)
    values = set()
    for _ in range(60):
        value = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):  # chains of near ones
            values.add(value)
            for _ in range(rnd.randint(1, 3)):
                value ^= 1 << rnd.randrange(64)
    values |= {0, 1, 3, 2**64 - 1, 2**64 - 2}
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), v % 1_000_003) for v in values], "fingerprint long, low long")
    found = links(rows, 2, parts)
    for row in found.collect():
        a, b = row.a & (2**64 - 1), row.b & (2**64 - 1)
        assert a in values and b in values
    wanted = _components(values, 2)
    lowest = {}
    for value, top in wanted.items():
        lowest[top] = min(lowest.get(top, value % 1_000_003), value % 1_000_003)
    components = {r.fingerprint & (2**64 - 1): r.component for r in smallest_reachable(rows, found).collect()}
    assert components == {v: lowest[t] for v, t in wanted.items()}


def test_components_write_few_tables(spark, monkeypatch):
    from afluente.llm import components

    saved, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df: saved.append(df) or write(df))
    nodes = spark.range(200).select(F.col("id").alias("fingerprint"), F.col("id").alias("low"))
    chain = nodes.select(F.col("low").alias("a"), F.greatest("low", F.lit(1)).alias("b")).selectExpr("a", "b - 1 as b").coalesce(1)
    for links, most in ((chain.limit(0), 1), (chain, 2)):
        saved.clear()
        found = {r.fingerprint: r.component for r in components.smallest_reachable(nodes, links).collect()}
        assert found == {k: k if most == 1 else 0 for k in range(200)}
        assert len(saved) <= most


def test_visits_cover_all_changes_once():
    moves = set(visits(4))
    assert not any(tuple(-x for x in m) in moves for m in moves)
    assert {(0, 0, 1, 1), (0, 0, 0, 2), (0, 1, 0, -1)} <= moves
    assert parts_for(10) == 1 < parts_for(10**6) <= parts_for(10**10) == 16 or parts_for(10**10) == 8


def test_fingerprint_of_short_and_odd_texts():
    assert fingerprint("") == fingerprint(" \n\t") == 0
    assert fingerprint("A b") == fingerprint("a\u0009B ") != fingerprint("É b")
    assert fingerprint("É b") != fingerprint("é b")  # only A-Z is lowered
    assert fingerprint("a b c") == fingerprint("A B  C")


def test_cases(spark):
    rows = [(5, None, 1, "x"), (3, "", 1, "x"), (7, "one two three four", 1, "x"), (7, "one two three four", 1, "x"),
            (9, "One  two three FOUR", 1, "x"), (None, "one two three four", 1, "x"), (11, "w " * 50_000, 1, "x")]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in found) == [
        (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 7, 7), (False, 9, 7), (False, 11, 11), (True, 0, 7)]
    assert {r.fingerprint for r in found if r.doc_id in (3, 5)} == {"0" * 16}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_pairs_at_a_wide_radius(spark):
    rnd = random.Random(9)
    values = [rnd.getrandbits(64) for _ in range(300)]
    for value in values[:100]:
        values += [value ^ sum(1 << k for k in rnd.sample(range(64), n)) for n in (3, 8)]
    values += [values[0]] * 200  # more equal ones than a window has
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = {(r.a, r.b) for r in near_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, fingerprint long"), 14).collect()}
    assert all(a < b and (values[a] ^ values[b]).bit_count() <= 14 for a, b in found)
    assert {b for a, b in found if values[a] == values[b] == values[0]} == set(range(500, 700))
    near = {(a, b) for a in range(100) for b in (300 + 2 * a, 301 + 2 * a)}
    touched = {x for pair in found for x in pair}
    assert sum(b in touched for _, b in near) >= 190
    assert near_pairs(spark.createDataFrame([], "id long, fingerprint long"), 14).count() == 0


def test_fingerprint_of_hashes():
    hashes = np.array([5, 7, 2**63 + 1], np.uint64)
    assert fingerprint_of(hashes) == 5 and fingerprint_of(hashes[:0]) == 0 and fingerprint_of(hashes[2:]) == 2**63 + 1
