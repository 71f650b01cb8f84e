"""Corpus pipeline: stages against plain loops, with null and repeated ids."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from afluente.llm import decontaminate, quality, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], SCHEMA)


def _shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _groups(texts):
    sets, top = [_shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        return k if top[k] == k else root(top[k])

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            top[root(a)] = root(b)
    return [root(k) for k in range(len(texts))]


def _rows():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(None, None), (None, ""), (3, "One two"), (None, "one TWO"), (4, "one two three")]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 40, 150]))]
        for _ in range(rnd.randint(1, 6)):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((rnd.choice([None, 7, 8, rnd.randrange(100, 999)]), " ".join(text)))
    return rows + rows[20:30]


def test_near_duplicates_at_similarity(spark):
    rows = _rows()
    found = corpus_pipeline.near_duplicate_stage(spark, _frame(spark, rows), "").collect()
    groups = _groups([t for _, t in rows])
    number = {t: g for (_, t), g in zip(rows, groups)}
    assert len(found) == len(set(groups)) < len(rows) - 20
    order = lambda d: (d is None, d or 0)
    least = {g: min(order(d) for (d, _), h in zip(rows, groups) if h == g) for g in groups}
    assert {number[r.text]: order(r.doc_id) for r in found} == least
    assert corpus_pipeline.near_duplicate_stage(spark, _frame(spark, []), "").count() == 0


def test_pairs_that_hubs_miss(spark):
    # A chain in which far ends are not near each other, so some pairs have no hub in common.
    words = [f"v{k}" for k in range(160)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 60])) for k in range(24)]
    assert len(set(_groups([t for _, t in rows]))) == 1
    assert [r.doc_id for r in similar.without_near_duplicates(_frame(spark, rows)).collect()] == [0]


def test_rows_are_judged_one_by_one(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(None, f"a {item} b"), (None, "clean one"), (None, None), (5, f"x {item}"), (5, "clean two"), (6, ""), (6, "clean two")]
    items = spark.createDataFrame([(1, item), (2, "another passage that no document has in it")], "item_id long, text string")
    for block_chars in (10, 1 << 20):
        found = decontaminate.without_contamination(_frame(spark, rows), items, block_chars=block_chars)
        assert found.columns == _frame(spark, rows).columns
        assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(r for r in rows if item not in (r[1] or ""))


def test_stages_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(d, t) for d, t in _rows()] + [(None, f"{item} {k} {k * k} tail") for k in range(3)] + [(7, f"start {item}")]
    _frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(quality, "keep_good", lambda docs, model: docs)  # what the classifier keeps is not the matter here
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    groups = _groups([t for _, t in rows])
    want = {}
    for (d, t), g in zip(rows, groups):
        want[g] = min(want.get(g, (True, 0)), (d is None, d or 0))
    dirty = {g for (_, t), g in zip(rows, groups) if item in (t or "")}
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in found) == Counter(v for g, v in want.items() if g not in dirty)


def test_near_fingerprints_lead_to_the_groups(spark, monkeypatch):
    # Without the prefix filter, the stage has what the fingerprints find: here all the groups.
    assert dict(corpus_pipeline.STAGES)["simhash near-dedup"] is corpus_pipeline.near_duplicate_stage
    rnd = random.Random(6)
    rows = []
    for k in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(300)]
        rows.append((2 * k, " ".join(base)))
        base[rnd.randrange(300)] = "other"
        rows.append((2 * k + 1, " ".join(base)))
    monkeypatch.setattr(similar, "_hub_pairs", lambda shared: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(similar, "_other_pairs", lambda shared, marks, groups: spark.createDataFrame([], "a long, b long"))
    found = corpus_pipeline.near_duplicate_stage(spark, _frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in found) == list(range(0, 60, 2))


def test_sketches_of_any_size_tell_chance_pairs():
    rnd = np.random.default_rng(8)
    for size in (1, 5, 60, 700, 20_000):
        some, far = (np.unique(rnd.integers(0, 2**63, size).astype(np.uint64)) for _ in range(2))
        near = np.sort(np.concatenate([some[: -(-9 * size // 10)], far[: size // 20]]))
        sets = [some, near, far]
        marks = similar._Sketches(pa.array([similar.sketch(h) for h in sets], pa.binary()))
        for a, b in itertools.product(range(3), repeat=2):
            apart = int(marks.apart(np.array([a]), marks, np.array([b]))[0])
            assert apart <= len(np.setxor1d(sets[a], sets[b]))
            likely = similar._near_sketches(len(sets[a]) + len(sets[b]), apart)
            assert likely == (a == b or 2 not in (a, b)), (size, a, b)


def test_chance_pairs_are_dropped_before_any_join(spark, monkeypatch):
    # Different texts of few common phrases share shingles of their prefixes, and fingerprints are near by chance.
    rnd = random.Random(11)
    phrases = [" ".join(f"p{rnd.randrange(500)}" for _ in range(8)) for _ in range(150)]
    rows = [(k, " ".join(rnd.choice(phrases) for _ in range(25))) for k in range(300)]
    rows += [(1000 + k, f"{t} end") for k, t in rows[:40]]
    tried = []
    plain = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or plain(pairs, *rest))
    found = similar.without_near_duplicates(_frame(spark, rows)).collect()
    assert len(found) == len(set(_groups([t for _, t in rows]))) == 300
    assert sum(tried) <= 80


def test_all_pairs_of_large_and_small_shingles(spark):
    rnd = random.Random(12)
    rows, sets = [], {}
    for k in range(200):
        own, size = k + 1, rnd.choice([100, 120, 400])
        sets[own] = np.unique(np.array([rnd.randrange(2**40) for _ in range(size)], np.uint64))
        rows += [(1, own, size), (2 + k // 5, own, size)]  # one shingle in all, others in five each
    marks = spark.createDataFrame([(i, similar.sketch(h)) for i, h in sets.items()], "id long, sketch binary")
    groups = spark.createDataFrame([(i, i % 190) for i in sets], "id long, low long")
    shared = spark.createDataFrame(rows, "shingle long, id long, size long")
    sets_of = spark.createDataFrame([(i, similar.sketch(sets[1])) for i in sets], "id long, sketch binary")
    sizes = {i: s for _, i, s in rows}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if a % 190 != b % 190 and 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])}
    assert {(r.a, r.b) for r in similar._other_pairs(shared, sets_of, groups).collect()} == want
    hubs = similar._hub_pairs(similar._mixed(shared, sets_of, groups)).collect()
    assert {(r.a, r.b) for r in hubs} < want and len(hubs) <= 3 * len(rows)
    assert similar._other_pairs(shared, marks, groups).count() == 0


def test_exact_search_finds_all_groups_from_tables_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(similar, "near_pairs", lambda *args: spark.createDataFrame([], "a long, b long"))
    rows = _rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as in large tables, no exchange ends in one task
    try:
        found = corpus_pipeline.near_duplicate_stage(spark, _frame(spark, rows), "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = _groups([t for _, t in rows])
    number = {t: g for (_, t), g in zip(rows, groups)}
    assert Counter(number[r.text] for r in found) == Counter(set(groups))
