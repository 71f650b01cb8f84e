"""Decontamination, repeated strings, personal data, quality, chat and digests: small cases against plain loops."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from afluente.llm import chat, decontaminate, digest, pii, quality, suffixes

SCHEMA = "doc_id long, text string, n_bytes string, part string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA)


def test_myers_distance_and_found_items(spark):
    rnd = random.Random(1)
    item = decontaminate.Item(1, "".join(rnd.choice("abc ") for _ in range(40)), 4)
    for _ in range(100):
        window = "".join(rnd.choice("abc ") for _ in range(60))
        row = [0] * (len(window) + 1)
        for c in item.text:
            old, row = row, [row[0] + 1]
            for k, w in enumerate(window):
                row.append(min(old[k] + (c != w), old[k + 1] + 1, row[-1] + 1))
        assert item.distance(window)[0] == min(row)
    text = "The quick brown fox jumps over the lazy dog near the river bank today"
    edited = text.replace("quick", "quikc").replace("lazy ", "lazy")
    rows = [(1, "x " * 400 + text.upper() + " y" * 400), (2, edited), (3, "nothing here"), (4, None), (5, ""), (None, text), (7, text), (7, text)]
    items = spark.createDataFrame([(10, text), (11, "   "), (12, None), (13, text)], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, rows), items, block_chars=10).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == sorted((d, i) for d in (0, 1, 2, 7, 7) for i in (10, 13))
    assert {r.distance for r in found if r.doc_id == 2} == {3}
    assert sorted(r.doc_id for r in decontaminate.without_contamination(frame(spark, rows), items).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(frame(spark, []), items).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_repeated_strings(spark, monkeypatch, small):
    if small:  # many groups, buckets and targets
        for name, value in (("GROUP_BYTES", 1 << 10), ("BUCKET_BYTES", 1 << 11), ("TARGET_BYTES", 1 << 10), ("BLOCK_BYTES", 1 << 11)):
            monkeypatch.setattr(suffixes, name, value)
    rnd = random.Random(2)
    pool = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(20, 150))) for _ in range(6)]
    rows = [(k, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 5)))) for k in range(40)]
    rows += [(100, None), (101, "z" * 3000), (None, pool[0] * 2), (5, rows[5][1]), (5, pool[1] * 3)]
    order = lambda d: -1 if d is None else d
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], 10**9), order(d))
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < order(d):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want.append((order(d), len(raw), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), kept))
    found = suffixes.remove_repeats(frame(spark, rows)).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(want)
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("signs", [1, 2, 26, 256])
def test_transform_of_a_group(signs):
    import tracemalloc

    rnd = np.random.default_rng(signs)
    pool = rnd.integers(256 - signs, 256, 1 << 13).astype(np.uint8)
    sizes = rnd.integers(0, 90, 1500)
    sizes[:4] = 0, 49, 50, 400
    data = np.concatenate([pool[k : k + n] for k, n in zip(rnd.integers(0, len(pool) - 400, len(sizes)), sizes)])
    docs = rnd.integers(0, 300, len(sizes)) + suffixes.NOBODY
    places = [(e - n, e, d) for e, n, d in zip(np.cumsum(sizes).tolist(), sizes.tolist(), docs.tolist())]
    raw, first = data.tobytes(), {}
    for start, end, doc in places:
        for p in range(start, end - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], doc), doc)
    want = [p for start, end, doc in places for p in range(start, end - 49) if first[raw[p : p + 50]] < doc]
    tracemalloc.start()
    found = suffixes.repeated_windows(data, sizes, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.flatnonzero(found).tolist() == want
    assert peak < 80 * len(data)
    assert not suffixes.repeated_windows(data[:30], np.array([30]), docs[:1]).any()


def test_anchors_of_a_block_need_little_memory():
    import tracemalloc

    data = np.random.default_rng(5).integers(97, 101, suffixes.BLOCK_BYTES).astype(np.uint8)
    tracemalloc.start()
    anchor, pair, hashed = suffixes.anchors(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(data)  # 24 are returned
    for start in (0, suffixes.CHUNK - 60, len(data) - 300):  # the same as those of a small piece, over bounds of chunks too
        some = slice(start, start + 251)
        own = suffixes.anchors(data[start : start + 300])
        assert (own[0] + start == anchor[some]).all() and (own[1] == pair[some]).all()
        assert (own[2] == hashed[start : start + len(own[2])]).all()


def test_long_texts_of_personal_data_take_time_in_proportion(spark):
    model = pii.train(frame(spark, [(k, f"call +1 {5550000000 + k} now or a{k}@b.co") for k in range(200)]))
    times = []
    for n in (2000, 16_000):
        started = time.perf_counter()
        found = pii.find_pii(frame(spark, [(1, "call 555-123-4567 x a@b.co " * n)]), model).select(F.size("base").alias("n"), F.size("spans").alias("m")).first()
        times.append(time.perf_counter() - started)
        assert found.n == n and found.m >= n
    assert times[1] < 30


def test_labels_that_contradict_each_other(spark):
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    known = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    odd = known + [(d, 1 - q) for d, q in known[::3]] + known[1::3]
    rnd, models = random.Random(4), []
    for rows in (odd, odd[::-1], rnd.sample(odd, len(odd)), [k for n, k in enumerate(known) if n % 3]):
        models.append(quality.train(documents, spark.createDataFrame(rows, "doc_id long, quality int")))
    assert len({m.offset for m in models}) == 1 and all((m.weights == models[0].weights).all() for m in models)
    again = quality.train(documents.unionAll(documents), spark.createDataFrame(odd, "doc_id long, quality int"))
    assert again.offset == models[0].offset


def test_personal_data(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def counts(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    rnd = random.Random(3)
    parts = ["a", "b.", "@", "1", "22", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.1", "255.256.1.1", " ", "-", ".", "\n", "é",
             "x@y.co_z@w.de", "+", "(", "😀", "378282246310005", "john (at) mail.com"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for k in range(150)]
    rows += [(900, "1" * 50_000), (901, "a" * 50_000), (902, "x@y.co " * 2000), (903, None), (904, ""), (None, "a@b.c"), (1, rows[1][1])]
    table = frame(spark, rows)
    model = pii.train(table)
    found = pii.find_pii(table, model).select("doc_id", *(f"n_{k}" for k in pii.KINDS), pii.spans_as_text("base").alias("base"), "base.s", "spans")
    want = []
    for d, t in rows:
        spans = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(plain.items()) for m in re.finditer(p, t or "") if counts(k, m[0]))
        want.append((-1 if d is None else d, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)))
    got = found.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.base) for r in got) == sorted(want)
    assert all(len(r.spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    assert pii.find_pii(frame(spark, []), pii.train(frame(spark, []))).count() == 0


def test_personal_data_in_wide_forms(spark):
    rnd = random.Random(6)
    digits = lambda n: "".join(rnd.choice("23456789") for _ in range(n))
    rows = []
    for k in range(400):
        forms = [f"mail me: john{k} (at) host{k}.com now", f"write to ann{k}[at]site(dot)org now", f"phone {digits(3)} {digits(3)} {digits(4)} now",
                 f"mail bob{k}@host.de now", "paid 4111.1111.1111.1111 now", f"call +1 {digits(10)} now", f"lot {digits(12)} sold", f"item {digits(5)}-{digits(6)} sold",
                 f"list {digits(3)},{digits(3)},{digits(3)},{digits(3)} end", "meet @ home . Then go"]
        rows.append((k, forms[k % len(forms)]))
    table = frame(spark, rows)
    found = {r.doc_id: r for r in pii.find_pii(table, pii.train(table)).collect()}
    for k, text in rows:
        form, got = k % 10, [(pii.KINDS[x.k], text[x.s : x.e]) for x in found[k].spans]
        if form < 6:
            kind = {2: "phone", 4: "card", 5: "phone"}.get(form, "email")
            assert [g[0] for g in got] == [kind] and len(got[0][1]) > 9, (text, got)
            assert len(found[k].base) == (form in (3, 5))
        elif form > 7:
            assert not got, (text, got)


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(documents, labels)
    scored = quality.score_quality(documents, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(scored) > 50 and np.mean([r.predicted == r.quality for r in scored]) > 0.95
    odd = [(1, None), (2, ""), (3, "word " * 100_000), (None, "x"), (3, "again")]
    rows = quality.score_quality(frame(spark, odd), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(frame(spark, odd), model).columns == frame(spark, odd).columns
    assert quality.score_quality(frame(spark, []), model).count() == 0
    assert quality.train(frame(spark, []), labels).offset == 0.0


def test_chat(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <\\|x"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, "assistant", ""),
            (None, None, None, "x"), (4, 0, "us\ner\\", "a"), (4, 0, "us\ner\\", "a")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, place string")
    found = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(table)).collect()}
    for conv in (1, 2, 3, None, 4):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[1].n_invalid == found[2].n_invalid == 0 < found[3].n_invalid
    assert chat.read_conversations(chat.format_conversations(table.limit(0))).count() == 0


def test_digests(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghij klmno") for _ in range(n))
    rows = [(1, text(5000)), (2, text(300)), (3, None), (4, ""), (9, text(40)), (7, text(5000)), (8, "é" * 200), (None, text(100)), (11, rows_long := text(90_000))]
    rows.append((12, rows_long))
    found = {r.doc_id: r for r in digest.fingerprint_documents(frame(spark, rows), partitions=4).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (d, t) in enumerate(ordered):
        own, follower = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(own) // 2
        assert found[d].n_chars == len(own)
        assert found[d].edited_sha256 == hashlib.sha256((own[: len(own) - half] + follower[:half]).encode()).hexdigest()
        assert 0 <= found[d].near_edited <= 1 and 0 <= found[d].near_next <= 1
    assert found[11].fingerprint == found[12].fingerprint and found[11].near_next == 1 and found[3].near_next == 1
    assert found[1].near_edited > found[1].near_next
    assert digest.fingerprint_documents(frame(spark, [])).count() == 0
    assert digest.fingerprint_documents(frame(spark, [(1, "only one")])).collect()[0].near_next == 1
