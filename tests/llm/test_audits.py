"""Rule ledger, cross-tokenizer alignment and filter interactions against plain loops."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from afluente.llm import crosstokens, interactions, ledger
from afluente.llm.common import text_bytes

BLANKS = b" \t\n\x0b\x0c\r"
VOCABULARIES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
# columns of the user that have names the operators use themselves
CLASH = "doc_id long, text string, source string, n string, mask string, row string, pair string, failed string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "n", "m", "r", "p", "f", "q") for d, t, s in rows], CLASH)


def messy(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "bb", "Ccc", "dé", "É", "😀x", "#", "x&y", "|", "the", "The", " z", " ", "naïve", "2024", "ABC", "<s>", "<|endoftext|>"]
    blanks = [" ", " ", " ", "\n", "  ", "\t", "\r\n", "\x0b", "\x0c"]
    rows = []
    for k in range(n):
        size = rnd.choice([0, 1, 4, 5, 9, 10, 12, 40, 260])
        pool = rnd.sample(words, rnd.randint(1, len(words)))
        rows.append((k, "".join(rnd.choice(pool) + rnd.choice(blanks) for _ in range(size)), rnd.choice(["s1", "s2", "s3", None])))
    rows += [(200, None, "s1"), (201, "", None), (202, " \n ", "s4"), (203, "long word " * 30_000, "s1"), (204, "z" * 300_000, "s2")]
    rows += [(205, rows[7][1], "s2"), (206, rows[7][1], "s1"), (8, rows[8][1], "s3"), (8, rows[8][1], "s1"), (None, rows[9][1], "s1"), (None, "one two", None)]
    return rows


def words_of(text):
    return (text or "").encode().split()  # bytes split at the six blanks of the contract


def repeated(words):
    places = defaultdict(list)
    for k in range(len(words) - 4):
        places[tuple(words[k : k + 5])].append(k)
    return len({k + i for found in places.values() if len(found) > 1 for k in found for i in range(5)})


def measures(text):
    text, words = text or "", words_of(text)
    lines = [line for line in text.encode().split(b"\n") if line.strip(BLANKS)]
    return {
        "n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated(words), "n_chars": len(text),
        "n_capitals": sum("A" <= c <= "Z" for c in text), "n_lines": len(lines), "n_distinct_words": len(set(words)),
    }


def broken(m):
    return [
        m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
        100 * m["n_capitals"] > 40 * m["word_chars"], m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 20 * m["n_words"],
        m["n_lines"] >= 5 and 100 * m["n_dup_lines"] > 30 * m["n_lines"], m["n_words"] >= 50 and 100 * m["n_distinct_words"] < 15 * m["n_words"],
    ]


def key(values):
    return sorted(values, key=str)


def test_ledger_against_plain_loops(spark):
    rows = messy(1)
    kept = ledger.ledger(frame(spark, rows))
    found = key((r.doc_id, tuple(r[m] for m in ledger.MEASURES), r.failed) for r in kept.collect())
    want = []
    for d, t, _ in rows:
        m = measures(t)
        want.append((d, tuple(m[n] for n in ledger.MEASURES), sum(1 << k for k, b in enumerate(broken(m)) if b)))
    assert found == key(want)
    assert len({w[2] for w in want}) > 5
    assert ledger.ledger(frame(spark, [])).count() == 0


def test_policies_and_ablations(spark):
    rows = messy(2)
    book = ledger.ledger(frame(spark, rows)).cache()
    policies = (ledger.BASE, ledger.STANDARD, ledger.Policy("none", ()))
    judged = ledger.apply_policies(book, policies).collect()
    fails = [broken(measures(t)) for _, t, _ in rows]
    names = [r.name for r in ledger.RULES]
    for policy in policies:
        own = [names.index(n) for n in policy.rules]
        assert sum(r[f"kept_{policy.version}"] for r in judged) == sum(not any(f[k] for k in own) for f in fails)
        found = {r.rule: (r.n_failed, r.n_only, r.kept, r.kept_without) for r in ledger.ablations(book, (policy,)).collect()}
        assert found == {
            names[k]: (
                sum(f[k] for f in fails),
                sum(f[k] and not any(f[j] for j in own if j != k) for f in fails),
                sum(not any(f[j] for j in own) for f in fails),
                sum(not any(f[j] for j in own if j != k) for f in fails),
            )
            for k in own
        }
    assert ledger.ablations(book.limit(0)).count() == 0
    left = ledger.without_failing(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    assert key(tuple(r)[:3] for r in left.collect()) == key(r for r, f in zip(rows, fails) if not any(f))


def test_ledgers_of_other_rules_are_refused(spark):
    book = ledger.ledger(frame(spark, messy(3, 5)), (ledger.Rule("few_words", "n_words < 3"),))
    with pytest.raises(Exception, match="the ledger is not one of rules"):
        ledger.apply_policies(book).collect()
    with pytest.raises(ValueError, match="unknown rules"):
        ledger.mask_of(ledger.Policy("x", ("nothing",)))


def audit(rows, labels):
    """All counts by walking every document through every order."""
    smallest, fails = defaultdict(list), []
    for d, t, _ in rows:
        smallest[t or ""].append(-1 if d is None else d)
    for d, t, _ in rows:
        text, words = t or "", words_of(t)
        fails.append(
            (len(words) < 200) * "A" + (100 * len(set(words)) < 50 * len(words)) * "B" + (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) * "C"
            + any(c in "#$%&*|" for c in text) * "D" + ((-1 if d is None else d) > min(smallest[text])) * "E"
        )
    out, removed_ever = defaultdict(Counter), Counter()
    parts = {s or "" for _, _, s in rows}
    for order in map("".join, permutations("ABCDE")):
        for (d, _, s), bad in zip(rows, fails):
            part, gone = s or "", False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                if f in bad and not gone:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += labels.get(d, (0, 0))[0]
                    row["toxic_lost"] += labels.get(d, (0, 0))[1]
                    removed_ever[part, f] += 1
                elif f in bad:
                    row["redundant"] += 1
                row["kept"] += not gone
                row["unique_fails"] += bad == f
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted(
        (p, o, s, *(out[p, o, s][n] for n in names), removed_ever[p, o[s - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)
    )


def test_filter_audit_against_plain_loops(spark):
    rows = messy(4)
    labels = [(d, int(d % 3 == 0), int(d % 7 == 0), "x") for d in range(0, 210, 2)] + [(4, 1, 1, "y"), (6, None, None, "z"), (None, 1, 1, "w")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")
    known = {}
    for d, q, t, _ in labels:
        if d is not None:
            known[d] = tuple(max(a, b or 0) for a, b in zip(known.get(d, (0, 0)), (q, t)))
    found = sorted(tuple(r) for r in interactions.audit_filters(frame(spark, rows), table).collect())
    assert found == audit(rows, known)
    assert interactions.audit_filters(frame(spark, []), table).count() == 0
    assert interactions.audit_filters(frame(spark, rows[:3]), table.limit(0)).count() == 600 * len({r[2] for r in rows[:3]})


def test_words_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(interactions.SpanTable, "_hashes", staticmethod(lambda data, starts, ends: np.zeros(len(starts), np.uint64)))
    texts = ["aa ab aa abcdefghij abcdefghik abcdefghij", "", "ab", "x y x", " "]
    data, bounds = text_bytes(pa.array(texts))
    counts, starts, ends = interactions.transduce(data, bounds)
    owners = np.repeat(np.arange(len(texts)), counts["words"])
    assert interactions.SpanTable(data, starts, ends).distinct(owners, len(texts)).tolist() == [len(set(t.split())) for t in texts]


def test_runs_and_groups_of_random_ends():
    rnd = random.Random(5)
    for _ in range(300):
        last = rnd.choice([1, 2, 5, 40, 400])
        share = rnd.choice([0.2, 0.9, 1.0])
        common = [p for p in range(1, last) if rnd.random() < share]
        sides = [sorted({*common, last, *(p for p in range(1, last) if rnd.random() < rnd.choice([0, 0.02, 0.3]))}) for _ in range(2)]
        a, b = (np.array(s, np.int64) for s in sides)
        ends_a, ends_b, link_a, link_b = crosstokens.align(a, b)
        both = sorted(set(sides[0]) & set(sides[1]))
        assert a[ends_a - 1].tolist() == b[ends_b - 1].tolist() == both
        spans = [list(zip([0, *s], s)) for s in sides]
        want = {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e}
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == sorted(want)
    assert [len(x) for x in crosstokens.align(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0] * 4


def alignment(rows):
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(VOCABULARIES[0]), crosstokens.load(VOCABULARIES[1])
    left.encode_special_tokens = True
    table = [crosstokens.byte_tokens(crosstokens.SpacedEncoder(VOCABULARIES[0])), crosstokens.piece_tokens(right)]
    raw = [[bytes(t.pool[s : s + n]) for s, n in zip(t.starts, t.sizes)] for t in table]
    out, documents = [], Counter()
    for d, t, _ in rows:
        text = t or ""
        ids = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
        if not text or any(b"".join(raw[k][i] for i in ids[k]) != (" " + text).encode() for k in (0, 1)):
            out.append((d, [], [], [], []))
            continue
        ends = [np.cumsum([len(raw[k][i]) for i in ids[k]]).tolist() for k in (0, 1)]
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = bisect_left(ends[0], e) + 1, bisect_left(ends[1], e) + 1
            groups.append(f"{','.join(map(str, ids[0][i:p]))}|{','.join(map(str, ids[1][j:q]))}")
            i, j = p, q
        for e in sorted({*ends[0], *ends[1]}):  # each piece between two ends lies in one token of either side
            links.append((ids[0][bisect_left(ends[0], e)], ids[1][bisect_left(ends[1], e)]))
        documents.update(set(links))
        out.append((d, ids[0], ids[1], groups, links))
    best = defaultdict(int)
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    for d, a, b, groups, links in out:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield d, len(a), len(b), len(groups), len(links), sum(documents[x] == best[x[0]] for x in links), sum(documents[x] for x in links), digest


@pytest.mark.parametrize("broadcast_pairs", [crosstokens.BROADCAST_PAIRS, 40])
def test_alignment_against_plain_loops(spark, broadcast_pairs):
    rows = [r for r in messy(6, 60) if r[0] not in (203, 204)] + [(300, "▁odd", "s"), (301, "  two  spaces ", "s"), (302, "\x00nul \x01", "s"), (303, "word " * 3000, "s")]
    found = crosstokens.score_links(frame(spark, rows), *VOCABULARIES, broadcast_pairs=broadcast_pairs)
    assert key(tuple(r) for r in found.collect()) == key(alignment(rows))
    assert crosstokens.score_links(frame(spark, []), *VOCABULARIES).count() == 0


def test_alignment_of_the_sample_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in documents.select("doc_id", "text").collect()]
    found = crosstokens.score_links(documents, *VOCABULARIES)
    assert key(tuple(r) for r in found.collect()) == key(alignment(rows))
    assert found.agg(F.sum("n_links")).first()[0] > 10_000


def test_aligner_stays_with_the_worker():
    texts = pa.array(["one two three", "", "one  two\nthree é"])
    first = crosstokens.worker_aligner(*VOCABULARIES)
    before = first.rows(texts)
    assert crosstokens.worker_aligner(*VOCABULARIES) is first
    assert all(before[k].equals(v) for k, v in first.rows(texts).items())
