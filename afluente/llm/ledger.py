"""Quality rules: every rule judged once per document, its failure a bit in a ledger; policies and ablations from the bits."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from afluente.functions.columns import free_name
from afluente.functions.text import named
from afluente.llm.common import slices, small_batches, text_bytes, texts_of

WINDOW = 5  # words of a passage that counts as repeated
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_capitals", "n_lines", "n_distinct_words",
)

_BLANKS = b" \t\n\x0b\x0c\r"
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(_BLANKS)] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """A rule fails a document for which ``fails``, a condition on the measures, holds. Its bit is its place in the list."""

    name: str
    fails: str


# The first two are the base; the others are common limits for running text; shares need a few lines or words to mean anything.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_passages", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("duplicate_lines", "n_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("few_distinct_words", "n_words >= 50 AND 100 * n_distinct_words < 15 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of which rules remove a document."""

    version: str
    rules: tuple[str, ...]


BASE = Policy("base", ("few_words", "repeated_passages"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def rules_id(rules: tuple[Rule, ...]) -> str:
    """Short name of a list of rules; bits of ledgers with different names must not be compared."""
    return hashlib.sha256("\n".join(f"{r.name}: {r.fails}" for r in rules).encode()).hexdigest()[:16]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    kinds, ranks = np.unique(keys, return_inverse=True)
    return ranks.astype(np.int64), len(kinds)


def repeated_words(words: np.ndarray, owners: np.ndarray, n_owners: int) -> np.ndarray:
    """Words of each owner that lie in a window of five which the owner has twice or more; words are given as numbers.

    Windows get exact numbers by doubling: pairs, pairs of pairs, and one word more.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(n_owners, np.int64)
    pairs, n_pairs = _ranks(words[:-1] * (int(words.max()) + 1) + words[1:])
    fours, _ = _ranks(pairs[:-2] * n_pairs + pairs[2:])
    fives, n_fives = _ranks(fours[:n] * (int(words.max()) + 1) + words[WINDOW - 1 :])
    inside = np.flatnonzero(owners[:n] == owners[WINDOW - 1 :])
    _, place, times = np.unique(owners[inside] * n_fives + fives[inside], return_inverse=True, return_counts=True)
    first = inside[times[place] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + WINDOW, -1)
    return np.bincount(owners[np.cumsum(edges)[:-1] > 0], minlength=n_owners)


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def _measures(texts: pa.Array) -> dict[str, np.ndarray]:
    data, bounds = text_bytes(texts)
    n = len(bounds) - 1

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[bounds])

    points, blank = (data & 0xC0) != 0x80, _IS_BLANK[data]
    whole = [bytes(data[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    parts = [t.split() for t in whole]  # for bytes these are just the blanks of the contract
    counts = np.array([len(p) for p in parts], np.int64)
    words = [w for p in parts for w in p]
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    numbers = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    owners = np.repeat(np.arange(n), counts)
    lines = np.array([_duplicate_lines(t) for t in whole], np.int64).reshape(-1, 2)
    return {
        "n_words": counts,
        "word_chars": per_text(points & ~blank),
        "n_symbols": per_text(_IS_SYMBOL[data]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated_words(numbers, owners, n),
        "n_chars": per_text(points),
        "n_capitals": per_text((data >= ord("A")) & (data <= ord("Z"))),
        "n_lines": lines[:, 0],
        "n_distinct_words": np.bincount(np.unique(owners * max(len(index), 1) + numbers) // max(len(index), 1), minlength=n),
    }


def ledger(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measures, ``failed`` (a bit per rule) and ``rules`` (the list's name), one row per row of the table.

    Each text is read once and each rule judged once; save the result, and policies and ablations need no text any more.
    Null texts have no words; texts of any length are taken whole, about 4 MB at once; repeated rows each give a row; an
    empty table gives an empty ledger; columns other than ``doc_id`` and ``text`` are ignored.
    """
    if len(rules) > 62:
        raise ValueError("a ledger holds 62 rules at most")
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in slices(batches):
            found = _measures(batch.column("text"))
            made = [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *MEASURES])

    measured = texts_of(documents).mapInArrow(run, f"doc_id long, {', '.join(f'{m} long' for m in MEASURES)}")
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    failed = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
    return measured.select("*", failed.alias("failed"), F.lit(rules_id(rules)).alias("rules"))


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    places = {r.name: k for k, r in enumerate(rules)}
    unknown = [name for name in policy.rules if name not in places]
    if unknown:
        raise ValueError(f"policy {policy.version} has unknown rules: {unknown}")
    return sum({1 << places[name] for name in policy.rules})


def _bits_of(ledger_rows: DataFrame, rules: tuple[Rule, ...]) -> Column:
    """The failure bits; a ledger of other rules is an error when its rows are read."""
    known = rules_id(rules)
    return F.when(F.col("rules") == known, F.col("failed")).otherwise(F.raise_error(F.lit(f"the ledger is not one of rules {known}")))


def fails_policy(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of a ledger breaks any rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) != 0


def apply_policies(ledger_rows: DataFrame, policies: tuple[Policy, ...] = (BASE, STANDARD), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a column ``kept_<version>`` for each policy, and all its own columns.

    A column of the ledger that has such a name already keeps it; the new one then gets an underscore behind it.
    """
    checked = ledger_rows.withColumn("failed", _bits_of(ledger_rows, rules))
    for policy in policies:
        checked = checked.withColumn(free_name(f"kept_{policy.version}", checked.columns), ~fails_policy(policy, rules))
    return checked


def ablations(ledger_rows: DataFrame, policies: tuple[Policy, ...] = (STANDARD,), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule does within each policy: ``version``, ``rule``, ``n_failed``, ``n_only`` (removed by it alone), ``kept``
    (by the whole policy) and ``kept_without`` the rule.

    Documents are first counted by their bits, so what follows has at most one row for each set of bits met, whatever the
    size of the ledger. A policy without rules, or an empty ledger, gives no row.
    """
    checked = ledger_rows.select(_bits_of(ledger_rows, rules).alias("bits"))
    counted = checked.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    places = {r.name: k for k, r in enumerate(rules)}
    cases = [
        F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(1 << places[name]).cast("long").alias("own"),
                 F.lit(mask_of(p, rules)).cast("long").alias("mask"))
        for p in policies for name in dict.fromkeys(p.rules)
    ]
    if not cases:
        return ledger_rows.sparkSession.createDataFrame([], "version string, rule string, n_failed long, n_only long, kept long, kept_without long")
    each = counted.select("bits", "n", F.inline(F.array(*cases)))
    hit = F.col("bits").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy("version", "rule").agg(
        total(F.col("bits").bitwiseAND(F.col("own")) != 0).alias("n_failed"),
        total(hit == F.col("own")).alias("n_only"),
        total(hit == 0).alias("kept"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("own"))) == 0).alias("kept_without"),
    )


def without_failing(documents: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``documents``, all columns kept, that break no rule of the policy; judged row by row, in one pass."""
    small_batches(documents.sparkSession)
    wanted = mask_of(policy, rules)
    columns = documents.columns
    rows = documents.select(
        F.struct(*(named(c).alias(c) for c in columns)).alias("row"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text")
    )
    schema = f"row {dict(rows.dtypes)['row']}, {', '.join(f'{m} long' for m in MEASURES)}"

    def run(batches):
        for batch in slices(batches):
            found = _measures(batch.column("text"))
            made = [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", *MEASURES])

    passes = reduce(lambda a, b: a & b, [~F.expr(r.fails) for k, r in enumerate(rules) if wanted >> k & 1], F.lit(True))
    kept = rows.mapInArrow(run, schema).where(passes)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])
