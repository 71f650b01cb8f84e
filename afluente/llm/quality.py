"""Quality classifier: averaged vectors of hashed words and character n-grams, trained by stochastic gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente.llm.common import slices, small_batches, spans, texts_of

BUCKETS = 1 << 17
DIMENSIONS = 12
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 0.5
SEED = 7
THRESHOLD = 0.3
TRAIN_DOCUMENTS = 2000  # labelled documents trained on at most, the smallest hashed ids
TRAIN_CHARS = 8_000_000  # and their characters together; a document that no longer fits is passed over
END, AGAIN = 0, 1  # buckets of the end of a text and of a word that repeats the one before
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ hashes >> np.uint64(31)
    return (hashes * _PRIME >> np.uint64(40)) % np.uint64(BUCKETS - 2) + np.uint64(2)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its n-grams with ``<`` and ``>`` around, and how many each word has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    joined = "<" + "><".join(words) + ">" if words else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _PRIME, np.uint64))
    places = np.arange(len(points)) - starts[owner]
    whole = np.add.reduceat(points * powers[places], starts) if len(words) else np.zeros(0, np.uint64)
    found, owners = [_bucket(whole)], [np.arange(len(words))]
    for n in GRAMS:
        if len(points) < n:
            continue
        rolled = np.zeros(len(points) - n + 1, np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(1_000_003) + points[k : len(points) - n + 1 + k]
        inside = places[: len(rolled)] + n <= sizes[owner[: len(rolled)]]
        found.append(_bucket(rolled[inside] + np.uint64(n)))
        owners.append(owner[: len(rolled)][inside])
    owners, found = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(words))


class WordTable:
    """Features of recurring words, worked out once; emptied beyond ``limit`` words."""

    def __init__(self, weights: np.ndarray | None = None, limit: int = 400_000) -> None:
        self.weights, self.limit = weights, limit
        self.index: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.counts, self.sums = np.zeros(0, np.int64), np.zeros(0)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.__init__(self.weights, self.limit)
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if new:
            flat, counts = features(new)
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new))))
            if self.weights is None:
                self.parts += np.split(flat, np.cumsum(counts)[:-1])
            else:
                self.sums = np.concatenate([self.sums, np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts)])
            self.counts = np.concatenate([self.counts, counts])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


@dataclass
class QualityModel:
    """Softmax weights of the two classes brought down to one number per bucket, and their difference's offset."""

    weights: np.ndarray
    offset: float

    def scores(self, texts: list[str], table: WordTable) -> np.ndarray:
        parts = [t.split() for t in texts]
        numbers = table.numbers([w for p in parts for w in p])
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        again = numbers[1:] == numbers[:-1] if len(numbers) else np.zeros(0, bool)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for k in range(len(texts)):
            own = numbers[bounds[k] : bounds[k + 1]]
            repeats = int(again[bounds[k] : max(bounds[k], bounds[k + 1] - 1)].sum())
            total[k] = table.sums[own].sum() + repeats * self.weights[AGAIN] + self.weights[END]
            count[k] = table.counts[own].sum() + repeats + 1
        return 1 / (1 + np.exp(-np.clip(total / count + self.offset, -30, 30)))


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """Vectors and softmax weights by stochastic gradient descent, one document at a time, the rate falling to zero."""
    table, rows = WordTable(), []
    for text in texts:
        words = text.split()
        numbers = table.numbers(words)
        used, times = np.unique(numbers, return_counts=True)
        flat = np.concatenate([table.parts[k] for k in used]) if len(used) else np.zeros(0, np.int64)
        share = np.repeat(times, table.counts[used]).astype(np.float64)
        repeats = int((numbers[1:] == numbers[:-1]).sum())
        flat, share = np.concatenate([flat, [END, AGAIN]]), np.concatenate([share, [1, repeats]])
        buckets, place = np.unique(flat, return_inverse=True)
        weight = np.bincount(place, share)
        rows.append((buckets, (weight / weight.sum()).astype(np.float32)))
    rnd = np.random.default_rng(SEED)
    vectors = rnd.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, offset = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rnd.permutation(len(rows)):
            buckets, weight = rows[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weight @ vectors[buckets]
            raw = output @ mean + offset
            error = np.exp(raw - raw.max())
            error /= error.sum()
            error[labels[k]] -= 1
            back = error @ output
            output -= rate * np.outer(error, mean)
            offset -= rate * 0.1 * error
            # A mean over many features moves each of them little; the step is scaled by the largest share.
            vectors[buckets] -= (rate / weight.max()) * weight[:, None] * back
    return QualityModel((vectors @ (output[1] - output[0])).astype(np.float64), float(offset[1] - offset[0]))


def held_out(doc_id):
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, most_documents: int = TRAIN_DOCUMENTS, most_chars: int = TRAIN_CHARS) -> QualityModel:
    """A model from a bounded sample of labelled documents that are not held out; whole texts.

    A document with both labels is not learned from; equal labels count once, rows of one id and text too. Null ids and
    null labels are left out, null texts are empty. The sample holds ``most_documents`` rows at most, and ``most_chars``
    characters. Without a document of either label every score is a half; so it is for empty tables.
    """
    spark = documents.sparkSession
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    known = known.filter("quality = _other").drop("_other")
    rows = texts_of(documents).withColumn("label", F.xxhash64("text"))
    sizes = rows.select("doc_id", "label", F.length("text").alias("size")).join(known, "doc_id").distinct()
    chosen, chars = [], 0
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "size", "label").limit(most_documents).collect():
        if chars + row["size"] <= most_chars:
            chosen.append((row["doc_id"], row["label"], row["quality"]))
            chars += row["size"]
    if len({q for _, _, q in chosen}) < 2:
        return QualityModel(np.zeros(BUCKETS), 0.0)
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label long, quality int"))  # most_documents rows at most
    sample = rows.join(few, ["doc_id", "label"]).select("doc_id", "text", "quality").distinct().collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in sample], [r["quality"] for r in sample])


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: better) and ``predicted`` of every whole text.

    The document's vector is the mean of all its features' vectors, so the class score is a sum over its words; words
    that recur are worked out once per task. Null and empty texts get the score of the end sign alone. Repeated rows
    each give a row; an empty table gives an empty result; a null id is held out as null. Other columns are ignored.
    """
    small_batches(documents.sparkSession)

    def run(batches):
        table = WordTable(model.weights)
        for batch in slices(batches):
            scores = model.scores(batch.column("text").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = texts_of(documents).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, whose text scores ``threshold`` or more."""
    small_batches(documents.sparkSession)
    columns = documents.columns
    inputs = documents.select(F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"), F.struct(*(documents[c] for c in columns)).alias("row"))
    kinds = dict(inputs.dtypes)

    def run(batches):
        table = WordTable(model.weights)
        for batch in slices(batches):
            good = model.scores(batch.column("text").to_pylist(), table) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("row")], ["row"]).filter(pa.array(good))

    return inputs.mapInArrow(run, f"row {kinds['row']}").select("row.*")
