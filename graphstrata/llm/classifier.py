"""A quality classifier on subword embeddings, trained by stochastic gradient descent.

A document is the average of the vectors of its words and of the character n-grams inside
them, each found by a hash; a softmax layer tells the labels apart. Training takes a
bounded sample of labelled rows, drawn by a hash of their ids, and goes over it in numpy,
a document at a time. As the output is linear in the average, what a vector adds to the
difference of both labels is one number, so scoring averages numbers and not vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphstrata.llm.batches import bounded_batches
from graphstrata.llm.hashing import Sums
from graphstrata.runtime import materialize

#: Labelled rows that training takes at most, and entries (feature, count) of all of them.
TRAIN_ROWS, TRAIN_FEATURES = 4_000, 10_000_000
FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    buckets_log2: int = 18
    width: int = 16
    sizes: tuple[int, ...] = (3, 4, 5)
    epochs: int = 6
    rate: float = 0.2
    seed: int = 42


_AGAIN = np.uint64(1 << 63)  # stands for a word that is the one before it once more, whichever that is


def _line(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with each stretch of white space as one blank, one at both ends, and where the blanks are."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = ((points >= 9) & (points <= 13)) | (points == 32)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    return np.where(blank, 32, points)[keep], blank[keep]


def _features(text: str, settings: Settings) -> np.ndarray:
    """Buckets of all words and n-grams of a text, with repeats, and one that every text has.

    n-grams see where their word begins and ends, and no further. A word that repeats the
    one before is known as that alone: stuttering is one word of its own in any language.
    """
    line, blank = _line(text)
    edge = np.diff(blank.view(np.int8))
    begin, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    words = Sums(line).hashes(begin, end)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    if len(again):
        words[again] = _AGAIN
        change = np.zeros(len(line) + 1, np.int32)
        change[begin[again]] += 1
        change[end[again] + 1] -= 1  # with the blank behind it
        keep = np.cumsum(change[:-1]) == 0
        line, blank = line[keep], blank[keep]
    sums, inner = Sums(line), np.concatenate([[0], np.cumsum(blank)])  # blanks before a place
    found = [np.zeros(1, np.uint64), words]
    for n in settings.sizes:
        if len(line) >= n:
            at = np.flatnonzero(inner[n - 1 : len(line)] == inner[1 : len(line) - n + 2])
            found.append(sums.hashes(at, at + n) ^ np.uint64(n))
    return (np.concatenate(found) >> np.uint64(64 - settings.buckets_log2)).astype(np.int32)


def _texts(column: pa.Array) -> Iterator[str]:
    yield from (x.as_py() or "" for x in column)


# ---------------------------------------------------------------- training


def _counted(settings: Settings):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_texts(batch.column("text"))):
                buckets, counts = np.unique(_features(text, settings), return_counts=True)
                one = batch.slice(i, 1)
                columns = [one.column("place"), one.column("quality"), pa.array([len(buckets)], pa.int32()), pa.array([buckets.tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "quality", "entries", "buckets", "counts"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees, by their id; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, rows: int = TRAIN_ROWS, features: int = TRAIN_FEATURES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of at most ``rows`` labelled documents, in the order of a hash of their ids and at most ``features`` entries.

    Ids with both labels are left out, as are null ids and labels; of rows that share an id
    each counts.
    """
    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    chosen = agreed.filter(~held_out(F.col("doc_id"))).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(rows).select("doc_id", "quality", "place")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(materialize(chosen)), "doc_id")  # TRAIN_ROWS narrow rows at most
    counted = materialize(labelled.select("place", "quality", "text").mapInArrow(_counted(settings), "place long, quality int, entries int, buckets array<int>, counts array<int>"))
    sizes = counted.select("place", "entries").orderBy("place").limit(rows).collect()
    total, last = 0, None
    for row in sizes:
        total += row["entries"]
        if total > features and last is not None:
            break
        last = row["place"]
    if last is None:
        return []
    taken = counted.filter(F.col("place") <= last).orderBy("place", "entries").limit(rows).toArrow()
    return [(r, np.asarray(b.values, np.int64), np.asarray(c.values, np.float32)) for r, b, c in zip(taken.column("quality").to_pylist(), taken.column("buckets"), taken.column("counts"), strict=True)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and what all texts begin with.

    Plain gradient descent with a rate that falls to nothing. Without rows, or with one
    label only, the share of label 1 (a half without rows) is what every text gets.
    """
    labels = np.array([r[0] for r in rows])
    size = 1 << settings.buckets_log2
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    if not len(rows) or labels.min() == labels.max():
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    random = np.random.default_rng(settings.seed)
    vectors = random.uniform(-1 / settings.width, 1 / settings.width, (size, settings.width)).astype(np.float32)
    output, bias = np.zeros((2, settings.width), np.float32), np.log([1 - share, share]).astype(np.float32)
    means = [c / c.sum() for _, _, c in rows]
    steps, step = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(rows)):
            label, buckets, mean = rows[i][0], rows[i][1], means[i]
            rate = np.float32(settings.rate * (1 - step / steps))
            step += 1
            hidden = mean @ vectors[buckets]
            wrong = -_softmax(output @ hidden + bias)
            wrong[label] += 1
            back = wrong @ output
            output += rate * wrong[:, None] * hidden
            # steps go by a vector's share of the text over the even share, and by 1 at most: long texts teach as much as short ones
            vectors[buckets] += (rate * np.minimum(mean * len(mean), 1))[:, None] * back
            bias += np.float32(0.01) * rate * wrong
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


# ---------------------------------------------------------------- scoring


def _scores(model, settings: Settings):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, bias = model.value
        for batch in batches:
            odds = np.array([adds[_features(t, settings)].mean(dtype=np.float64) for t in _texts(batch.column("text"))]) + bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.exp(-np.logaddexp(0.0, -odds)))], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, scored by its whole text alone.

    A null text is an empty one, which has a score too; a null id isn't held out; rows that
    repeat are rows each; without labels every score is a half. Other columns are not read.
    """
    settings, spark = settings or Settings(), docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(train(training_rows(docs, labels, settings), settings))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model, settings), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, with ``labels.quality`` to learn from."""
    return score_documents(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
