"""How demanding a text is, by a familiar-word formula.

A word is familiar to a degree: the list for a share p holds the words found in
at least p of the documents. A document is described by its shares of words
outside each list and its average number of words in a sentence; a softmax over
these, fitted on labelled documents, turns them into bands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ship, spread

#: A list of familiar words for each of these shares of the documents. The lowest share p bounds the
#: lists: a document has so many different words d on average, so no more than d / p words reach it.
SHARES = (0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3)
#: Labelled documents that the bands are fitted on at most, chosen by a hash of their key.
LABELLED_SAMPLE = 20_000
FIT_STEPS, FIT_RATE, FIT_RIDGE = 300, 0.05, 1e-3

_WORD = re.compile(r"(?<![\w@-])[^\W\d_]+(?:['’][^\W\d_]+)?(?![\w]|-\d)")
_MARK = re.compile(r"^\s*(?:\d{1,2}:\d{2}(?::\d\d)?|[-*•]|\d+[.)]|>)\s+", re.M)
_SENTENCE = re.compile(r"[.!?;]+(?=\s|$)|\n\s*\n")


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): the number of texts that hold each word, added up in the workers before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(set(_WORD.findall(t.lower())))
            if len(counts) > 500_000:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    def _counted(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = spread(texts.select(text).where(F.col(text).isNotNull()))
    return rows.mapInArrow(count, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))


def familiarity(texts: DataFrame, text: str) -> dict[str, int]:
    """Word to the number of lists that it is on; words on no list are left out."""
    total = texts.where(F.col(text).isNotNull()).count()
    often = count_words(texts, text).where(F.col("n") >= max(1.0, SHARES[0] * total))
    return {r["word"]: sum(r["n"] >= p * total for p in SHARES) for r in often.toLocalIterator()}


def describe(text: str, lists: dict[str, int]) -> list[float]:
    """Shares of words outside each list, then the words in a sentence; all 0 for a text without words.

    Marks and times at line starts are no words, and fragments of one word no
    sentences.
    """
    get = lists.get
    levels, lengths = [], []
    for sentence in _SENTENCE.split(_MARK.sub("", text).lower()):
        words = _WORD.findall(sentence)
        if len(words) > 1:
            lengths.append(len(words))
            levels.extend([get(w, 0) for w in words])
    if not lengths:
        return [0.0] * (len(SHARES) + 1)
    reached = np.bincount(levels, minlength=len(SHARES) + 1)
    outside = np.cumsum(reached)[:-1] / len(levels)
    return [*outside.tolist(), len(levels) / len(lengths)]


def features(df: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(key, features, ``keep``): ``describe`` of each row, with lists from all rows. A null text reads as empty."""
    spark, keep = df.sparkSession, keep or []
    ship(spark)
    lists = spark.sparkContext.broadcast(familiarity(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t, lists.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], names=[key, "features", *keep])

    kind = lambda c: f"{c} {df.schema[c].dataType.simpleString()}"
    rows = spread(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep))
    return rows.mapInArrow(run, ", ".join([kind(key), "features ARRAY<DOUBLE>", *map(kind, keep)]))


class Bands:
    """A softmax over features, their squares and products; ``predict`` is what the workers run."""

    def __init__(self, rows: np.ndarray, bands: np.ndarray) -> None:
        self.classes = np.unique(bands)
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-9
        expanded = self._expand(rows)
        wanted = (bands[:, None] == self.classes[None, :]).astype(float)
        weights = np.zeros((expanded.shape[1], len(self.classes)))
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, FIT_STEPS + 1):  # Adam on the whole sample
            slope = expanded.T @ (self._softmax(expanded @ weights) - wanted) / len(rows) + FIT_RIDGE * weights
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            weights -= FIT_RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights = weights

    def _expand(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        i, j = np.triu_indices(z.shape[1])
        return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        e = np.exp(scores - scores.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return self.classes[(self._expand(rows) @ self.weights).argmax(1)]


def fit_bands(described: DataFrame, labels: DataFrame, key: str, band: str, sample: int = LABELLED_SAMPLE) -> Bands | None:
    """Bands fitted on at most ``sample`` labelled rows; null without any. Several labels of a row all count."""
    labelled = described.join(labels.select(key, band).where(F.col(band).isNotNull()), key)
    rows = labelled.orderBy(F.xxhash64(key), key, band).limit(sample).select("features", band).toPandas()
    if rows.empty:
        return None
    return Bands(np.array(rows["features"].tolist(), float), rows[band].to_numpy(int))


def predict_bands(described: DataFrame, bands: Bands, key: str) -> DataFrame:
    """(key, reading_band) for each described row."""
    given = described.sparkSession.sparkContext.broadcast(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.array(batch.column(1).to_pylist(), float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(given.value.predict(rows), pa.int32())], names=[key, "reading_band"])

    return described.select(key, "features").mapInArrow(run, f"{key} {described.schema[key].dataType.simpleString()}, reading_band INT")
