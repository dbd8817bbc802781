"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bytetext import U, byte_values, mixed, pieces, word_hashes, words
from ledgerlens.llm.order import packed

BUCKETS = 1 << 18
GRAMS = (3, 5)
THRESHOLD = 0.3
TRAIN_ROWS = 6000  # the bounded sample of labelled rows that the model is fitted on


@dataclass(frozen=True)
class Fit:
    """Settings of the training: vector size, passes (more where they make fewer than ``steps`` steps), first learning rate, seed."""

    dim: int = 8
    passes: int = 5
    steps: int = 5000
    rate: float = 0.5
    seed: int = 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: pairs of (bucket of every feature, bounds of the texts in it), for the words, for pairs
    of neighbouring words and for the byte n-grams of each length in GRAMS.  No feature reaches over the end of a text.  A
    word that follows itself is one feature whatever the word."""
    shift = U(64 - buckets.bit_length() + 1)
    starts, ends, bounds = words(data, offsets)
    word = word_hashes(data, starts, ends)
    found = [((word >> shift).astype(np.int32), bounds)]
    pair = np.where(word[1:] == word[:-1], U(1), word[:-1] * U(0x9E3779B97F4A7C15) + word[1:])
    apart = np.ones(len(pair), bool)
    apart[bounds[(bounds > 0) & (bounds < len(word))] - 1] = False
    found.append(((mixed(pair[apart]) >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - 1, 0))])))
    value = byte_values(2)[data]
    h, n = value, 1
    for size in GRAMS:
        while n < size:
            h = h[:-1] * U(0x9E3779B97F4A7C15) + value[n:]
            n += 1
        # windows of one text are a run; those over an edge are left out
        first = np.minimum(offsets[:-1], len(h))
        last = np.maximum(first, np.minimum(offsets[1:] - size + 1, len(h)))
        inside = np.zeros(len(h) + 1, np.int8)
        np.add.at(inside, first, 1)
        np.add.at(inside, last, -1)
        keep = np.cumsum(inside[:-1], dtype=np.int8) > 0
        found.append(((mixed(h[keep] + U(size)) >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(last - first)])))
    return found


def counted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and how often each came, in the smallest type that holds the counts."""
    every = np.concatenate([f for f, _ in features(data, np.array([0, len(data)]))])
    ids, n = np.unique(every, return_counts=True)
    return ids, n.astype(np.min_scalar_type(n.max(initial=0)))


@dataclass
class Model:
    """Score per bucket and class (vectors times output weights) and bias per class: all that scoring needs."""

    table: np.ndarray
    bias: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Softmax over the classes of the mean of the features' scores; texts without features have the biases alone."""
        out = []
        for _, _, data, offsets in pieces(texts):
            n = len(offsets) - 1
            total, count = np.zeros((n, self.table.shape[1])), np.zeros(n)
            for ids, bounds in features(data, offsets, len(self.table)):
                here = np.diff(bounds)
                some = here > 0
                count += here
                if some.any():
                    for k in range(total.shape[1]):
                        total[some, k] += np.add.reduceat(self.table[:, k][ids], bounds[:-1][some], dtype=np.float64)
            logits = total / np.maximum(count, 1)[:, None] + self.bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, self.table.shape[1]))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, how: Fit = Fit()) -> Model:
    """One document at a time in a fixed random order, learning rate falling to zero, cross-entropy of the softmax."""
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1 / how.dim, 1 / how.dim, (BUCKETS, how.dim)).astype(np.float32)
    weights, bias = np.zeros((how.dim, classes), np.float32), np.zeros(classes, np.float32)
    if len(labels):
        share = np.bincount(labels, minlength=classes) + 1.0
        bias += np.log(share / share.sum()).astype(np.float32)
    passes = max(how.passes, -(-how.steps // max(1, len(rows))))
    steps, step = passes * len(rows), 0
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            ids, n = rows[i]
            rate = how.rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            share = (n / int(n.sum())).astype(np.float32)
            hidden = share @ vectors[ids]
            logits = hidden @ weights + bias
            e = np.exp(logits - logits.max())
            error = e / e.sum()
            error[labels[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # the gradient of a vector is its share; shares of long texts are tiny, so it is scaled by their size as if the hidden vector were a mean of unit parts
            vectors[ids] -= (rate / (share @ share)) * share[:, None] * back
    return Model((vectors @ weights).astype(np.float32), bias.astype(np.float64))


def labelled(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """One label per id, ``doc_id`` and ``label``: of repeated rows the more frequent one, at equal numbers 1."""
    return labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS, how: Fit = Fit()) -> Model:
    """Fit on at most ``rows`` labelled documents, taken in the order of a hash of the id.

    ``labels``: doc_id and label (0 or 1), unique.  Only the ids of the sample are broadcast; one task fits the model, which
    is of fixed size (BUCKETS x classes).  Documents of one id several times all count, within the bound.  With no labelled
    document the model gives every text 1/2.
    """
    lucky = F.xxhash64("doc_id")
    sample = labels.select("doc_id", "label").orderBy(lucky, "doc_id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id").orderBy(lucky, "doc_id", F.xxhash64("text")).limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks = [], []
        for batch in batches:
            marks += batch.column("label").to_pylist()
            for _, _, data, offsets in pieces(batch.column("text")):
                seen += [counted(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(seen, np.array(marks, int), 2, how))], pa.binary())], ["model"])

    found = chosen.select("text", "label").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([], np.zeros(0, int), 2, how)


def score_column(text: Column, model: Model) -> Column:
    """Probability of label 1 of the whole text, null as empty, rounded to 6 digits."""

    @F.arrow_udf("double")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array(np.round(model.probabilities(array)[:, 1], 6))

    return score(text)


def id_class(id_col: Column, modulus: int) -> Column:
    return F.crc32(id_col.cast("string")) % modulus


def classify(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
    threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, how: Fit = Fit(), score: str = "score",
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced, all others stay.

    Labels are learnt only from ids whose crc32 (as text) modulo 5 is not 0; the score sees nothing but the text.  Null texts
    are scored as empty ones; a null id is not held out and has no label.  Documents do not move: the model travels to them.
    Repeated rows get equal scores; an empty table gives no rows.
    """
    fold = labelled(labels, label_col).where(id_class(F.col("doc_id"), 5) != 0)
    model = train(docs, fold, text_col, id_col, rows, how)
    return (
        docs.withColumn("held_out", F.coalesce(id_class(F.col(f"`{id_col}`"), 5) == 0, F.lit(False)))
        .withColumn(score, score_column(F.col(f"`{text_col}`"), model))
        .withColumn("predicted", (F.col(score) >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, whole and in their own columns, that the classifier does not reject."""
    rows = docs.select(packed(docs), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return classify(rows, labels, **options).where("predicted = 1").select("row.*")


def op10_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(documents.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
