"""Toxicity: a logistic classifier over the presence of words and word stems, regularised by counterfactuals.

Training takes at most ``max_train`` labelled documents (those whose id hashes
lowest) outside the held-out fold.  Spark counts the words' documents by class
and keeps the ``vocabulary`` most telling ones.  Each labelled text that names a
group is paired with copies in which that term is swapped for the others, and
the loss adds ``penalty`` times the squared change of the logit, so the choice of
the group named moves the score little.  Those terms give no stem, which would carry
the group's weight past the swap.  Scoring is one pass over the texts with
the word weights (``vocabulary`` entries at most) in the tasks' closure.

Edge cases: null and empty texts get the score of a text without known words;
without labels of both classes every score is the share of label 1 (0 without
labels); several labels of one id count as the highest; repeated rows are scored
one by one; a null id is never a training row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import as_batch, crc_mod, plain, slices, written

#: Neutral names of groups, swapped with each other in training; a parameter.
IDENTITY_TERMS = (
    "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees",
    "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "african", "european", "latino",
    "disabled", "blind", "deaf", "elderly", "teenagers",
)
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


#: Bytes of a longer word's beginning that count as a term of their own.
STEM = 5


def terms(text: str, identity: frozenset[bytes] = frozenset(t.encode() for t in IDENTITY_TERMS)) -> set[bytes]:
    """Distinct lower-case words, ASCII punctuation taken as space, and the stems of
    longer words other than identity terms with a star."""
    words = set(text.lower().encode().translate(_TO_SPACE).split())
    return words | {w[:STEM] + b"*" for w in words if len(w) > STEM and w not in identity}


def training_words(docs: DataFrame, labels: DataFrame, held_out, max_train: int, identity: tuple[str, ...] = IDENTITY_TERMS) -> DataFrame:
    """doc_id, toxic, words of the training sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = plain(docs).join(F.broadcast(sample), "doc_id")  # at most max_train rows of two numbers
    whole = frozenset(t.encode() for t in identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [sorted(terms(t, whole)) for t in batch.column("text").to_pylist()]
            schema = pa.schema([("toxic", pa.int32()), ("words", pa.list_(pa.binary()))])
            yield as_batch(schema, batch.column("toxic").cast(pa.int32()), words)

    return rows.mapInArrow(run, "toxic int, words array<binary>")


def telling_words(rows: DataFrame, vocabulary: int, identity: tuple[str, ...]) -> list[bytes]:
    """The words whose presence differs most between the classes (chi-square), and the identity terms."""
    n, positive = rows.agg(F.count("*"), F.sum("toxic")).first()
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("toxic").alias("in_toxic"))
    expected = F.col("df") * (positive / n)
    gain = F.pow(F.col("in_toxic") - expected, 2) / (expected * (1 - F.col("df") / (n + 1.0)))
    top = counts.where("df >= 3").orderBy(gain.desc(), "word").limit(vocabulary)
    return list(dict.fromkeys([*(bytes(r["word"]) for r in top.select("word").collect()), *(t.encode() for t in identity)]))


def fit_weights(
    samples: list[np.ndarray], y: np.ndarray, width: int, identity: list[int], penalty: float, ridge: float, steps: int
) -> tuple[np.ndarray, float]:
    """Full-batch Adam on sparse rows of word indexes."""
    rows = np.repeat(np.arange(len(samples)), [len(s) for s in samples])
    cols = np.concatenate(samples).astype(np.int64) if samples else np.empty(0, np.int64)
    # a text that names group t, and its copy that names u instead, differ by w[t] - w[u]
    named = [(t, u) for s in samples for t in np.intersect1d(s, identity) for u in identity if u != t and u not in s]
    one, other = np.asarray(named, np.int64).reshape(-1, 2).T
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(y)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(cols, error[rows], width) + ridge * w
        if len(one):
            change = (w[one] - w[other]) * (2 * penalty / len(one))
            grad += np.bincount(one, change, width) - np.bincount(other, change, width)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def fit(
    docs: DataFrame, labels: DataFrame, held_out, max_train: int = 20_000, vocabulary: int = 4_096,
    identity: tuple[str, ...] = IDENTITY_TERMS, penalty: float = 1.0, ridge: float = 1e-4, steps: int = 300,
) -> tuple[dict[bytes, float], float]:
    """(word -> weight, bias)."""
    rows = written(training_words(docs, labels, held_out, max_train, identity), "toxicity-train")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        share = min(max(positive / n if n else 0.0, 1e-9), 1 - 1e-9)
        return {}, float(np.log(share / (1 - share)))
    vocab = telling_words(rows, vocabulary, identity)
    index = {w: i for i, w in enumerate(vocab)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[w] for w in ws if w in index] for ws in batch.column("words").to_pylist()]
            yield as_batch(pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32()))]), batch.column("toxic"), pa.array(found, pa.list_(pa.int32())))

    sample = rows.mapInArrow(run, "toxic int, at array<int>").toArrow()  # max_train rows of at most `vocabulary` small numbers
    samples = [np.asarray(x, np.int64) for x in sample.column("at").to_pylist()]
    w, bias = fit_weights(samples, sample.column("toxic").to_numpy().astype(float), len(vocab), [index[t.encode()] for t in identity], penalty, ridge, steps)
    return {t: float(x) for t, x in zip(vocab, w)}, float(bias)


def scores(texts: list[str], weights: dict[bytes, float], bias: float, identity: tuple[str, ...] = IDENTITY_TERMS) -> np.ndarray:
    known, get, whole = weights.keys(), weights.__getitem__, frozenset(t.encode() for t in identity)
    z = np.asarray([sum(map(get, sorted(terms(t, whole) & known)), bias) for t in texts])
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, weights: dict[bytes, float], bias: float, identity: tuple[str, ...] = IDENTITY_TERMS) -> DataFrame:
    """doc_id, score of every whole text."""
    source = plain(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("score", pa.float64())])
            yield as_batch(schema, batch.column("doc_id"), scores(batch.column("text").to_pylist(), weights, bias, identity))

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, labels: DataFrame, fold: int = 5, threshold: float = 0.5, identity: tuple[str, ...] = IDENTITY_TERMS, **training) -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``."""
    weights, bias = fit(docs, labels, F.coalesce(crc_mod(F.col("doc_id"), fold) == 0, F.lit(False)), identity=identity, **training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores([t or "" for t in batch.column("text").to_pylist()], weights, bias, identity) < threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, identity: tuple[str, ...] = IDENTITY_TERMS, **training) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text, mod ``fold``, is 0), score, predicted."""
    held = F.coalesce(crc_mod(F.col("doc_id"), fold) == 0, F.lit(False))
    weights, bias = fit(docs, labels, held, identity=identity, **training)
    scored = score(docs, weights, bias, identity)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
