"""Quality rules: document statistics judged by two plain rules and gradient-boosted trees.

The statistics of every document are computed once and written.  The trees are
fitted on a bounded sample of labelled documents (``max_train`` of them, those
whose id hashes lowest), flattened into node arrays and scored in batches.  The
score may only fall as the shares of symbols, repeated lines, repeated words and
capitals rise (``MONOTONE``), so a worse document never gains.

Edge cases: a null or empty text has no words and fails the base rules; without
labels of both classes the trees have no say and the base rules alone decide;
several labels of one id count as the lowest; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm import trees
from crashlens.llm.common import as_batch, plain, slices, written

# Fixed values of the base statistics and rules.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
#: Feature -> 1: the score may only rise with it, -1: only fall, 0: free.
MONOTONE = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "words_per_line": 0, "distinct_share": 0, "upper_share": -1, "digit_share": 0, "mark_share": 0,
}
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(a) < 4:
        return 0, len(ids)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 1 << 20:  # three ids would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    covered = np.zeros(len(a) + 1, bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        covered[hit + k] = True
    return int(covered.sum()), len(ids)


def statistics(text: str) -> list[int]:
    """The values of COUNTS and EXTRA."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, distinct = repeated_words(words)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        len(words), len(text) - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), distinct, without(_UPPER), without(_DIGITS), without(_MARKS),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and EXTRA of every whole text."""
    source = plain(docs)
    columns = COUNTS + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *((c, pa.int64()) for c in columns)])
            rows = np.asarray([statistics(t) for t in batch.column("text").to_pylist()], np.int64)
            yield as_batch(schema, batch.column("doc_id"), *rows.T)

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in columns))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_words"] / lines, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars,
    ], axis=1)


def fit(stats: DataFrame, labels: DataFrame, max_train: int = 20_000) -> trees.Forest | None:
    """Trees on at most ``max_train`` labelled documents; None without both classes."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *stats.columns).limit(max_train).toPandas()
    y = sample["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    return trees.fit(features({c: sample[c].to_numpy() for c in COUNTS + EXTRA}), y, list(MONOTONE.values()))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 20_000) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality_score (null without a model) and kept."""
    stats = written(document_statistics(docs), "quality-stats")
    forest = fit(stats, labels, max_train)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    id_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS + EXTRA}
            score = forest.probability(features(counts)) if forest else pa.nulls(batch.num_rows, pa.float64())
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *((c, pa.int64()) for c in COUNTS), ("quality_score", pa.float64())])
            yield as_batch(schema, batch.column("doc_id"), *(batch.column(c) for c in COUNTS), score)

    scored = stats.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality_score double")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality_score", F.lit(1.0)) >= threshold))
