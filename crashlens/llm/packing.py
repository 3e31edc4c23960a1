"""Packing: documents concatenated as token ids and cut into windows of a fixed length.

Two passes.  The first turns every text into ids and writes them with their
place inside the input partition (``part``, ``at``: the ids before the document
in this partition).  The second adds up the partition totals, one row per input
partition, into global offsets and cuts every document where it crosses a
multiple of the window: a document is one piece, plus one boundary record per
crossing.  No token moves through a shuffle, and no task sees more than its own
partition.  Only the last window can have padding.

Edge cases: a null or empty text is the end id alone; a very long text is cut
into as many pieces as it needs; repeated rows are packed once each, as they
come; a null ``doc_id`` stays null; an empty table gives no piece.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import as_batch, plain, slices, written

#: Most distinct words whose ids a Python worker remembers (about 200 bytes each).
REMEMBERED = 1_000_000
#: With these bytes a word may hold a special token, whose letter case counts.
SPECIAL = b"<|"


# Byte-level vocabularies write a byte as itself where it is a visible Latin-1
# character, and the others, in order, as the characters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_WRITTEN = dict(zip((b for b in range(256) if b not in _VISIBLE), range(256, 512)))


class WordIds(dict):
    """Word (UTF-8) -> its ids as little-endian uint32 bytes, filled as words are met.

    The tokenizer's normalising and splitting leave a lower-case word of letters in
    normal form as it is, and part a comma or full stop after an ASCII letter, so
    such words go to the merges at once; all others take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.short_cut = all(self.ids(w) == tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in map(str.encode, ("the", "unheard", "élève", "straße", "слово")))

    def ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.merge(word.decode("latin-1").translate(_WRITTEN))]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if self.short_cut and text.isalpha() and text.lower() == text and is_normalized("NFC", text):
            out = array("I", self.ids(word)).tobytes()
        elif self.short_cut and word[-1] in b".," and word[:-1].isalpha() and word.islower():
            out = self[word[:-1]] + self[word[-1:]]
        else:
            out = array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out


_KNOWN: dict[str, WordIds] = {}


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and never joins characters
    across it, so a text's ids are its words' ids in order.
    """
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    get = _KNOWN[path].__getitem__
    out = []
    for text in texts:
        raw = text.encode()
        out.append(b"".join(map(get, (raw if SPECIAL in raw else raw.lower()).split())))
    return out


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """One row per document: doc_id, part, at, n, ids (uint32 bytes, with the end id)."""
    source = plain(docs)
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, part int, at long, n long, ids binary"
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [x + end for x in encode_texts(batch.column("text").to_pylist(), path)]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            stops = at + np.cumsum(n)
            out = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
            yield as_batch(out, batch.column("doc_id"), np.full(len(ids), part), stops - n, n, ids)
            at = int(stops[-1])

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (uint32 little-endian bytes),
    doc_tokens, sequence_id, offset.  Every sequence but the last is full."""
    ids = written(tokenised(docs, tokenizer, end_id), "packing-ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per input partition: the table and its window hold 12 bytes for each file split
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = ids.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("at"))
    pieces = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(F.col("first") / window), F.floor((F.col("first") + F.col("n") - 1) / window)))
    )
    start = F.greatest(F.lit(0), F.col("sequence_id") * window - F.col("first")).cast("long")
    stop = F.least(F.col("n"), (F.col("sequence_id") + 1) * window - F.col("first")).cast("long")
    cut = pieces.withColumn("start", start).withColumn("length", stop - F.col("start"))
    return cut.select(
        "doc_id", "start", "length",
        F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id",
        (F.col("first") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
    )
