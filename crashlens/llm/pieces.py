"""SentencePiece encoding and decoding with a distinct-chunk table.

White space becomes a marker, and no piece of the model holds a marker after
another character, so no merge crosses a chunk ``markers + word``.  Each task
keeps a table of the distinct chunks it met, has the library segment each of
them once, and joins the ids back by position.  ``encode`` checks the model's
vocabulary for that property and refuses a model without it.

Edge cases: a null text counts as empty, an empty text has the end id alone;
runs of spaces, literal marker characters and texts without any space take the
same path; rows are independent, so repeated rows and null ids stay as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crashlens.llm.common import as_batch, plain, slices

MARK = "▁"
#: A chunk: markers and the characters up to the next marker.
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Most distinct chunks whose ids a Python worker remembers (about 200 bytes each).
REMEMBERED = 400_000


class ChunkIds(dict):
    """Chunk without its first marker -> its ids as int32 bytes, filled as chunks are met."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.vocab_size()))):
            raise ValueError("a piece of this model crosses a whitespace marker")
        if sp.encode_as_pieces(" a") == sp.encode_as_pieces("a"):
            raise ValueError("this model drops extra white space or adds no first marker")
        self.marker = sp.piece_to_id(MARK)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.model.encode(chunk.replace(MARK, " "), num_threads=1) if chunk else [self.marker]
        self[chunk] = out = array("i", ids).tobytes()
        return out


_KNOWN: dict[str, ChunkIds] = {}


def known(path: str) -> ChunkIds:
    if path not in _KNOWN:
        _KNOWN[path] = ChunkIds(path)
    return _KNOWN[path]


def chunks(text: str) -> list[str]:
    """The text's chunks, each without its first marker (the library adds that itself)."""
    words = text.split(" ")
    if MARK not in text and "" not in words:
        return words
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []


def encode_texts(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, all ids one after another), each text with the end id."""
    get, end = known(path).__getitem__, array("i", [end_id]).tobytes()
    rows = [b"".join(map(get, chunks(t))) + end for t in texts]
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(rows), np.int32)


def encode(docs: DataFrame, model_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, ids array<int> of every text, the end id last."""
    source = plain(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            offsets, ids = encode_texts(batch.column("text").to_pylist(), model_path, end_id)
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("ids", pa.list_(pa.int32()))])
            yield as_batch(schema, batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text that the library makes of the ids."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = known(model_path).model
        for batch in batches:
            lists = batch.column("ids")
            texts = [sp.decode(lists[i].values.to_numpy(zero_copy_only=False).tolist()) for i in range(batch.num_rows)]
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("ids", lists.type), ("text", pa.string())])
            yield as_batch(schema, batch.column("doc_id"), lists, texts)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids array<int>, text string")
