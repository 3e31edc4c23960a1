"""Substring dedup: words inside repeated windows, found by window fingerprints.

Every word position with a full window after it is a suffix.  No suffix tree is
built.  First the suffixes' short prefixes are counted: one that is alone is done.
The others are dealt by the hash of a longer prefix of fixed length and sorted by
(prefix, rest of the window): neighbours that are equal are windows that occur more
than once.  A prefix with many different continuations is not split.

A group of documents sends each distinct prefix (or suffix) once, with a mark
when it has several itself.  So a passage in a third of all documents costs a
subtree one entry for each group of documents, however often it occurs, and
nothing needs a limit.  Replies are one bit per entry, in the order sent.

Words are compared by 64-bit values and windows by 128 bits.  Edge cases: null
and empty texts have no words; texts shorter than the window lose nothing;
repeated rows are copies of each other and lose all their windows; null ids are
kept; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crashlens.llm.common import written
from crashlens.llm.groups import WordValues, dealt, destinations, one, window_values, word_values

#: Words in the first and in the longer prefix.
SHORT, LONG = 8, 16


class Suffixes:
    """Prefix and window values of all suffixes of a group of texts."""

    def __init__(self, texts: list[str], window: int, levels: int):
        self.raw = [t.encode() for t in texts]
        values, self.sizes = word_values(self.raw, WordValues())
        self.window = window
        stops = np.cumsum(self.sizes)
        left = np.repeat(stops, self.sizes) - np.arange(len(values))
        self.start = np.flatnonzero(left >= window)
        self.short = window_values(values, SHORT)[self.start] if len(values) else values
        if levels > 1 and len(values):
            self.head = window_values(values, LONG)
            self.tail = window_values(values, window - LONG)

    def short_prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct short prefixes as destination << 32 | value, index of each suffix, how often)."""
        key = ((self.short >> np.uint64(32)) % np.uint64(n)) << np.uint64(32) | self.short & np.uint64(0xFFFFFFFF)
        return np.unique(key, return_inverse=True, return_counts=True)

    def survivors(self, n: int, bits: dict[int, np.ndarray]) -> np.ndarray:
        """Positions whose short prefix another suffix has too."""
        key, at, count = self.short_prefixes(n)
        return self.start[((count > 1) | replied(key, bits))[at]]

    def long_prefixes(self, n: int, bits: dict[int, np.ndarray]):
        """(positions, distinct (destination, head, tail) rows sorted, index, how often)."""
        start = self.survivors(n, bits)
        rows = np.zeros(len(start), [("to", "<u4"), ("head", "<u8"), ("tail", "<u8")])
        if len(start):
            rows["head"], rows["tail"] = self.head[start], self.tail[start + LONG]
            rows["to"] = (rows["head"] >> np.uint64(32)) % np.uint64(n)
        order = np.lexsort((rows["tail"], rows["head"], rows["to"]))
        new = np.ones(len(rows), bool)
        new[1:] = rows[order][1:] != rows[order][:-1]
        at = np.empty(len(rows), np.int64)
        at[order] = np.cumsum(new) - 1
        return start, rows[order][new], at, np.bincount(at, minlength=int(new.sum())) if len(at) else np.empty(0, np.int64)


def replied(key: np.ndarray, bits: dict[int, np.ndarray]) -> np.ndarray:
    """The destinations' answers, one after another, to keys sorted by destination."""
    to = np.unique((key >> np.uint64(32)).astype(np.int64)) if key.dtype == np.uint64 else np.unique(key["to"].astype(np.int64))
    flat = [bits[int(t)] for t in to]
    return np.concatenate(flat) if flat else np.empty(0, bool)


def unpacked(replies: pa.Table, level: int) -> dict[int, np.ndarray]:
    rows = zip(*(replies.column(c).to_pylist() for c in ("level", "grp_to", "n", "bits")))
    return {to: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for lv, to, n, b in rows if lv == level}


REQUEST = pa.schema([("grp", pa.int32()), ("grp_to", pa.int32()), ("entries", pa.binary()), ("many", pa.binary())])
REPLY = pa.schema([("grp", pa.int32()), ("grp_to", pa.int32()), ("level", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
_REQUEST, _REPLY = "grp int, grp_to int, entries binary, many binary", "grp int, grp_to int, level int, n int, bits binary"


def requests(grp: int, to: np.ndarray, entries: np.ndarray, count: np.ndarray) -> pa.Table:
    """One row per destination with its entries, which are sorted by destination."""
    cuts = np.flatnonzero(np.diff(to)) + 1 if len(to) else []
    rows = [(grp, int(t[0]), e.tobytes(), np.packbits(c > 1).tobytes()) for t, e, c in zip(np.split(to, cuts), np.split(entries, cuts), np.split(count, cuts)) if len(t)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, REQUEST)], schema=REQUEST)


def answered(level: int, kind: np.dtype):
    """The subtree of one destination: which entries are not alone."""
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(e, kind) for e in table.column("entries").to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(table.column("many").to_pylist(), parts)])
        entries = np.concatenate(parts)
        order = np.argsort(entries) if entries.dtype.names is None else np.lexsort((entries["tail"], entries["head"]))
        sorted_ = entries[order]
        new = np.ones(len(entries), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        node = np.cumsum(new) - 1
        total = np.bincount(node, 1 + many[order])
        repeated = np.empty(len(entries), bool)
        repeated[order] = total[node] > 1
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        bits = [np.packbits(b).tobytes() for b in np.split(repeated, cuts)]
        grp_to = table.column("grp_to")
        return pa.table([table.column("grp"), grp_to, pa.array([level] * len(parts), pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array(bits, pa.binary())], schema=REPLY)

    return run


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed."""
    if window <= LONG:
        raise ValueError(f"the window must be longer than the longer prefix ({LONG} words)")
    table = dealt(docs, "substrings")
    n = destinations(table)
    id_type = table.schema["doc_id"].dataType.simpleString()

    def ask_short(group: pa.Table) -> pa.Table:
        key, _, count = Suffixes(group.column("text").to_pylist(), window, 1).short_prefixes(n)
        return requests(one(group, "grp"), (key >> np.uint64(32)).astype(np.int64), key.astype("<u4"), count)

    short = table.groupBy("grp").applyInArrow(ask_short, _REQUEST)
    first = written(short.groupBy("grp_to").applyInArrow(answered(1, np.dtype("<u4")), _REPLY), "substrings-level1")

    def ask_long(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return REQUEST.empty_table()
        rows = Suffixes(group.column("text").to_pylist(), window, 2).long_prefixes(n, unpacked(replies, 1))[1:]
        entries = np.empty(len(rows[0]), ENTRY)
        entries["head"], entries["tail"] = rows[0]["head"], rows[0]["tail"]
        return requests(one(group, "grp"), rows[0]["to"].astype(np.int64), entries, rows[2])

    long = table.groupBy("grp").cogroup(first.groupBy("grp")).applyInArrow(ask_long, _REQUEST)
    second = written(long.groupBy("grp_to").applyInArrow(answered(2, ENTRY), _REPLY), "substrings-level2")

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        out = pa.schema([("doc_id", group.schema.field("doc_id").type), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
        if not group.num_rows:
            return out.empty_table()
        suffixes = Suffixes(group.column("text").to_pylist(), window, 2)
        start, rows, at, count = suffixes.long_prefixes(n, unpacked(replies, 1))
        deep = ((count > 1) | replied(rows, unpacked(replies, 2)))[at] if len(start) else np.empty(0, bool)
        change = np.zeros(int(suffixes.sizes.sum()) + 1, np.int64)
        change[start[deep]] += 1
        np.add.at(change, start[deep] + window, -1)
        gone = np.cumsum(change)[:-1] > 0
        kept, removed, offset = [], [], 0
        for raw, size in zip(suffixes.raw, suffixes.sizes):
            drop = gone[offset : offset + size]
            offset += size
            words = raw.split()
            kept.append(b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if drop.any() else words).decode())
            removed.append(int(drop.sum()))
        return pa.table([group.column("doc_id"), pa.array(kept, pa.string()), pa.array(suffixes.sizes), pa.array(removed, pa.int64())], schema=out)

    return table.groupBy("grp").cogroup(first.unionByName(second).groupBy("grp")).applyInArrow(remove, f"doc_id {id_type}, text string, n_words long, n_removed long")


ENTRY = np.dtype([("head", "<u8"), ("tail", "<u8")])
