"""Language-model scoring with a weighted backoff automaton over words.

Outcomes are the training words, the end of a text, and one for all other words.
The automaton has a root and a state for each word (and the start of a text).
From word v, the arc of word w weighs P(w|v) = (c(vw) + K P(w)) / (c(v) + K); where
v has no such arc, its failure arc leads to the root and weighs K / (c(v) + K).
The root's arcs weigh P(w) = (c(w) - D) / N, and that of all other words D V / N.
Both levels sum to 1.  D comes from the counts of counts; K is the value of a grid
that predicts every training token best from the other ones (leave one out).

The counts are of the whole training part and have no bound, so nobody holds them
all.  Documents are dealt into groups; a group sends each of its distinct words and
word pairs once, with its own training counts, and gets back the corpus counts:
the states and arcs that its texts can touch.  Then each text is read once, left to
right, carrying the state and adding up the arcs' weights, for all K at once; the
best K over all groups picks the score.  Words and pairs are told apart by 64-bit
values inside parts of about a million words, however large the corpus.

Edge cases: null and empty texts are the end alone; without training documents
every outcome is the same one and all scores are 0; a null id trains and is not
held out; repeated rows count as often as they come.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import crc_mod, written
from crashlens.llm.groups import dealt, destinations, mixed, one

#: The end of a text, and the state before its first word; no word is empty or a space.
TEXT_END, TEXT_START = b"", b" "
#: Values of K to choose from.
GRID = (1.0, 10.0, 100.0, 1000.0, 10000.0)

_ASKED = "grp int, part int, words binary, word_counts binary, pairs binary, pair_counts binary"
ASKED = pa.schema([("grp", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("words", "word_counts", "pairs", "pair_counts"))])
# what a part knows of all its words stands in its first answer
FACTS = ("total", "kinds", "once", "twice")
_ANSWER = "grp int, part int, word_counts binary, pair_counts binary, " + ", ".join(f"{f} long" for f in FACTS)


class Index(dict):
    """Word -> its number among the distinct words met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Texts:
    """The tokens of a group's texts as numbers of its distinct words and word pairs,
    which are sorted by the part they belong to."""

    def __init__(self, group: pa.Table, parts: int):
        tokens = [[*t.encode().lower().split(), TEXT_END] for t in group.column("text").to_pylist()]
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        index = Index({TEXT_END: 0, TEXT_START: 1})
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(tokens)), np.int64, int(self.sizes.sum()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        state = np.empty_like(at)  # what stands before each token
        state[1:] = at[:-1]
        state[self.starts] = 1
        self.train = np.repeat(np.asarray(group.column("train").to_pylist(), bool), self.sizes)
        digests = b"".join(map(xxhash.xxh3_128_digest, index))
        value = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.word_part = (value[:, 0] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((value[:, 1], self.word_part))  # whatever the order of the group's rows
        self.words, self.word_part = value[order, 1], self.word_part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.state, self.end, self.start = place[at], place[state], int(place[0]), int(place[1])
        pairs, pair_at = np.unique(mixed(value[state, 1] * np.uint64(3) + mixed(value[at, 1])), return_inverse=True)
        part = (mixed(pairs) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        self.pairs, self.pair_part = pairs[order], part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_at = place[pair_at]


def cut(part: np.ndarray, *columns: np.ndarray) -> dict[int, list[bytes]]:
    """Part -> the columns' bytes for it; ``part`` is sorted."""
    cuts = np.flatnonzero(np.diff(part)) + 1
    numbers = part[np.concatenate([[0], cuts])] if len(part) else []
    return {int(p): [x.tobytes() for x in xs] for p, *xs in zip(numbers, *(np.split(c, cuts) for c in columns))}


def asked(parts: int):
    def run(group: pa.Table) -> pa.Table:
        texts = Texts(group, parts)
        n = np.bincount(texts.at[texts.train], minlength=len(texts.words)).astype("<u4")
        pair_n = np.bincount(texts.pair_at[texts.train], minlength=len(texts.pairs)).astype("<u4")
        words, pairs = cut(texts.word_part, texts.words, n), cut(texts.pair_part, texts.pairs, pair_n)
        grp, none = one(group, "grp"), [b"", b""]
        rows = [(grp, p, *words.get(p, none), *pairs.get(p, none)) for p in sorted({*words, *pairs})]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ASKED)], schema=ASKED)

    return run


def added(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(for each sender the sums of its keys, the sum of each distinct key)."""
    sent = [np.frombuffer(k, "<u8") for k in keys]
    distinct, at = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(at, np.frombuffer(b"".join(counts), "<u4"), len(distinct)).astype("<i8")
    return [x.tobytes() for x in np.split(np.minimum(total, 2**32 - 1).astype("<u4")[at], np.cumsum([len(x) for x in sent])[:-1])], total


def answered(table: pa.Table) -> pa.Table:
    columns = {c: table.column(c).to_pylist() for c in ("words", "word_counts", "pairs", "pair_counts")}
    words, total = added(columns["words"], columns["word_counts"])
    pairs, _ = added(columns["pairs"], columns["pair_counts"])
    facts = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
    rest = [None] * (len(words) - 1)
    return pa.table(
        [table.column("grp"), table.column("part"), pa.array(words, pa.binary()), pa.array(pairs, pa.binary()), *(pa.array([f, *rest], pa.int64()) for f in facts)],
        names=["grp", "part", "word_counts", "pair_counts", *FACTS])


def log_probabilities(word, state, pair, total: int, kinds: int, discount: float, grid) -> np.ndarray:
    """log10 of the arcs' (or failure paths') weights for tokens with these counts; a row for each K."""
    if not total:
        return np.zeros((len(grid), len(word)))
    root = np.where(word > 0, (word - discount) / total, discount * kinds / total)
    return np.stack([np.log10((pair + k * root) / (state + k)) for k in grid])


def score(docs: DataFrame, fold: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.coalesce(crc_mod(F.col("doc_id"), fold) == held, F.lit(False))
    table = dealt(docs, "scoring").withColumn("train", ~held_out)
    id_type = table.schema["doc_id"].dataType.simpleString()
    parts = destinations(table)
    by_group = table.groupBy("grp")
    answers = written(by_group.applyInArrow(asked(parts), _ASKED).groupBy("part").applyInArrow(answered, _ANSWER), "scoring-answers")
    facts = answers.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FACTS]).first()
    total, kinds = facts["total"], facts["kinds"]
    discount = min(0.9, max(0.1, facts["once"] / max(1, facts["once"] + 2 * facts["twice"])))

    def read(group: pa.Table, replies: pa.Table) -> pa.Table:
        lists = pa.list_(pa.float64())
        schema = pa.schema([("doc_id", group.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("scores", lists), ("left_out", lists)])
        if not group.num_rows:
            return schema.empty_table()
        texts = Texts(group, parts)
        order = np.argsort(replies.column("part").to_numpy())
        gathered = [np.frombuffer(b"".join(replies.column(c).take(pa.array(order)).to_pylist()), "<u4").astype(float) for c in ("word_counts", "pair_counts")]
        n, pair = gathered[0], gathered[1][texts.pair_at]
        n[texts.start] = n[texts.end]  # as many starts as ends
        word, state = n[texts.at], n[texts.state]
        known = (word > 0).astype(np.int64)
        base = np.log10((word + 0.5) / (total + 0.5 * (kinds + 1)))
        add = lambda x: np.add.reduceat(x, texts.starts, axis=-1)
        scores = add(log_probabilities(word, state, pair, total, kinds, discount, GRID))
        # each training token from the other tokens' counts
        left = np.where(texts.train, log_probabilities(*(np.maximum(x - 1, 0) for x in (word, state, pair)), total, kinds, discount, GRID), 0)
        rows = [pa.ListArray.from_arrays(pa.array(np.arange(len(texts.sizes) + 1, dtype=np.int32) * len(GRID)), pa.array(x.T.ravel())) for x in (scores, add(left))]
        return pa.table([group.column("doc_id"), pa.array(texts.sizes), pa.array(add(known)), pa.array(add(base)), *rows], schema=schema)

    columns = f"doc_id {id_type}, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"
    scored = written(by_group.cogroup(answers.drop(*FACTS).groupBy("grp")).applyInArrow(read, columns), "scoring-scores")
    sums = scored.agg(*[F.coalesce(F.sum(F.col("left_out")[i]), F.lit(0.0)).alias(str(i)) for i in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda i: sums[i])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))
