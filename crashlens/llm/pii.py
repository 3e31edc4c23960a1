"""Personal data: pattern spans plus spans that a conditional random field adds.

The patterns find emails, ip addresses, card and phone numbers in whole texts.
The field is trained from a small labelled table of word sequences: by default the
sentences of :mod:`pii_labels`, which also mark shapes that no pattern knows (phone
numbers without a plus sign, secrets such as access keys and hashes); any other table
can be given, and :func:`labelled_windows` makes one of the documents' own pattern spans.
Its features are word shapes.  What it finds beside the pattern spans is added.

A word without digit, at sign and plus sign is always outside a span (a
constraint of the field).  So a text falls into runs of other words between such
words, and Viterbi over the runs gives the best labels of the whole text.

Spans are (kind, start, end) in code points.  Edge cases: null and empty texts
have no span; rows are independent; the work is linear in the length of a text;
an empty labelled table adds no span; an empty table of documents gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm import crf, pii_labels
from crashlens.llm.common import as_batch, plain, slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: those of the patterns, then what only the field finds.
SPAN_KINDS = (*KINDS, "secret")
LABELS = ["O", *(f"{p}-{k}" for k in SPAN_KINDS for p in "BI")]

# Fixed patterns.  Possessive forms of the given ones: what follows a run can never
# be a part of it, so giving characters back would not help.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BLANK = " \t\n\x0b\x0c\r"
_SPACE = frozenset(_BLANK)
_TELLING = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards: the run of local characters before it, the domain after."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(int(x[:10]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def telling_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words (start, end) that hold a digit, an at sign or a plus sign."""
    runs: list[list[tuple[int, int]]] = []
    end = -1
    m = _TELLING.search(text)
    while m:
        a = m.start()
        while a > end + 1 and a > 0 and text[a - 1] not in _SPACE:
            a -= 1
        b = m.end()
        while b < len(text) and text[b] not in _SPACE:
            b += 1
        between = end if end >= 0 else a
        while 0 <= end and between < a and text[between] in _SPACE:
            between += 1
        if runs and between == a:
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
        end = b
        m = _TELLING.search(text, b)
    return runs


def word_labels(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[str]:
    """Labels of words from spans: the first span that a word touches names it."""
    out, last, lo = [], None, 0
    for a, b in words:
        while lo < len(spans) and spans[lo][2] <= a:
            lo += 1
        span = None
        for i in range(lo, len(spans)):
            if spans[i][0] >= b:
                break
            if a < spans[i][2]:
                span = spans[i]
                break
        out.append("O" if span is None else f"{'I' if span is last else 'B'}-{SPAN_KINDS[span[1]]}")
        last = span
    return out


def inked(text: str) -> tuple[int, int]:
    """Where the text begins and ends without blanks."""
    return len(text) - len(text.lstrip(_BLANK)), len(text.rstrip(_BLANK))


def window(text: str, words: list[tuple[int, int]], spans: list[tuple[int, int, int]], ends: tuple[int, int]) -> tuple[tuple, tuple]:
    """(words, labels) of a run and the plain words beside it; every word as its shape."""
    before = ["x"] * (words[0][0] > ends[0])
    after = ["x"] * (words[-1][1] < ends[1])
    shapes = [crf.shape(text[a:b]) for a, b in words]
    return (*before, *shapes, *after), (*("O" for _ in before), *word_labels(words, spans), *("O" for _ in after))


def shipped_windows() -> list[tuple[tuple, tuple]]:
    """(words, labels) of the sentences of :mod:`pii_labels`."""
    out: dict[tuple, None] = {}
    for text, spans in pii_labels.sentences():
        marked = sorted((a, SPAN_KINDS.index(kind), b) for kind, a, b in spans)
        for words in telling_runs(text):
            out.setdefault(window(text, words, marked, inked(text)))
    return list(out)


@cache
def shipped_model() -> crf.Crf:
    return trained(shipped_windows())


def trained(windows: list) -> crf.Crf:
    return crf.train([(list(w), list(k)) for w, k in windows] + [(["x", "x"], ["O", "O"])], LABELS)


def labelled_windows(docs: DataFrame, max_train: int) -> DataFrame:
    """A labelled table of the pattern spans of at most ``max_train`` documents (those whose id
    hashes lowest) that hold a digit, an at or a plus sign: words array<string>, labels
    array<string>.  Of a run of such words the first 64 make its window."""
    marked = plain(docs).where(F.col("text").rlike("[0-9@+]"))
    sample = marked.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = marked.join(F.broadcast(sample), "doc_id")  # at most max_train ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("words", pa.list_(pa.string())), ("labels", pa.list_(pa.string()))])
        for batch in slices(batches):
            found: dict[tuple, None] = {}
            for text in batch.column("text").to_pylist():
                spans, ends = base_spans(text), inked(text)
                for words in telling_runs(text):
                    found.setdefault(window(text, words[:64], spans, ends))
            yield as_batch(schema, [list(k[0]) for k in found], [list(k[1]) for k in found])

    return rows.mapInArrow(run, "words array<string>, labels array<string>")


def fit(windows: DataFrame, max_windows: int = 2_000) -> crf.Crf:
    """A field from a table of (words, labels); at most ``max_windows`` of its distinct rows."""
    rows = windows.groupBy("words", "labels").count().orderBy(F.xxhash64("words", "labels"), "words", "labels").limit(max_windows).toPandas()
    return trained(list(zip(rows["words"], rows["labels"])))


def added_spans(model: crf.Crf, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the best labels that touch no pattern span."""
    runs = [(i, words) for i, t in enumerate(texts) for words in telling_runs(t)]
    if not runs:
        return [[] for _ in texts]
    known: dict[str, np.ndarray] = {}

    def emission(word: str) -> np.ndarray:
        s = crf.shape(word)
        if s not in known:
            known[s] = model.emission(word)
        return known[s]

    outside, edge = 0, len(LABELS)
    ends = [inked(t) for t in texts]
    first = [outside if w[0][0] > ends[i][0] else edge for i, w in runs]
    last = [outside if w[-1][1] < ends[i][1] else edge for i, w in runs]
    starts = [[s for s, _, _ in spans] for spans in base]
    reach = [list(accumulate((e for _, _, e in spans), max)) for spans in base]  # furthest end so far
    paths = crf.decode(model, [np.stack([emission(texts[i][a:b]) for a, b in w]) for i, w in runs], first, last)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, words), path in zip(runs, paths):
        spans: list[list[int]] = []
        inside = -1
        for (a, b), label in zip(words, path):
            kind = (label - 1) // 2 if label else -1
            if kind >= 0 and label % 2 == 0 and inside == kind:
                spans[-1][2] = b
            elif kind >= 0:
                spans.append([a, kind, b])
            inside = kind
        for a, kind, b in spans:
            while b > a and not (texts[i][b - 1].isalnum()):
                b -= 1
            while a < b and not (texts[i][a].isalnum() or texts[i][a] in "+("):
                a += 1
            before = bisect_left(starts[i], b)
            if a < b and not (before and reach[i][before - 1] > a):
                out[i].append((a, kind, b))
    return out


def spans_of(model: crf.Crf, texts: list[str]) -> tuple[list, list]:
    """(pattern spans, all spans) of each text."""
    base = [base_spans(t) if _TELLING.search(t) else [] for t in texts]
    return base, [sorted(b + a) for b, a in zip(base, added_spans(model, texts, base))]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """doc_id, n_<kind> of the pattern spans, base_sha256 of them, spans (all), n_added (of
    the spans that only the field found)."""
    source = plain(docs)
    model = shipped_model() if windows is None else fit(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, every = spans_of(model, batch.column("text").to_pylist())
            counts = [[sum(s[1] == k for s in spans) for spans in base] for k in range(len(KINDS))]
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
            digests = [hashlib.sha256(spelled(s).encode()).hexdigest() for s in base]
            yield as_batch(schema, batch.column("doc_id"), *counts, digests, [spelled(s) for s in every], [len(e) - len(b) for b, e in zip(base, every)])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that
    overlap become one, named by the first."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{SPAN_KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def mask(docs: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """The documents, all columns, with the spans masked in ``text`` (null stays null)."""
    model = shipped_model() if windows is None else fit(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            spans = spans_of(model, [t or "" for t in texts])[1]
            at = batch.schema.get_field_index("text")
            new = pa.array([None if t is None else masked(t, s) for t, s in zip(texts, spans)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
