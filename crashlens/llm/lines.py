"""Line dedup: repeated runs of lines found by a suffix array and deleted but for their first copy.

The corpus is one sequence of line ids per document.  Lines that occur once can
lie in no repeated run, so only the others get an id.  Prefix doubling sorts the
suffixes that start there: the rank at depth h+s of line i is that of the pair
(rank at depth h of i, rank at depth h of i+s), and ranks come from a range sort
(``monotonically_increasing_id`` of sorted range partitions, order-preserving
without a global window).  A suffix alone in its rank has no further copy and is
dropped, so each round works on the still repeated part only.

Ranks of depth ``min_lines`` are the intervals of the suffix array whose longest
common prefix is at least that: every deeper interval lies inside one of them,
and the windows of a longer run are members of intervals themselves.  So doubling
stops there, after log2(min_lines) rounds whatever the documents' lengths.  All
members but the first in (doc_id, line) order are later copies; windows that
touch or overlap make up the maximal runs that are deleted.

With ``line_words``, a single line of at least that many words (a paragraph) is a run
of its own whatever its neighbours: all its copies but the first go too.  Shorter lines
that repeat alone stay.

Lines without a word are no part of the sequence; those inside a deleted run go
with it, all others stay.  Edge cases: a
null text counts as empty and is returned as null; repeated rows (same id and
text) count as one document and are edited alike; a null id sorts first; an
empty table gives an empty table.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import discard, written

KEY = ["doc_id", "body"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text: tells rows apart that share an id), lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("body"), F.split(text, "\n", -1).alias("lines"))


def has_word(line):
    return line.rlike(r"[^\x20\x09-\x0D]")


def same_key(left: DataFrame, right: DataFrame, *more):
    on = left["doc_id"].eqNullSafe(right["doc_id"]) & (left["body"] == right["body"])
    for c in more:
        on = on & c
    return on


def long_enough(line_words: int | None) -> list:
    """Whether a line has that many words, if the number is asked for."""
    if line_words is None:
        return []
    return [(F.size(F.filter(F.split("line", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")) >= line_words).alias("long")]


def ranked(members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``members`` (KEY, i, keys) that share their keys with another one, with an
    order-preserving ``rank`` of the keys."""
    groups = members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    order = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    order = written(order, f"{name}-order")
    out = written(members.join(order, keys).select(*KEY, "i", "rank"), name)
    discard(order)
    return out


def repeated_windows(docs: DataFrame, min_lines: int, line_words: int | None = None) -> DataFrame:
    """KEY, i, rank, width of every run of ``min_lines`` lines, and of every line of at
    least ``line_words`` words, that occurs more than once; i numbers a document's lines
    with a word."""
    worded = keyed(docs).select(*KEY, F.filter("lines", has_word).alias("lines"))
    lines = worded.select(*KEY, F.posexplode("lines").alias("i", "line"))
    first = lines.select(*KEY, "i", F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("digest"), *long_enough(line_words))
    digests = written(first, "lines-digests")
    first = digests.distinct()
    at = ranked(first, ["digest"], "lines-rank1")
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        later = at.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), (F.col("i") - step).alias("j"), F.col("rank").alias("second"))
        pairs = at.join(later, at["doc_id"].eqNullSafe(later["d"]) & (at["body"] == later["b"]) & (at["i"] == later["j"]))
        depth += step
        before = at
        at = ranked(pairs.select(*KEY, "i", F.col("rank").alias("head"), "second"), ["head", "second"], f"lines-rank{depth}")
        discard(before)
    found = at.withColumn("width", F.lit(min_lines))
    if line_words is not None:
        found = found.unionByName(ranked(first.where("long"), ["digest"], "lines-single").withColumn("width", F.lit(1)))
    discard(digests)
    return found


def later_copies(windows: DataFrame) -> DataFrame:
    """KEY, runs: the maximal runs of lines to delete as sorted structs (first, last) of i."""
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "body", "i")
    first = windows.groupBy("rank", "width").agg(F.min(place).alias("first"))
    copies = windows.join(first, ["rank", "width"]).where(~place.eqNullSafe(F.col("first")))
    copies = copies.groupBy(*KEY, "i").agg(F.max("width").alias("width"))
    own = Window.partitionBy(*KEY).orderBy("i")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("i") > F.max(F.col("i") + F.col("width")).over(before), F.lit(True))
    runs = copies.select(*KEY, "i", "width", apart.cast("int").alias("apart")).withColumn("run", F.sum("apart").over(own))
    spans = runs.groupBy(*KEY, "run").agg(F.min("i").alias("first"), (F.max(F.col("i") + F.col("width")) - 1).alias("last"))
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def remove_repeats(docs: DataFrame, min_lines: int = 2, line_words: int | None = None) -> DataFrame:
    """The documents with later copies of repeated runs (and single lines of at least
    ``line_words`` words, if given) deleted from ``text``, and
    ``runs`` (null where nothing was deleted), ``n_lines`` and ``n_removed``; the
    last three replace columns of those names."""
    if not {"doc_id", "text"} <= set(docs.columns):
        raise ValueError("documents need doc_id and text")
    found = later_copies(repeated_windows(docs, min_lines, line_words))
    found = written(found.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("runs").alias("__runs")), "lines-runs")
    text = F.coalesce(F.col("text"), F.lit(""))
    # the runs grow with the corpus: a shuffle join at every size, never a broadcast
    rows = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(text) == found["__body"]), "left")
    lines = F.split(text, "\n", -1)
    # positions of the lines with a word, to turn runs of those into runs of all lines
    worded = F.filter(F.transform(lines, lambda x, p: F.when(has_word(x), p)), lambda p: p.isNotNull())
    bounds = F.transform("__runs", lambda r: F.struct(F.get("__worded", r["first"]).alias("first"), F.get("__worded", r["last"]).alias("last")))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("__bounds")),
        lambda k: F.struct(
            F.when(k == 0, 0).otherwise(F.get("__bounds", k - 1)["last"] + 1).alias("start"),
            F.when(k == F.size("__bounds"), F.size("__lines")).otherwise(F.get("__bounds", k)["first"]).alias("stop"),
        ),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("__lines", g["start"] + 1, g["stop"] - g["start"])))
    edited = rows.withColumn("__lines", lines).withColumn("__worded", F.when(F.col("__runs").isNotNull(), worded)).withColumn("__bounds", bounds)
    return (
        edited.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("__lines") - F.size(kept), F.lit(0)).cast("long"))
        .withColumn("runs", F.col("__bounds"))
        .drop("__id", "__body", "__runs", "__lines", "__worded", "__bounds")
    )
