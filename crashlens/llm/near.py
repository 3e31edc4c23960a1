"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of shingles of five words.  Each occurrence is labelled
with its number among equal shingles; for each of ``SKETCHES`` hash functions the
``PICKED`` smallest occurrences, in text order, make a key.  Texts that share a
key are candidates, if they agree in at least ``AGREE`` keys (a pair with a
similarity of 0.8 fails that with a chance of 2 in 100,000) and their lengths allow
the similarity.  A pair is linked if its similarity is 0.8 or more: with M
the longest common subsequence of the two shingle sequences, M / (a + b - M).  At
that similarity no aligned pair lies further from the diagonal than (a + b) / 9,
so an alignment inside that band is exact.  Texts below five words are one
shingle.

Equal texts are one node from the start, so copies cost one row each.  Links are only
kept as the component of each node: the links that a step adds are links between
components, so they are few after the first step.  Three steps compare a number of pairs
linear in the size of the buckets: each member with the best of its buckets'
leaders; then with the other leaders, where these belong to other components; then, in
every bucket that still holds several components, members of different components that are
near in a drawn order (all pairs where a bucket has at most ``NEIGHBOURS`` + 1 members).
These steps leave little to the last one, which is exact for the larger buckets: each
that still holds several components is taken whole, or where it has more than ``BLOCK``
members split by each further key of its members (a pair needs ``AGREE`` = 2), and in what
then still holds several components all pairs of different components are held against each other, block by block, by their
keys, lengths and a count of shingles in ``BINS`` bins (whose overlap is at least that of
the shingles, so no link is lost).  The pairs that remain are aligned where their blocks meet, unless a link
found there has joined their components, and only links leave the task: at most one for each
member, however many pairs were tested.  So every pair of candidates is tested or in one component already.  A class is a connected
component of links.  Tables that a later step replaces are deleted.

Edge cases: a null text counts as empty; empty texts are equal texts; repeated
rows belong to one class and carry the same result; a row with a null id is in
no class (null class, kept); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import as_batch, discard, slices, written
from crashlens.llm.groups import WordValues, mixed, window_values, word_values

WORDS, SKETCHES, PICKED, AGREE = 5, 20, 3, 2
#: Least similarity of a link.
LEAST = 0.8
#: Members compared with each one by drawn order, and members of a block of a large bucket.
NEIGHBOURS, BLOCK = 3, 4096
#: Bins of shingles, one byte each; rows of a block that the exact pass compares at a time.
BINS, STRIP = 1024, 128
#: Bytes of text that a Python worker handles at a time, and of shingles in a block (or one member).
SLICE, BLOCK_BYTES = 2 << 20, 32 << 20

_SEEDS = np.random.default_rng(20).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(values: np.ndarray) -> np.ndarray:
    """Shingle values of a text's word values."""
    n = len(values)
    if not n:
        return values
    return window_values(values, min(WORDS, n))[: max(1, n - WORDS + 1)] + np.uint64(min(n, WORDS))


def sketch(x: np.ndarray) -> list[int]:
    """One key for each hash function, as signed 64-bit numbers."""
    if not len(x):
        return []
    order = np.argsort(x, kind="stable")
    same = np.concatenate([[False], x[order][1:] == x[order][:-1]])
    at = np.arange(len(x))
    number = np.empty(len(x), np.int64)
    number[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    labelled = mixed(x + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    take = min(PICKED, len(x))
    out: list[int] = []
    for seeds in np.array_split(_SEEDS, 1 if len(x) < 100_000 else SKETCHES):
        z = labelled[None, :] * seeds[:, None]  # the labels are scrambled already
        lowest = np.sort(np.argpartition(z, take - 1, axis=1)[:, :take], axis=1)
        out += [xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63) for values in x[lowest]]
    return out


def common_length(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence with aligned positions at most ``band`` apart."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n -= head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = hi - lo
    met = np.flatnonzero(count)
    if count.max() <= 1:  # at most one partner each: in order and near enough, all of them align
        to = order[lo[met]]
        if (np.diff(to) > 0).all() and (abs(to - met) <= band).all():
            return head + tail + len(met)
    # bit-parallel alignment: bit j of `row` is 0 where the best length grows at b[j]
    masks: dict[int, int] = {}
    for value, j in zip(b.tolist(), range(len(b))):
        masks[value] = masks.get(value, 0) | 1 << j
    everything = row = (1 << len(b)) - 1
    near = (1 << (2 * band + 1)) - 1
    for i in met.tolist():
        match = masks[int(a[i])] & (near << (i - band) if i >= band else near >> (band - i))
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & everything
    return head + tail + len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Of two shingle sequences; 0 where a bound shows it to be below ``least``."""
    whole = len(a) + len(b)
    if not whole or min(len(a), len(b)) < least * max(len(a), len(b)):
        return float(not whole)
    both, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = int(np.minimum(np.bincount(n[: len(a)], minlength=len(both)), np.bincount(n[len(a) :], minlength=len(both))).sum())
    if shared < least * (whole - shared):
        return 0.0
    most = common_length(a, b, int(whole * (1 - least) / (1 + least)) + 1)
    return most / (whole - most)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n (shingles), keys of every row with an id."""
    source = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordValues()
        for batch in slices(batches, most=SLICE):
            if len(known) > 100_000:
                known.clear()
            values, sizes = word_values([t.encode() for t in batch.column("text").to_pylist()], known)
            parts = [shingles(v) for v in np.split(values, np.cumsum(sizes)[:-1])]
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("digest", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])
            yield as_batch(schema, batch.column("doc_id"), batch.column("digest"), [len(x) for x in parts], [sketch(x) for x in parts])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, digest binary, n int, keys array<long>")


def texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id IS NOT NULL").select("doc_id", text_digest(text).alias("digest"), text.alias("text"))


def text_digest(text):
    """16 bytes of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def alike(one, other):
    """Whether two members agree in enough keys (by two bytes of each) and in length."""
    same = [(F.substring(one["marks"], 2 * i + 1, 2) == F.substring(other["marks"], 2 * i + 1, 2)).cast("int") for i in range(SKETCHES)]
    return (sum(same[1:], same[0]) >= AGREE) & (F.least(one["n"], other["n"]) >= LEAST * F.greatest(one["n"], other["n"]))


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough."""
    left = bodies.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in slices(batches, "text_b", SLICE):
            for batch in slices([wide], "text_a", SLICE):
                found: dict[str, np.ndarray] = {}
                columns = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
                for t in {*columns[0], *columns[1]}:
                    found[t] = shingles(word_values([t.encode()], WordValues())[0])
                good = pa.array([similarity(found[x], found[y], LEAST) >= LEAST for x, y in zip(*columns)], pa.bool_())
                yield batch.select(["a", "b"]).filter(good)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, comp (least node of its component) of every node with a link: least labels
    over links until nothing changes, from the third turn on also over labels, which
    makes long chains short."""
    edges = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    comp = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("c")).select("node", F.least("node", "c").alias("comp"), F.lit(0).alias("moved"))
    comp, turn = written(comp, "near-components"), 0
    while True:
        turn += 1
        sent = edges.join(comp, edges["b"] == comp["node"]).select(F.col("a").alias("node"), F.col("comp"), F.lit(None).cast("binary").alias("old"))
        every = sent.unionAll(comp.select("node", "comp", F.col("comp").alias("old")))
        step = every.groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        if turn > 2:
            up = comp.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
            step = step.join(up, step["comp"] == up["n2"]).select("node", F.least("comp", "c2").alias("comp"), "old")
        before = comp
        comp = written(step.select("node", "comp", (F.col("comp") != F.col("old")).cast("int").alias("moved")), "near-components")
        discard(before)
        if comp.where("moved > 0").isEmpty():
            discard(edges)
            return comp


def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, comp of all nodes linked so far: ``links`` become links between the components
    of ``comp`` (None before the first), whose components replace them."""
    if comp is None:
        return components(links)
    for end in ("a", "b"):
        names = comp.select(F.col("node").alias(end), F.col("comp").alias("label"))
        links = links.join(names, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    found = components(links.where("a <> b"))
    up = found.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = comp.join(up, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    alone = found.join(comp.select("node"), "node", "left_anti").select("node", "comp")
    after = written(moved.unionAll(alone), "near-components")
    discard(comp, found)
    return after


MEMBER = ("digest", "n", "marks")


def ordered(one, other) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def leader_pairs(members: DataFrame) -> DataFrame:
    """a, b, best: each member with its buckets' leaders; ``best`` marks the member's first.

    The leader is the member that shares the most bucket places.  The text that the
    others were copied from is the one closest to all of them, so it leads its buckets.
    """
    leaders = members.groupBy("s", "key").agg(F.max(F.struct("shared", *MEMBER)).alias("leader"))
    met = members.join(leaders, ["s", "key"]).where((F.col("digest") != F.col("leader.digest")) & alike(F.struct(*MEMBER), F.col("leader")))
    mine = met.groupBy("digest").agg(F.collect_set(F.struct("leader.shared", F.col("leader.digest").alias("to"))).alias("led"))  # SKETCHES at most
    each = mine.select("digest", F.array_max("led").alias("first"), F.explode("led").alias("one"))
    pairs = each.select(*ordered("digest", "one.to"), (F.col("one") == F.col("first")).alias("best"))
    return pairs.groupBy("a", "b").agg(F.max("best").alias("best"))


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    one = comp.select(F.col("node").alias("a"), F.col("comp").alias("x"))
    other = comp.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    named = pairs.join(one, "a", "left").join(other, "b", "left")
    return named.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp, members["digest"] == comp["node"], "left").select(*members.columns, F.coalesce("comp", "digest").alias("comp"))


def neighbour_pairs(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of different components near each other in a drawn order of each bucket: all
    such pairs where the bucket has at most ``NEIGHBOURS`` + 1 members."""
    own = labelled(members, comp)
    several = own.groupBy("s", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y")
    placed = own.join(several.select("s", "key", "size"), ["s", "key"]).withColumn("drawn", F.xxhash64("digest", "s"))
    placed = placed.withColumn("block", F.pmod("drawn", F.ceil(F.col("size") / BLOCK)))
    order = Window.partitionBy("s", "key", "block").orderBy("drawn", "digest")
    following = F.collect_list(F.struct(*MEMBER, "comp")).over(order.rowsBetween(1, NEIGHBOURS))
    met = placed.select(F.struct(*MEMBER, "comp").alias("one"), following.alias("following"))
    fitting = F.filter("following", lambda other: (F.col("one.comp") != other["comp"]) & alike(F.col("one"), other))
    pairs = met.select(F.col("one.digest").alias("digest"), F.explode(fitting).alias("other"))
    return pairs.select("digest", F.col("other.digest").alias("to")).select(*ordered("digest", "to")).distinct()


def binned(x: np.ndarray) -> bytes:
    """Shingles by bin; 255 stands for that many or more."""
    bins = np.bincount((mixed(x) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.minimum(bins, 255).astype(np.uint8).tobytes()


def profiles(wanted: DataFrame, nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """digest, n, keys and shingles as bytes, of the wanted digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            found = [shingles(word_values([t.encode()], WordValues())[0]).tobytes() for t in batch.column("text").to_pylist()]
            schema = pa.schema([("digest", pa.binary()), ("shingles", pa.binary())])
            yield as_batch(schema, batch.column("digest"), found)

    counted = bodies.join(wanted.hint("merge"), "digest", "left_semi").select("digest", "text").mapInArrow(run, "digest binary, shingles binary")
    keys = F.unhex(F.array_join(F.transform("keys", lambda k: F.lpad(F.hex(k), 16, "0")), "")).alias("keys")
    return counted.join(nodes.select("digest", "n", keys), "digest")


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("own", "ascending"), ("digest", "ascending")]).combine_chunks()


def fitting(table: pa.Table, comp: np.ndarray, bins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of a part's two blocks (or inside its one block) that can be
    similar, some at a time; ``comp``, the members' components, may change in between.

    A pair is told only where the part's two keys are the first two that it shares, or, in
    a whole bucket (s2 = s), where its key is the first and another follows."""
    s, s2 = table.column("s")[0].as_py(), table.column("s2")[0].as_py()
    two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    m = table.num_rows
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(m, SKETCHES).T.copy()
    n = table.column("n").to_numpy().astype(np.int64)
    # two blocks: members of the first against those of the second; one: against those that follow
    first = int((table.column("own").to_numpy() == table.column("lo")[0].as_py()).sum()) if two else m
    for start in range(0, first, STRIP):
        stop, rest = min(start + STRIP, first), first if two else start
        one, other = slice(start, stop), slice(rest, m)
        good = comp[one, None] != comp[None, other]
        good &= np.minimum(n[one, None], n[None, other]) >= LEAST * np.maximum(n[one, None], n[None, other])
        for k in range(s2):
            if k != s:
                good &= keys[k, one, None] != keys[k, None, other]
        if s2 == s:
            another = np.zeros_like(good)
            for k in range(s + 1, SKETCHES):
                another |= keys[k, one, None] == keys[k, None, other]
            good &= another
        x, y = np.nonzero(good)
        x, y = x + start, y + rest
        if not two:
            x, y = x[x < y], y[x < y]
        for at in range(0, len(x), 1 << 12):
            i, j = x[at : at + (1 << 12)], y[at : at + (1 << 12)]
            least = np.minimum(bins[i], bins[j])
            shared, whole = least.sum(axis=1, dtype=np.int64), n[i] + n[j]
            stays = (shared >= LEAST * (whole - shared)) | (least == 255).any(axis=1)
            yield i[stays], j[stays]


def numbered(table: pa.Table) -> np.ndarray:
    return table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy().copy()


def named(table: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
    """a, b: the digests of pairs of places."""
    digests = table.column("digest").to_pylist()
    ends = [sorted((digests[p], digests[q])) for p, q in pairs]
    return pa.table([pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.binary())], names=["a", "b"])


def possible(table: pa.Table) -> pa.Table:
    """All pairs (a, b) that :func:`fitting` tells of a part with the members' ``bins``."""
    table = in_order(table)
    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
    return named(table, [p for i, j in fitting(table, numbered(table), bins) for p in zip(i.tolist(), j.tolist())])


def linking(table: pa.Table) -> pa.Table:
    """Links (a, b) of a part with the members' ``shingles``: a pair that can be similar is aligned
    unless the links before it have joined its components."""
    table = in_order(table)
    values = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
    bins = np.frombuffer(b"".join(binned(x) for x in values), np.uint8).reshape(-1, BINS)
    comp, links = numbered(table), []
    for i, j in fitting(table, comp, bins):
        for p, q in zip(i.tolist(), j.tolist()):
            if comp[p] != comp[q] and similarity(values[p], values[q], LEAST) >= LEAST:
                comp[comp == comp[q]] = comp[p]
                links.append((p, q))
    return named(table, links)


def exact_links(members: DataFrame, comp: DataFrame, nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links of different components in the buckets of more than ``NEIGHBOURS`` + 1 members: what
    they join holds every pair of candidates there that is similar.

    A bucket of at most ``BLOCK`` members is a part as it is (s2 = s).  A larger one is
    split into parts by every later key (sketch s2) of its members: two that
    agree in two keys meet in a part.  A part of several blocks sends each member to as
    many groups as it has blocks, one for each pair of blocks, so no group holds more than
    about two blocks, each of about ``BLOCK`` members and ``BLOCK_BYTES`` of shingles at most."""
    own = labelled(members, comp).select("s", "key", "digest", "n", "comp")
    several = own.groupBy("s", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"), F.sum(F.lit(8) * F.col("n")).alias("bytes"))
    several = several.where((F.col("x") != F.col("y")) & (F.col("size") > NEIGHBOURS + 1))
    large = written(own.join(several.select("s", "key", "size", "bytes"), ["s", "key"]), "near-large")
    part = ["s", "key", "s2", "key2"]
    whole = large.where(F.col("size") <= BLOCK).select("s", "key", F.col("s").alias("s2"), F.col("key").alias("key2"), "digest", "comp", F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    later = large.where(F.col("size") > BLOCK).drop("size", "bytes").join(members.select("digest", F.col("s").alias("s2"), F.col("key").alias("key2")), "digest").where("s2 > s")
    later = written(later, "near-parts")
    sizes = later.groupBy(*part).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"), F.sum(F.lit(8) * F.col("n")).alias("bytes"))
    sizes = sizes.where("x <> y").select(*part, F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    placed = written(whole.unionByName(later.drop("n").join(sizes, part)), "near-placed")
    discard(later, large)
    placed = placed.join(profiles(placed.select("digest").distinct(), nodes, bodies), "digest")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("digest", "s"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select(*part, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "digest", "n", "comp", "keys", "shingles")
    return placed.groupBy(*part, "lo", "hi").applyInArrow(linking, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest of its text, class_id (least doc_id of the
    class), class_size, kept."""
    rows = written(sketched(docs), "near-sketches")
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    marks = F.unhex(F.array_join(F.transform("keys", lambda k: F.lpad(F.hex(F.shiftrightunsigned(k, 48)), 4, "0")), ""))
    placed = nodes.select("digest", "n", marks.alias("marks"), F.posexplode("keys").alias("s", "key"))
    sizes = placed.groupBy("s", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(placed.join(sizes, ["s", "key"]), "near-buckets")
    shared = members.groupBy("digest").agg(F.sum("size").alias("shared"))
    buckets = members
    members = written(members.drop("size").join(shared, "digest"), "near-members")
    discard(buckets)
    wanted = nodes.select("digest", "rep").join(members.select("digest").distinct(), "digest").select(F.col("digest").alias("d"), "rep")
    source = texts(docs)
    # the wanted texts grow with the corpus: a shuffle join at every size
    bodies = source.join(wanted.hint("merge"), (source["doc_id"] == wanted["rep"]) & (source["digest"] == wanted["d"]), "left_semi")
    bodies = written(bodies.select("digest", "text").dropDuplicates(["digest"]), "near-texts")
    led = written(leader_pairs(members), "near-pairs")
    links = written(verified(led.where("best").drop("best"), bodies), "near-links")
    comp = joined(None, links)
    discard(links)
    links = written(verified(apart(led.where("NOT best"), comp), bodies), "near-links")
    if not links.isEmpty():
        comp = joined(comp, links)
    discard(links)
    near_by = written(neighbour_pairs(members, comp).join(led, ["a", "b"], "left_anti"), "near-pairs")
    links = written(verified(near_by, bodies), "near-links")
    if not links.isEmpty():
        comp = joined(comp, links)
    discard(links)
    links = written(exact_links(members, comp, nodes, bodies).distinct(), "near-links")
    if not links.isEmpty():
        comp = joined(comp, links)
    discard(links, members, bodies, led, near_by)
    own = rows.join(comp, rows["digest"] == comp["node"], "left").select("doc_id", "digest", F.coalesce("comp", "digest").alias("comp"))
    own = written(own, "near-own")
    discard(rows, comp)
    groups = own.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    result = own.join(groups, "comp").select("doc_id", "digest", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    lone = docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return result.unionByName(lone)
