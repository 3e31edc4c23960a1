"""Merkle manifest of a table: one tree per value of a column, proofs by pointer jumping.

Every row is a leaf.  Leaves of a tree ascend by ``order``; a range sort, written
once, and the counts of its partitions number them, so no task holds a tree.
Each level groups ``ARITY`` consecutive nodes under the hash of their digests; the
last nodes of the trees (subroots) are the leaves of one more tree, whose last node
is the root.  Every inner node then holds a pointer to an ancestor (its parent at
first) and the segment of sibling digests on the way there.  A round joins the
nodes with themselves on the pointer, which doubles the distance, and concatenates
the segments, until every pointer is past the root.  A run of leaves shares its
node's segment, so a leaf's proof is its run's other leaves and that segment; the
join moves one row for each run.

Edge cases: a null field counts as the bare mark, also in the tree's column (its
tree comes first) and in ``order`` (first); rows that tie in ``order`` ascend by
their digest, and repeated rows are leaves of their own, next to each other; an
empty text is a field of 0 bytes; a text of any length is hashed inside its row;
a tree with one row has its leaf as subroot and a single tree's subroot is the
root; an empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import written

ARITY = 8
#: Fields of a document, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree over the subroots; names of the others are empty or begin with "=".
TOP = "*"
SIDES = "struct<left: string, right: string>"
NODE = "struct<tree: string, level: int, idx: bigint>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: of each field ``-`` if it is null, else its bytes' count, ``:`` and its value."""
    marked = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*marked).cast("binary"), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def fold(digest: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one text, level by level, left to right."""
    return joined(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``idx`` (from 0 in its tree, in the order of ``order``) and ``n`` (rows of the tree).

    The sorted rows are written with their partition and place; a partition's offset in a
    tree comes from a table of one row for each partition and tree that meet."""
    order = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftrightunsigned("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("n"))
    return placed.join(shifts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def steps(n: int) -> int:
    """Levels above ``n`` leaves."""
    count = 0
    while n > 1:
        n, count = -(-n // ARITY), count + 1
    return count


def runs(nodes: DataFrame, level: int, name: str) -> DataFrame:
    """The next level: tree, level, idx, n, digest, kids (in order, without their numbers)."""
    carried = [c for c in nodes.columns if c not in ("tree", "level", "idx", "n", "kids")]
    up = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("up"))
    kids = up.agg(F.ceil(F.first("n") / ARITY).alias("n"), F.sort_array(F.collect_list(F.struct("idx", *carried))).alias("kids"))
    digest = F.sha2(joined(F.transform("kids", lambda k: k["digest"])).cast("binary"), 256)
    kids = kids.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), "n", digest.alias("digest"), "kids")
    return written(kids, f"{name}{level}")


def levels(leaves: DataFrame, count: int, name: str) -> list[DataFrame]:
    """All levels from the leaves up; a tree is in them until its last node."""
    out = [leaves.withColumn("level", F.lit(0))]
    for level in range(1, count + 1):
        out.append(runs(out[-1], level, name))
    return out


def node(tree: str, level: Column | int, idx: Column | str) -> Column:
    level, idx = F.lit(level) if isinstance(level, int) else level, F.col(idx) if isinstance(idx, str) else idx
    return F.struct(F.col(tree).alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def sides(kids: Column, at: Column) -> Column:
    """Digests of the run beside its member number ``at``."""
    digests = F.transform(kids, lambda k: k["digest"])
    return F.struct(joined(F.slice(digests, F.lit(1), at)).alias("left"), joined(F.slice(digests, at + 2, F.lit(ARITY))).alias("right"))


def members(run: DataFrame) -> DataFrame:
    """One row per member of each run: the run's columns, ``kid`` and ``beside`` (its siblings)."""
    return run.select("*", F.posexplode("kids").alias("place", "kid")).withColumn("beside", sides(F.col("kids"), F.col("place")))


def pointer(rows: DataFrame, own: Column, ptr: Column, path: Column, subroot: Column, root: Column) -> DataFrame:
    return rows.select(own.alias("id"), ptr.alias("ptr"), path.alias("path"), subroot.alias("subroot"), root.alias("root"))


def jumped(nodes: DataFrame, name: str) -> DataFrame:
    """One round of pointer jumping: every pointer goes as far again."""
    far = nodes.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("path").alias("path2"), F.col("subroot").alias("subroot2"), F.col("root").alias("root2"))
    near = nodes.where("ptr IS NOT NULL").join(far, "ptr")
    near = near.select("id", F.col("ptr2").alias("ptr"), F.concat("path", "path2").alias("path"),
                       F.coalesce("subroot", "subroot2").alias("subroot"), F.coalesce("root", "root2").alias("root"))
    return written(nodes.where("ptr IS NULL").unionByName(near), name)


def prove(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", order: str = "doc_id",
          claims: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``order``'s column, leaf, subroot, root, proof (an array of the
    sibling digests left and right of the path, from the leaf up) and claimed (the digest of the
    row with the values of ``claims`` in place of its own; :func:`fold` tells the root they lead to)."""
    claimed = {**{f: F.col(f) for f in fields}, **(claims or {})}
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    rows = docs.select(name.alias("tree"), F.col(order).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"),
                       leaf([claimed[f] for f in fields]).alias("claimed"))
    # repeated rows are told apart, so that a range sort can part them
    rows = written(rows.withColumn("nth", F.monotonically_increasing_id()), "manifest-leaves")
    leaves = numbered(rows, ["key", "digest", "nth"], "manifest-sorted").drop("nth")
    trees, most = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()

    below = levels(leaves, steps(most), "manifest-level")
    subroots = below[0].where("n = 1").select("tree", "level", "digest")
    for t in below[1:]:
        subroots = subroots.unionByName(t.where("n = 1").select("tree", "level", "digest"))
    ranked = numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("level").alias("height"), "digest"), ["of"], "manifest-subroots")
    above = levels(ranked, steps(trees), "manifest-top")

    digest, absent, here = F.col("kid.digest"), F.lit(None).cast("string"), F.array("beside")
    parent = node("tree", F.col("level"), "idx")  # of a member of a run
    nodes = [pointer(members(t), node("tree", F.col("level") - 1, "kid.idx"), parent, here, absent, absent) for t in below[2:]]
    nodes += [pointer(members(t), node("kid.of", F.col("kid.height"), F.lit(0)), parent, here, digest, absent) for t in above[1:2]]
    nodes += [pointer(members(t), node("tree", F.col("level") - 1, "kid.idx"), parent, here, absent, absent) for t in above[2:]]
    past, none = F.lit(None).cast(NODE), F.array().cast(f"array<{SIDES}>")
    if trees > 1:
        nodes.append(pointer(above[-1], node("tree", F.col("level"), "idx"), past, none, absent, F.col("digest")))
    else:
        nodes.append(pointer(ranked, node("of", F.col("height"), F.lit(0)), past, none, F.col("digest"), F.col("digest")))
    paths = written(reduce(DataFrame.unionByName, nodes), "manifest-pointers")
    edges = max(steps(most) - 1, 0) + steps(trees)  # from a run of leaves to the root
    for _ in range(edges.bit_length()):
        paths = jumped(paths, "manifest-paths")

    kid = F.struct("idx", "key", "digest", "claimed")
    alone = below[0].where("n = 1").select(node("tree", 0, "idx").alias("id"), F.array(kid).alias("kids"), F.lit(False).alias("in_run"))
    bases = alone if most < 2 else alone.unionByName(below[1].select(
        node("tree", 1, "idx").alias("id"), F.transform("kids", lambda k: F.struct(*(k[c].alias(c) for c in ("idx", "key", "digest", "claimed")))).alias("kids"), F.lit(True).alias("in_run")))
    each = members(bases.join(paths, "id"))
    proof = F.when(F.col("in_run"), F.concat(here, F.col("path"))).otherwise(F.col("path"))
    return each.select(F.col("kid.key").alias(order), F.col("kid.digest").alias("leaf"), "subroot", "root", proof.alias("proof"), F.col("kid.claimed").alias("claimed"))
