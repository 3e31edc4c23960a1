"""Manifest, periodic runs and top-k search against brute force, and on awkward tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crashlens.llm import manifest, periodic, queries, search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(12_000)) + " x y z" * 400


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(n):
    texts = [None, "", "One Two", "é漢 Ü", " \t\n", LONG, "a " * 40]
    rows = [(i, texts[i % 7] if i % 3 else f"Text {i}", ["en", "en", "de", None, "é"][i % 5] if i != 4 else "lone", "web" if i % 2 else None, i or None) for i in range(n)]
    return rows + [rows[2], rows[2], (None, "No Id", "en", None, None), (None, None, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("leaf", "tree", "idx", "kids", "runs", "n", "proof")}).repartition(4)


# ---- manifest

def brute_tree(digests):
    """(last digest, siblings of each leaf by level)."""
    level, owners, proofs = list(digests), [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), 8):
            run = level[a:a + 8]
            for j in range(len(run)):
                for o in owners[a + j]:
                    proofs[o].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha("".join(run)))
            up_owners.append([o for os in owners[a:a + 8] for o in os])
        level, owners = up, up_owners
    return level[0], proofs


def brute_manifest(rows):
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(mark, (r[0], r[3], r[2], r[4], text))))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    if not rows:
        return Counter()
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: brute_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in order}
    root, tops = brute_tree([made[k][0] for k in order])
    out = Counter()
    for k, top in zip(order, tops):
        for (_, _, digest, r), proof in zip(sorted(trees[k], key=lambda x: x[:3]), made[k][1]):
            path = proof + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            folded = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1])
            for left, right in path:
                folded = sha(left + folded + right)
            out[(r[0], digest, made[k][0], root, sha("".join(a + b for a, b in path)), folded, folded == root)] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_manifest(spark, tmp_path, n):
    rows = rows_of(n) if n > 1 else rows_of(3)[:n]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_manifest(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == brute_manifest(rows)


@pytest.mark.parametrize("n", [8, 64, 65, 513])
def test_manifest_one_tree(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    got = manifest.prove(docs).withColumn("folded", manifest.fold(F.col("claimed"), F.col("proof"))).collect()
    assert len(got) == n and all(r["folded"] == r["root"] == r["subroot"] for r in got)
    depth = math.ceil(math.log(n, 8) - 1e-9)
    assert {len(r["proof"]) for r in got} == {depth}


# ---- periodic runs

def brute_runs(x, least=12):
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q) and i > s:
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = np.random.default_rng(5)
    for _ in range(400):
        x = r.integers(0, r.integers(1, 7), r.integers(0, 100)).tolist()
        for _ in range(r.integers(0, 3)):
            if len(x) > 20:
                a = int(r.integers(0, len(x) - 1))
                p = 1 + int(r.integers(0, max(1, (len(x) - a) // 3)))
                for i in range(a, int(r.integers(a, len(x)))):
                    x[i] = x[a + (i - a) % p]
        w = [b"%d" % v for v in x]
        assert periodic.runs_of([[b"z"], w, [], w[::-1]])[1] == brute_runs(x)


def test_runs_that_repeat_themselves():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs_of([b])[0] == brute_runs(b)
    assert periodic.runs_of([[b"a"] * 300_000])[0] == [(0, 300_000, 1)]


def brute_periodic(rows):
    out = Counter()
    for r in rows:
        words = (r[1] or "").encode().split()
        n = len(words)
        if n and r[0] is not None and (h := zlib.crc32(str(r[0]).encode())) % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words) if n < 3000 else periodic.runs_of([words])[0]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        out[(r[0], len(runs), s, length, q, 1000 * length // q if q else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
             sha(b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))] += 1
    return out


def test_periodic(spark, tmp_path):
    r = np.random.default_rng(9)
    rows = rows_of(60) + [(100 + i, " ".join(f"w{v}" for v in r.integers(0, 40, 150)) + " p q r s t u v" * (i % 4), "en", None, None) for i in range(80)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == brute_periodic(rows)


def test_periodic_empty(spark):
    assert periodic.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collapse_keeps_one_period(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y")], "doc_id long, text string")
    r = periodic.collapse(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 15, 3)] and r["text"] == "x a b c y" and r["n_words"] == 17


# ---- top-k search

def vectors(n=300, size=9):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=size).tolist()) for i in range(n)]
    rows += [(50, rows[50][1]), (7, rows[7][1]), (None, rows[7][1]), (None, None), (1000, None), (1050, [1.0] * (size - 1) + [None])]
    rows += [(1100, [float("nan")] * size), (1150, [float("inf")] * size), (1200, []), (1250, []), (1300, [2.0]), (1350, [1.0] * size)]
    rows += [(2000 + i, [0.5] * size) for i in range(40)]  # ties
    rows += [(3000, [1e15] * size), (3001, [-3e18] + [0.0] * (size - 1)), (3050, [7e15, -7e15] + [1.0] * (size - 2))]
    return rows


def brute_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(good):
        if i is None or i % 50:
            continue
        scored = [(min(max(sum(x * y for x, y in zip(q, c)), -2**63), 2**63 - 1), j) for b, (j, c) in enumerate(good) if b != a and len(c) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out.update((i, rank + 1, j, score) for rank, (score, j) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize("sizes", [(16_384, 8_192), (3, 40)])
def test_top_k(spark, sizes):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit(2), "row": F.lit(3)}).repartition(5)
    got = search.top_k(df, F.col("vec_id") % 50 == 0, per_queries=sizes[0], per_candidates=sizes[1]).collect()
    assert Counter(map(tuple, got)) == brute_top(rows)


def test_top_k_of_floats(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=64).astype(np.float32).tolist()) for i in range(260)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(map(tuple, queries.op13_top_k(spark, str(tmp_path)).collect())) == brute_top(rows)


def test_top_k_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(50, [1.0]), (51, [2.0])], schema)
    assert [tuple(x) for x in search.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 51, 256 * 512)]


def test_bounds_hold():
    r = np.random.default_rng(6)
    q, c = r.normal(size=(40, 70)), r.normal(size=(50, 70))
    exact, last = q @ c.T, None
    for length in search.LENGTHS:
        bound = search.summaries(q, length) @ search.summaries(c, length).T
        assert (bound >= exact - 1e-9).all()
        assert last is None or bound.sum() < last  # closer with every resolution
        last = bound.sum()


def test_top_k_equals_its_oracle(spark):
    """The SQL reads ``embeddings``, so the connection needs that table."""
    import duckdb

    from crashlens.llm import queries
    from tools_compare import canon

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    assert canon(queries.QUERIES["op13_top_k"](spark, folder).toPandas()) == canon(con.execute(queries.ORACLE_SQL["op13_top_k"]).df())


def test_exact_pass_tells_links_only():
    """A bucket of near copies in many components leaves a link for each that joins, not all similar pairs."""
    from crashlens.llm import near

    r = np.random.default_rng(31)
    bodies = [r.integers(1, 2**63, 90).astype(np.uint64) for _ in range(3)]
    values = []
    for i in range(300):
        x = bodies[i % 3].copy()
        x[r.integers(0, 90, 3)] = r.integers(1, 2**63, 3).astype(np.uint64)
        values.append(x if i % 10 else r.permutation(x))  # every tenth holds the same shingles in another order
    m, comp = len(values), r.integers(0, 280, len(values))
    digests = [i.to_bytes(16, "big") for i in range(m)]
    root = {int(c): int(c) for c in comp}

    def top(c):
        while root[c] != c:
            c = root[c]
        return c

    similar = [(i, j) for i in range(m) for j in range(i + 1, m) if near.similarity(values[i], values[j], near.LEAST) >= near.LEAST]
    for i, j in similar:
        root[top(int(comp[i]))] = top(int(comp[j]))
    want = {c: top(c) for c in root}
    for blocks in (1, 2):
        root, got = {c: c for c in root}, []
        own = np.arange(m) % blocks
        for lo in range(blocks):
            for hi in range(lo, blocks):
                at = np.flatnonzero((own == lo) | (own == hi)).tolist()
                table = pa.table({
                    "s": [0] * len(at), "s2": [0] * len(at), "lo": [lo] * len(at), "hi": [hi] * len(at), "own": own[at].tolist(), "digest": [digests[i] for i in at],
                    "n": [90] * len(at), "comp": [digests[comp[i]] for i in at], "keys": [np.full(near.SKETCHES, 7, np.uint64).tobytes()] * len(at), "shingles": [values[i].tobytes() for i in at],
                })
                links = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(*near.linking(table).to_pydict().values())]
                assert len(links) < len(at) and set(links) <= set(similar)
                got += links
        for i, j in got:
            root[top(int(comp[i]))] = top(int(comp[j]))
        assert {frozenset(c for c in root if top(c) == t) for t in set(map(top, root))} == {frozenset(c for c in want if want[c] == t) for t in set(want.values())}
    assert len(similar) > 5000
