"""DuckDB SQL of the manifest, periodic-run and top-k queries."""

#: crc32 of the text {x}, bit by bit.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({x}, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, (s & 1) * 3988292384) END))"""
DOC_CRC = CRC32.format(x="doc_id::VARCHAR")


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


MANIFEST = f"""
WITH RECURSIVE told AS (
  SELECT *, CASE WHEN {DOC_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS leaf, {_leaf('other')} AS claimed FROM told),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
trees AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY idx))
  FROM trees WHERE n > 1 GROUP BY tree, idx // 8),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM trees WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY idx))
  FROM top WHERE n > 1 GROUP BY idx // 8),
nodes AS (
  SELECT tree, level, idx, n, digest FROM trees
  UNION ALL SELECT '*', level, idx, n, digest FROM top),
sides AS (
  SELECT tree, level, idx,
         coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW r AS (PARTITION BY tree, level, idx // 8 ORDER BY idx)),
numbered AS (SELECT *, row_number() OVER () AS r FROM placed),
walk AS (
  SELECT r, tree AS own, tree, 0 AS level, idx, n, claimed AS folded, '' AS proof FROM numbered
  UNION ALL
  SELECT w.r, w.own,
         CASE WHEN w.n > 1 THEN w.tree ELSE '*' END,
         CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
         CASE WHEN w.n > 1 THEN w.idx // 8 ELSE s.idx END,
         CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE s.n END,
         CASE WHEN w.n > 1 THEN sha256(b.before || w.folded || b.after) ELSE w.folded END,
         CASE WHEN w.n > 1 THEN w.proof || b.before || b.after ELSE w.proof END
  FROM walk w JOIN subroots s ON s.tree = w.own
  LEFT JOIN sides b ON b.tree = w.tree AND b.level = w.level AND b.idx = w.idx
  WHERE w.n > 1 OR w.tree <> '*')
SELECT d.doc_id, d.leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM walk w JOIN numbered d ON d.r = w.r JOIN subroots s ON s.tree = d.tree CROSS JOIN (SELECT digest FROM top WHERE n = 1) t
WHERE w.tree = '*' AND w.n = 1"""

PERIODIC = rf"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {DOC_CRC} AS h FROM documents),
sized AS (SELECT *, len(words) AS n, h // 10 AS g FROM cut),
bent AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
planted AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i
         ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS words FROM bent),
each AS (SELECT r, unnest(words) AS word, unnest(range(n)) AS i FROM planted),
gone AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM (
    SELECT x.r, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS island
    FROM each x JOIN each y ON x.r = y.r AND x.word = y.word AND x.i < y.i)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT r, s, len, min(q) AS q FROM gone GROUP BY r, s, len),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (
  SELECT e.r, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each e ANTI JOIN dropped d ON d.r = e.r AND d.i = e.i GROUP BY e.r),
found AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         first(struct_pack(s, len, q) ORDER BY len DESC, s, q) AS b FROM runs GROUP BY r)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN found f ON f.r = p.r LEFT JOIN kept k ON k.r = p.r"""

TOP_K = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

SQL = {"op11_manifest": MANIFEST, "op12_periodic": PERIODIC, "op13_top_k": TOP_K}
