"""SQL twins of the operators that SQL can express, for whole tables of moderate size."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP3 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  s AS (SELECT doc_id, p, substr(x, 2 * p - 1, 100) AS b FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 48)) AS p FROM d)),
  r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY b) AS first FROM s) WHERE first < doc_id),
  g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM r),
  o AS (SELECT doc_id, x, unnest(range(1, length(x) // 2 + 1)) AS i FROM d),
  k AS (SELECT doc_id, string_agg(substr(x, 2 * i - 1, 2), '' ORDER BY i) AS x FROM o ANTI JOIN g USING (doc_id, i) GROUP BY 1),
  c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM i - 1) AS spans
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g) GROUP BY 1)
  SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(c.n, 0) AS n_removed, coalesce(c.spans, 0) AS n_spans,
    sha256(unhex(coalesce(k.x, ''))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP4 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
  r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p:p + 34], ' ')) AS n FROM s) WHERE n > 1),
  g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
  o AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
  k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS x FROM o ANTI JOIN g USING (doc_id, i) GROUP BY 1),
  c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.x, '')) AS kept_sha256
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
  SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
    FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""

OP9 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
  t AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
  iw AS (SELECT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS l,
    unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM t WHERE len(w) > 0)),
  dw AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS x FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p
    FROM d CROSS JOIN (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
  h AS (SELECT doc_id, p, l, item_id FROM dw JOIN iw USING (l, x)),
  g AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS i FROM h) GROUP BY 1),
  m AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(g.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
  c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY 1, 2, 3),
  t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
  v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY 1),
  s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
  p AS MATERIALIZED (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS BIGINT) AS p,
    CAST(1 + 1000000000::HUGEINT * (t.n + 2) // (v.n + 2 * v.v) AS BIGINT) AS q
    FROM s JOIN v ON v.lang = s.lang JOIN t ON t.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""

OP12 = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  o AS (SELECT doc_id, r, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM d),
  k AS (SELECT *, translate(regexp_replace(t, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key FROM o),
  m AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
    lambda h, c: list_reduce(list_prepend(xor(h, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP13 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  w AS (SELECT conv_id, turn, role, md5(length(role) || ':' || role || text) AS t, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM c),
  o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS p, t, words FROM w),
  z AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM o GROUP BY conv_id),
  s AS (SELECT z.conv_id, z.base, z.h, least(z.h, coalesce(b.n, 0)) AS taken FROM z LEFT JOIN z b ON b.conv_id = z.base),
  r AS (SELECT s.conv_id, p AS pos, t, words FROM s JOIN o ON o.conv_id = s.base AND p <= taken
    UNION ALL SELECT conv_id, p - h + taken, t, words FROM s JOIN o USING (conv_id) WHERE p > h),
  e AS (SELECT s.conv_id, coalesce(list(t ORDER BY pos) FILTER (pos IS NOT NULL), []) AS l, list(words ORDER BY pos) FILTER (pos IS NOT NULL) AS wl
    FROM s LEFT JOIN r USING (conv_id) GROUP BY 1),
  x AS (SELECT conv_id, len(l) AS size, depth, array_to_string(l[1:depth], '') AS k, CASE WHEN depth > 0 THEN wl[depth] ELSE 0 END AS words
    FROM (SELECT *, unnest(range(0, len(l) + 1)) AS depth FROM e)),
  n AS MATERIALIZED (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth) AS ends FROM x GROUP BY 1, 2),
  m AS MATERIALIZED (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN (SELECT left(k, length(k) - 32) AS k, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1) USING (k)),
  b AS (SELECT a.k, sum((y.n - 1) * y.words) AS saved, count(*) FILTER (y.kids = 0) AS leaves FROM m a JOIN m y ON starts_with(y.k, a.k) GROUP BY 1)
  SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, leaves AS n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
  FROM m JOIN b USING (k) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.k = left(m.k, length(m.k) - 32)"""

ORACLES = {"op3_suffix_dedup": OP3, "op4_substring_dedup": OP4, "op8_topk": OP8, "op9_decontamination": OP9,
           "op11_source_divergence": OP11, "op12_line_dedup": OP12, "op13_conversation_trie": OP13}
