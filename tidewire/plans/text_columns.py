"""Text, hash, similarity and URL columns over documents, pages, embeddings and wire text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, urls as U
from ..rules import lexicon as L
from ..session import load
from . import sqltext as Q
from .bindings import spread, sql_list, view, with_views
from .registry import query


def arts(s, d):
    return view(s, d, "articles")


def texts(s, d):
    """Articles without what text columns do not read, dealt over all tasks."""
    return spread(arts(s, d).select("id", "title", "body"))


def docs(s, d):
    return load(s, d, "documents")


def raw_pages(s, d):
    return load(s, d, "pages")


def AR(sql):
    return with_views(sql, "articles")


TOK_BODY = Q.tokens("tb", "articles", "title || ' ' || body")
TOK_TITLE = Q.tokens("tt", "articles", "title")


@query("t1_deaccent", "SELECT doc_id, sha256(strip_accents(text)) AS h FROM documents")
def t1(s, d):
    return docs(s, d).select("doc_id", T.sha256(T.deaccent("text")).alias("h"))


@query("t2_normalized_text", f"SELECT doc_id, sha256({Q.normtext('text')}) AS h FROM documents")
def t2(s, d):
    return docs(s, d).select("doc_id", T.sha256(T.normalize_text("text")).alias("h"))


@query("t3_ascii_text", f"SELECT doc_id, sha256({Q.norm('text')}) AS h FROM documents")
def t3(s, d):
    return docs(s, d).select("doc_id", T.sha256(T.norm("text")).alias("h"))


@query("t4_tokens", AR(f"""WITH {TOK_BODY} SELECT a.id, count(t) AS n, sha256(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS h
    FROM articles a LEFT JOIN tb ON tb.id = a.id GROUP BY a.id"""))
def t4(s, d):
    t = arts(s, d).select("id", T.tokenize(F.concat_ws(" ", "title", "body")).alias("t"))
    return t.select("id", F.size("t").alias("n"), T.sha256(F.array_join("t", " ")).alias("h"))


@query("t5_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def t5(s, d):
    return docs(s, d).select("doc_id", T.sha256("text").alias("h"))


@query("t6_content_hash", AR(f"""WITH {TOK_BODY}, k AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM tb)
    SELECT a.id, sha256(coalesce(string_agg(t, ' ' ORDER BY r), '')) AS content_hash FROM articles a
    LEFT JOIN k ON k.id = a.id GROUP BY a.id"""))
def t6(s, d):
    return texts(s, d).select("id", T.content_hash("title", "body").alias("content_hash"))


@query("t6_content_hash_first", AR(f"""WITH {TOK_BODY}, k AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM tb)
    SELECT a.id, sha256(coalesce(string_agg(t, ' ' ORDER BY r), '')) AS content_hash FROM articles a
    LEFT JOIN k ON k.id = a.id AND r <= {L.HASHED_TOKENS} GROUP BY a.id"""))
def t6_first(s, d):
    """The option that hashes the opening of a text only."""
    return arts(s, d).select("id", T.content_hash("title", "body", L.HASHED_TOKENS).alias("content_hash"))


@query("t7_fnv1a", f"SELECT doc_id, CASE WHEN text = '' THEN 2166136261 ELSE {Q.fnv('text')} END AS h FROM documents WHERE text IS NOT NULL")
def t7(s, d):
    return docs(s, d).filter("text IS NOT NULL").select("doc_id", T.fnv1a("text").alias("h"))


@query("t8_simhash", AR(f"""WITH {TOK_BODY}, {Q.simhash('sh', 'tb')}
    SELECT a.id, coalesce(sh.simhash, '0000000000000000') AS simhash FROM articles a LEFT JOIN sh ON sh.id = a.id"""))
def t8(s, d):
    return texts(s, d).select("id", T.simhash(F.concat_ws(" ", "title", "body")).alias("simhash"))


_TWO = f"""{TOK_TITLE}, {Q.tokens("ty", "articles", "body")}, {Q.simhash("st", "tt")}, {Q.simhash("sy", "ty")},
  two AS (SELECT a.id, coalesce(st.simhash, '0000000000000000') AS x, coalesce(sy.simhash, '0000000000000000') AS y
    FROM articles a LEFT JOIN st ON st.id = a.id LEFT JOIN sy ON sy.id = a.id)"""


def _two(s, d):
    """SimHash of the title and of the body."""
    return texts(s, d).select("id", T.simhash("title").alias("x"), T.simhash("body").alias("y"))


@query("t9_hamming", AR(f"""WITH {_TWO} SELECT id, CAST({Q.hamming('x', 'y')} AS INT) AS distance FROM two"""))
def t9(s, d):
    return _two(s, d).select("id", T.hamming("x", "y").alias("distance"))


@query("t10_simhash_similarity", AR(f"""WITH {_TWO} SELECT id, round(1 - {Q.hamming('x', 'y')} / 64.0, 6) AS similarity FROM two"""))
def t10(s, d):
    return _two(s, d).select("id", F.round(T.simhash_similarity("x", "y"), 6).alias("similarity"))


@query("t11_jaccard_title_body", AR(f"""WITH {TOK_TITLE}, {Q.tokens('bb', 'articles', 'body')},
    n AS (SELECT a.id, (SELECT count(*) FROM tt WHERE tt.id = a.id) AS x, (SELECT count(*) FROM bb WHERE bb.id = a.id) AS y,
    (SELECT count(*) FROM tt JOIN bb ON tt.id = bb.id AND tt.t = bb.t WHERE tt.id = a.id) AS c FROM articles a)
    SELECT id, CASE WHEN x > 0 AND y > 0 THEN round(c / (x + y - c), 6) ELSE 0 END AS jaccard FROM n"""))
def t11(s, d):
    t = arts(s, d).select("id", T.tokenize("title").alias("x"), T.tokenize("body").alias("y"))
    return t.select("id", F.round(T.jaccard("x", "y"), 6).alias("jaccard"))


@query("t12_cosine_neighbours", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def t12(s, d):
    e = load(s, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(T.cosine("embedding", "e2"), 6).alias("cosine"))


@query("t13_parse_embedding", "SELECT vec_id, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def t13(s, d):
    e = load(s, d, "embeddings").select("vec_id", F.to_json("embedding").alias("raw"))
    v = e.withColumn("v", T.parse_embedding("raw"))
    return v.select("vec_id", F.size("v").alias("dims"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("t14_html_to_text", f"SELECT page_id, sha256({Q.trim_all(Q.squeeze(Q.entities(Q.strip_markup('html'))))}) AS h FROM pages")
def t14(s, d):
    return raw_pages(s, d).select("page_id", T.sha256(T.html_to_text("html")).alias("h"))


@query("t15_entities", f"""SELECT doc_id, {Q.entities("'&Aacute;' || '&amp;lt; &NBSP;' || text")} || chr(233) || 'x' || chr(233) || chr(233) || '&#1114112;' AS decoded FROM documents""")
def t15(s, d):
    raw = F.concat(F.lit("&Aacute;&amp;lt; &NBSP;"), "text", F.lit("&#233;&#x78;&#00000000233;&#x000000e9;&#1114112;"))
    return docs(s, d).select("doc_id", T.decode_entities(raw).alias("decoded"))


@query("t16_tidy_truncate", f"""WITH t AS (SELECT doc_id, {Q.trim_all("regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS x FROM documents),
    c AS (SELECT doc_id, x, left(x, 200) AS cut FROM t)
    SELECT doc_id, sha256(x) AS tidy, CASE WHEN length(x) <= 200 THEN x ELSE regexp_replace(CASE WHEN contains(cut, ' ') AND
    200 - instr(reverse(cut), ' ') > 120 THEN left(cut, CAST(200 - instr(reverse(cut), ' ') AS BIGINT)) ELSE cut END, '\\s+$', '') || '…' END AS short FROM c""")
def t16(s, d):
    t = docs(s, d).select("doc_id", T.tidy("text").alias("x"))
    return t.select("doc_id", T.sha256("x").alias("tidy"), T.truncate("x", 200).alias("short"))


@query("t17_slugs", AR(r"""SELECT id, left(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) AS slug FROM articles"""))
def t17(s, d):
    return arts(s, d).select("id", T.slugify("title").alias("slug"))


def _sql_url(drop, lower_all):
    host = "lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    if lower_all:
        host = f"regexp_replace({host}, '^www\\.', '')"
    path = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    if not lower_all:
        path = f"regexp_replace({path}, '/amp/?$', '/')"
    path = f"CASE WHEN regexp_replace({path}, '/+$', '') = '' THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    q = (f"array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), "
         f"lambda kv: kv <> '' AND split_part(kv, '=', 1) NOT IN ({sql_list(drop)})), '&')")
    out = f"regexp_extract(url, '^([a-z]+)://', 1) || '://' || {host} || {path} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"
    return f"lower({out})" if lower_all else out


@query("t18_canonical_url", f"SELECT page_id, {_sql_url(L.TRACKING_FEED, False)} AS url FROM pages")
def t18(s, d):
    return raw_pages(s, d).select("page_id", U.canonicalize_url("url").alias("url"))


@query("t19_normalized_url", f"SELECT page_id, {_sql_url(L.TRACKING_DEDUPE, True)} AS url FROM pages")
def t19(s, d):
    return raw_pages(s, d).select("page_id", U.normalize_url("url").alias("url"))


@query("t20_url_hash", f"SELECT page_id, sha256({_sql_url(L.TRACKING_DEDUPE, True)}) AS url_hash FROM pages")
def t20(s, d):
    return raw_pages(s, d).select("page_id", U.url_hash("url").alias("url_hash"))


@query("t21_word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents")
def t21(s, d):
    return docs(s, d).select("doc_id", T.word_count("text").alias("words"))


@query("t22_redact_url", r"""SELECT page_id, regexp_replace(regexp_replace(url, '^([a-z]+://)', '\1'), '#.*$', '')
    || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=REDACTED&b=' || page_id AS url FROM pages""")
def t22(s, d):
    bare = F.regexp_replace("url", "#.*$", "")
    secret = F.concat(F.regexp_replace(bare, "^([a-z]+://)", "$1user:pass@"),
                      F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("token=s3cret&b="), F.col("page_id").cast("string"))
    return raw_pages(s, d).select("page_id", U.redact_url(secret).alias("url"))


_CLEAN, _HITS = Q.redacted("text")
_HIT_LISTS = ", ".join(f"{h} AS h{i}" for i, (_, h) in enumerate(_HITS))


@query("t23_pii_redaction", f"""SELECT doc_id, sha256({_CLEAN}) AS clean, {' + '.join(f'len({h})' for _, h in _HITS)} AS findings FROM documents""")
def t23(s, d):
    r = spread(docs(s, d).select("doc_id", "text")).select("doc_id", T.redact_pii("text").alias("r"))
    return r.select("doc_id", T.sha256("r.clean").alias("clean"), F.size("r.findings").alias("findings"))


@query("a18_findings_by_type", "SELECT type, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS type, len({h}) AS n FROM documents" for k, h in _HITS) + ") GROUP BY 1 HAVING sum(n) > 0")
def a18(s, d):
    r = docs(s, d).select(T.redact_pii("text").alias("r"))
    return r.select(F.explode("r.findings").alias("f")).groupBy(F.col("f.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


_GRAMS = """{n} AS (SELECT {k}, array_to_string(l[i:i + 5], ' ') AS g FROM (SELECT {k}, l, unnest(range(1, len(l) - 4)) AS i
  FROM (SELECT {k}, list_filter(string_split({x}, ' '), lambda w: w <> '') AS l FROM {t}) WHERE len(l) >= 6))"""


@query("t24_copied_passages", f"""WITH {_GRAMS.format(n='b', k='item_id', x=Q.normtext('text'), t='benchmark')},
    {_GRAMS.format(n='d0', k='doc_id', x=Q.normtext('text'), t='documents')}, dd AS (SELECT DISTINCT doc_id, g FROM d0),
    tot AS (SELECT item_id, count(*) AS total FROM b GROUP BY 1)
    SELECT doc_id, b.item_id, round(count(*) / any_value(total), 6) AS overlap FROM b JOIN dd ON b.g = dd.g JOIN tot ON tot.item_id = b.item_id
    GROUP BY 1, 2 HAVING count(*) / any_value(total) > {L.MAX_OVERLAP}""")
def t24(s, d):
    """Share of every original's 6-grams that a text copies, where it exceeds the limit."""
    def grams(df, key, distinct=False):
        # Tokens become a column first: inside the gram lambda they would be rebuilt per position.
        g = T.ngrams("w")
        return df.select(key, T.words(T.normalize_text("text")).alias("w")).select(
            key, F.explode(F.array_distinct(g) if distinct else g).alias("g"))
    # The originals shrink to (gram, item, count).
    orig = grams(load(s, d, "benchmark"), "item_id").groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("n"))
    total = orig.groupBy("item_id").agg(F.sum("n").alias("total"))
    own = grams(spread(docs(s, d).select("doc_id", "text")), "doc_id", distinct=True)
    hit = own.join(orig, "g").groupBy("doc_id", "item_id").agg(F.sum("n").alias("shared"))
    share = F.col("shared") / F.col("total")
    return hit.join(total, "item_id").filter(share > L.MAX_OVERLAP).select("doc_id", "item_id", F.round(share, 6).alias("overlap"))


def _has(x, pattern):
    return f"regexp_matches({x}, {Q.lit(pattern)})"


_SPELLED = "CASE n " + " ".join(f"WHEN {k} THEN {Q.lit(v)}" for k, v in L.SPELLED.items()) + " END"


@query("t25_lost_numbers", with_views(rf"""WITH x AS (SELECT id, title, body, regexp_extract_all(title, '\b\d{{1,3}}\b') AS ns, string_split_regex(title, '\b\d{{1,3}}\b') AS gs FROM wire),
  k AS (SELECT *, unnest(range(1, len(ns) + 1)) AS j FROM x), p AS (SELECT id, title, body, CAST(ns[j] AS INT) AS n,
    1 + list_sum(list_transform(gs[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(ns[1:j - 1], lambda g: length(g))), 0) AS pos FROM k),
  w AS (SELECT id, body, n, lower(substr(title, CAST(greatest(1, pos - 28) AS BIGINT), CAST(least(28, pos - 1) AS BIGINT))) AS b, lower(substr(title, CAST(pos AS BIGINT), 34)) AS a FROM p),
  v AS (SELECT DISTINCT id, body, n FROM w WHERE CASE WHEN {_has('a', L.VICTIM_AFTER)} OR {_has('b', L.VICTIM_BEFORE)} THEN true
    WHEN {_has('b', L.REF_BEFORE)} OR {_has('a', L.REF_AFTER)} THEN false WHEN {_has("b || ' ' || a", L.CALENDAR)} THEN false ELSE n >= 10 END),
  l AS (SELECT id, n, NOT (contains(strip_accents(body), CAST(n AS VARCHAR)) OR coalesce(contains(' ' || regexp_replace(lower(strip_accents(body)), '[^a-z0-9_]+', ' ', 'g') || ' ', ' ' || {_SPELLED} || ' '), false)) AS lost FROM v)
  SELECT wire.id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC), '') AS significant, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) FILTER (lost), '') AS lost
  FROM wire LEFT JOIN l ON l.id = wire.id GROUP BY 1""", "wire"))
def t25(s, d):
    w = spread(view(s, d, "wire").select("id", "title", "body"))
    return w.select("id", F.array_join(T.significant_numbers("title"), ",").alias("significant"),
                    F.array_join(T.lost_numbers("title", "body"), ",").alias("lost"))


@query("t26_image_urls", r"""SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) || CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '/media/x' ELSE '' END,
    '\.(jpg|jpeg|png|webp|avif|gif|bmp|tiff?)$|(/image/|/images/|photo|thumb|/media/)') AS is_image FROM pages""")
def t26(s, d):
    tail = F.expr("CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '/media/x' ELSE '' END")
    return raw_pages(s, d).select("page_id", U.looks_like_image(F.concat(F.regexp_replace("url", "[?#].*$", ""), tail)).alias("is_image"))


@query("u2_distinct_tokens", AR(f"""WITH {TOK_TITLE} SELECT id, string_agg(t, ' ' ORDER BY i) AS tokens FROM tt GROUP BY id"""))
def u2(s, d):
    t = arts(s, d).select("id", T.tokenize("title").alias("t"))
    return t.filter(F.size("t") > 0).select("id", F.array_join("t", " ").alias("tokens"))


@query("u3_set_sizes", AR(f"""WITH {TOK_TITLE}, {Q.tokens('bb', 'articles', 'body')} SELECT id, count(x) FILTER (y IS NOT NULL) AS common, count(*) AS total FROM
    (SELECT coalesce(tt.id, bb.id) AS id, tt.t AS x, bb.t AS y FROM tt FULL OUTER JOIN bb ON tt.id = bb.id AND tt.t = bb.t) GROUP BY 1"""))
def u3(s, d):
    t = arts(s, d).select("id", T.tokenize("title").alias("x"), T.tokenize("body").alias("y"))
    out = t.select("id", F.size(F.array_intersect("x", "y")).alias("common"), F.size(F.array_union("x", "y")).alias("total"))
    return out.filter("total > 0")
