"""Named queries over the input tables, each with its DuckDB oracle SQL.

Every query reads whole tables (no id subsets, no row caps); a LIMIT appears
only where it is the feature (top-k).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.config import Params
from kbweave.functions import vectors as V
from kbweave.operators import retrieve as R
from kbweave.operators import vector_index as VI
from kbweave.operators.partitioning import saved, spread
from kbweave.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
P = Params()


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _dealt(df: DataFrame) -> DataFrame:
    """Over as many tasks as the session's ``kbweave.scan.partitions`` says (unset: the
    scan's own splits). The bench sets it: its tables are one row group each."""
    return spread(df, int(df.sparkSession.conf.get("kbweave.scan.partitions", "0")) or None)


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ vectors

_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_NORM = "sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]))"


def _cos_sql(a, b):
    return (f"{_DOT.format(a=a, b=b)} / nullif({_NORM.format(a=a)} * {_NORM.format(a=b)}, 0)")


@query("vector_norm", f"""
SELECT vec_id, round({_NORM.format(a='embedding')}, 6) AS norm FROM embeddings""")
def vector_norm(spark, sf):
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", r6(V.norm("embedding")).alias("norm"))


@query("dim_check", f"""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, coalesce(len(embedding) = {P.dim}, false) AS dim_ok
FROM embeddings""")
def dim_check(spark, sf):
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", F.size("embedding").alias("dim"), V.dim_ok("embedding", P.dim).alias("dim_ok"))


def _first_vector(e: DataFrame):
    """The query vector: the stored vector with the smallest id (scalar subquery)."""
    return e.orderBy("vec_id").limit(1).select("embedding").scalar()


_QVEC = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("cosine_pairs", f"""
WITH q AS (SELECT {_QVEC} AS qv)
SELECT e.vec_id, round({_cos_sql('e.embedding', 'q.qv')}, 6) AS similarity FROM embeddings e, q""")
def cosine_pairs(spark, sf):
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return (e.withColumn("_q", _first_vector(e))
            .select("vec_id", r6(V.cosine("embedding", "_q")).alias("similarity")))


@query("topk_single", f"""
WITH q AS (SELECT {_QVEC} AS qv),
s AS (SELECT e.vec_id, round({_cos_sql('e.embedding', 'q.qv')}, 12) AS sim FROM embeddings e, q)
SELECT vec_id, CAST(row_number() OVER (ORDER BY sim DESC NULLS LAST, vec_id) AS INTEGER) AS rank,
       round(sim, 6) AS similarity
FROM s ORDER BY sim DESC NULLS LAST, vec_id LIMIT {P.top_k}""")
def topk_single(spark, sf):
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    top = R.topk_single(e, _first_vector(e), P.top_k, id_col="vec_id", vec_col="embedding")
    return top.select("vec_id", "rank", r6(F.col("similarity")).alias("similarity"))


_TOPK_SELF = f"""
WITH s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({_cos_sql('d.embedding', 'q.embedding')}, 12) AS sim
  FROM embeddings q, embeddings d
  WHERE len(q.embedding) = {P.dim} AND len(d.embedding) = {P.dim}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, doc_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, doc_id, round(sim, 6) AS similarity FROM r WHERE rn <= {P.top_k}"""


@query("topk_batch", _TOPK_SELF)
def topk_batch(spark, sf):
    """Every stored vector as a query against all stored vectors (k-NN lists)."""
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    top = R.topk_batch(e, e, P.top_k, doc_id="vec_id", doc_vec="embedding",
                       query_id="vec_id", query_vec="embedding", dim=P.dim)
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


@query("topk_blocked", _TOPK_SELF)
def topk_blocked(spark, sf):
    """Same result as ``topk_batch`` with the documents forced into 16 cells and small
    blocks, of which a query visits two cells first: the pruned path is exact."""
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    top = R.topk_batch(e, e, P.top_k, doc_id="vec_id", doc_vec="embedding",
                       query_id="vec_id", query_vec="embedding", dim=P.dim, block_rows=128, cells=16, n_probe=2)
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


def _index(spark, sf):
    """An index of all stored vectors in 16 cells, with small blocks so that cells have several."""
    from kbweave.config import scratch_path
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return e, VI.build_index(e, scratch_path(spark, "vector-index"), id_col="vec_id", dim=P.dim, cells=16, block_rows=100)


@query("topk_indexed", _TOPK_SELF)
def topk_indexed(spark, sf):
    """Every stored vector against the stored index, all cells probed (exact)."""
    e, index = _index(spark, sf)
    top = VI.topk_indexed(index, e, P.top_k, query_id="vec_id")
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


@query("topk_indexed_pruned", _TOPK_SELF)
def topk_indexed_pruned(spark, sf):
    """The same from two cells and then the cells that can hold a better vector."""
    e, index = _index(spark, sf)
    top = VI.topk_indexed(index, e, P.top_k, query_id="vec_id", n_probe=2, exact=True)
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


@query("index_recall", f"SELECT count(*) AS wanted, true AS recall_reached FROM ({_TOPK_SELF})")
def index_recall(spark, sf):
    """Approximate search with as many cells as a tenth of the queries asks for: does it
    find 0.9 of the exact neighbours of all queries?"""
    e, index = _index(spark, sf)
    n = VI.choose_probes(index, e.where("vec_id % 10 = 0"), P.top_k, query_id="vec_id", recall=0.93)
    # Written once, so that the driver runs the two searches one after the other.
    exact = saved(VI.topk_indexed(index, e, P.top_k, query_id="vec_id"), "recall-exact")
    share = VI.found_share(VI.topk_indexed(index, e, P.top_k, query_id="vec_id", n_probe=n), exact)
    return share.select("wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("recall_reached"))


# --------------------------------------------------------- hashed term freq

def _bucket_sql(tok: str, dim: int) -> str:
    return f"CAST((('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dim}) AS INTEGER)"


def _tf_sql(table: str, id_col: str, dim: int, id_alias: str | None = None) -> str:
    a = id_alias or id_col
    return (f"SELECT {a}, bucket, count(*) AS tf FROM ("
            f"SELECT {id_col} AS {a}, {_bucket_sql('t', dim)} AS bucket FROM ("
            f"SELECT {id_col}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t "
            f"FROM {table}) WHERE t <> '') GROUP BY 1, 2")


@query("hash_embed", _tf_sql("documents", "doc_id", P.text_dim))
def hash_embed(spark, sf):
    """Feature hashing of every document: sparse ``(doc_id, bucket, tf)``,
    counted inside each document's row (map-only, no shuffle)."""
    d = _dealt(load_table(spark, sf, "documents", ["doc_id", "text"]))
    return K.hashed_tf(d, "doc_id", "text", P.text_dim)


def _text_topk_sql(q_table: str, q_id: str, d_table: str, d_id: str, dim: int, k: int,
                   d_where: str = "TRUE") -> str:
    return f"""
WITH dsel AS (SELECT * FROM {d_table} WHERE {d_where}),
dt AS ({_tf_sql('dsel', d_id, dim, 'doc_id')}),
qt AS ({_tf_sql(q_table, q_id, dim, 'query_id')}),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dt GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qt GROUP BY 1),
dots AS (SELECT qt.query_id, dt.doc_id, sum(qt.tf * dt.tf) AS dot FROM qt JOIN dt USING (bucket) GROUP BY 1, 2),
s AS (SELECT q.{q_id} AS query_id, d.{d_id} AS doc_id,
             round(coalesce(dots.dot, 0) / nullif(qn.n * dn.n, 0), 12) AS sim
      FROM {q_table} q CROSS JOIN dsel d
      LEFT JOIN dots ON dots.query_id = q.{q_id} AND dots.doc_id = d.{d_id}
      LEFT JOIN qn ON qn.query_id = q.{q_id} LEFT JOIN dn ON dn.doc_id = d.{d_id}
      WHERE q.text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, doc_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, doc_id, round(sim, 6) AS similarity FROM r WHERE rn <= {k}"""


@query("topk_text", _text_topk_sql("benchmark", "item_id", "documents", "doc_id", P.text_dim, P.top_k))
def topk_text(spark, sf):
    """Every benchmark text as a query against every document text."""
    d = _dealt(load_table(spark, sf, "documents", ["doc_id", "text"]))
    q = load_table(spark, sf, "benchmark", ["item_id", "text"])
    top = R.topk_text(d, q, P.top_k, doc_id="doc_id", query_id="item_id", dim=P.text_dim)
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))



# --------------------------------------------------------------- extraction
from kbweave.functions import html as H  # noqa: E402
from kbweave.functions.urls import NETLOC_RE, run_stamp  # noqa: E402
from kbweave.operators import entries as EN  # noqa: E402
from kbweave.operators import extract as X  # noqa: E402
from kbweave.operators import kb as K  # noqa: E402
from kbweave.plans import sqlgen as S  # noqa: E402


def _pages(spark, sf, cols=("page_id", "url", "html")):
    return _dealt(load_table(spark, sf, "pages", list(cols)))


_TITLE_SQL = (f"CASE WHEN {S.rules(S.extract('html', S.TITLE_RE), S.INLINE_RULES)} <> '' "
              f"THEN {S.rules(S.extract('html', S.TITLE_RE), S.INLINE_RULES)} "
              f"ELSE {S.rules(S.extract('html', S.H1_RE), S.INLINE_RULES)} END")
_ARTICLES = f"array_to_string(list_filter(regexp_extract_all(html, {S.lit(S.ARTICLE_RE)}, 1), lambda x: x <> ''), chr(10))"
_QUOTED = f"(SELECT page_id, url, {S.rules('html', S.QUOTE_RULES)} AS html FROM pages)"
_MAIN_SQL = (f"CASE WHEN {_ARTICLES} <> '' THEN {_ARTICLES} "
             f"WHEN {S.extract('html', S.BODY_RE)} <> '' THEN {S.extract('html', S.BODY_RE)} ELSE html END")
_CONTENT_SQL = S.rules(f"({_MAIN_SQL})", S.TEXT_RULES)


def _links_sql(src: str) -> str:
    """Links of ``src`` (an html expression over table alias p) in order."""
    lr = S.lit(S.LINK_RE)
    return (f"SELECT page_id, CAST(i - 1 AS INTEGER) AS link_pos, "
            f"{S.rules('inner_html[i]', S.INLINE_RULES)} AS text, urls[i] AS url FROM ("
            f"SELECT page_id, urls, inner_html, unnest(generate_series(1, len(urls))) AS i FROM ("
            f"SELECT page_id, regexp_extract_all({src}, {lr}, 1) AS urls, "
            f"regexp_extract_all({src}, {lr}, 2) AS inner_html FROM {_QUOTED}))")


@query("page_scan", """
SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_chars, md5(html) AS html_md5 FROM pages""")
def page_scan(spark, sf):
    return X.page_scan(load_table(spark, sf, "pages"))


@query("page_source_key", f"""
SELECT page_id, url, regexp_extract(url, {S.lit(NETLOC_RE)}, 1) AS netloc,
  replace(regexp_extract(url, {S.lit(NETLOC_RE)}, 1), '.', '_') || '_{run_stamp(P.run_ts)}' AS source_key,
  replace(regexp_extract(url, {S.lit(NETLOC_RE)}, 1), '.', '_') || '_{run_stamp(P.run_ts)}_' || CAST(page_id AS VARCHAR) AS page_key,
  '{P.reader_prefix}' || url AS fetch_url
FROM pages""")
def page_source_key(spark, sf):
    return X.source_keys(load_table(spark, sf, "pages", ["page_id", "url"]), P)


@query("content_fingerprint", """
SELECT doc_id, substr(md5(text), 1, 8) AS fingerprint FROM documents""")
def content_fingerprint(spark, sf):
    from kbweave.functions.text import fingerprint
    d = load_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", fingerprint("text").alias("fingerprint"))


@query("html_text", f"SELECT page_id, {S.rules('html', S.TEXT_RULES)} AS text FROM pages")
def html_text(spark, sf):
    return X.page_text(_pages(spark, sf, ("page_id", "html")))


@query("html_markdown", f"SELECT page_id, {S.rules('html', S.MARKDOWN_RULES)} AS md FROM pages")
def html_markdown(spark, sf):
    return X.page_markdown(_pages(spark, sf, ("page_id", "html")))


@query("page_title", f"SELECT page_id, {_TITLE_SQL} AS title FROM pages")
def page_title(spark, sf):
    return _pages(spark, sf, ("page_id", "html")).select("page_id", H.page_title("html").alias("title"))


@query("main_content", f"SELECT page_id, {_CONTENT_SQL} AS content FROM pages")
def main_content(spark, sf):
    p = _pages(spark, sf, ("page_id", "html"))
    return p.select("page_id", H.main_text("html").alias("content"))


@query("page_links", _links_sql("html"))
def page_links(spark, sf):
    return X.page_links(_pages(spark, sf, ("page_id", "html")))


_NAV_ALL = f"array_to_string(regexp_extract_all(html, {S.lit(S.NAV_RE)}, 0), '')"
_NO_NAV = f"regexp_replace(html, {S.lit(S.NAV_RE)}, '', 'g')"


@query("nav_links", f"""
SELECT page_id, true AS is_nav, link_pos, text, url FROM ({_links_sql(_NAV_ALL)})
UNION ALL
SELECT page_id, false AS is_nav, link_pos, text, url FROM ({_links_sql(_NO_NAV)})""")
def nav_links(spark, sf):
    return X.nav_links(_pages(spark, sf, ("page_id", "html")))


_MD_MAIN_SQL = S.rules(f"({_MAIN_SQL})", S.MARKDOWN_RULES)


@query("page_sections", f"""
WITH m AS (SELECT page_id, string_split({_MD_MAIN_SQL}, chr(10)) AS lines FROM pages),
ln AS (SELECT page_id, unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS pos FROM m),
lv AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS level FROM ln),
h AS (SELECT page_id, pos, level, regexp_replace(line, '^#{{1,6}} ', '') AS title,
             row_number() OVER (PARTITION BY page_id ORDER BY pos) AS sec_idx FROM lv WHERE level > 0),
hp AS (SELECT h.*, coalesce((SELECT max(p.sec_idx) FROM h p WHERE p.page_id = h.page_id
                              AND p.pos < h.pos AND p.level < h.level), 0) AS parent_idx FROM h),
secs AS (SELECT page_id, 0 AS sec_idx, 0 AS level, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS INTEGER) AS parent_idx FROM m
         UNION ALL SELECT page_id, CAST(sec_idx AS INTEGER), CAST(level AS INTEGER), title, CAST(parent_idx AS INTEGER) FROM hp),
tagged AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS sec FROM lv),
bodies AS (SELECT page_id, sec, string_agg(line, chr(10) ORDER BY pos) AS body FROM tagged WHERE level = 0 GROUP BY 1, 2)
SELECT s.page_id, CAST(s.sec_idx AS INTEGER) AS sec_idx, CAST(s.level AS INTEGER) AS level, s.title,
       CAST(s.parent_idx AS INTEGER) AS parent_idx,
       regexp_replace(coalesce(b.body, ''), '^\\n+|\\n+$', '', 'g') AS body
FROM secs s LEFT JOIN bodies b ON b.page_id = s.page_id AND b.sec = s.sec_idx""")
def page_sections(spark, sf):
    return X.page_sections(_pages(spark, sf, ("page_id", "html")))


@query("text_chunks", f"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
               - (length(line) + 1) AS start FROM ln)
SELECT doc_id, CAST(start // {P.chunk_chars} AS INTEGER) AS chunk_id, CAST(count(*) AS INTEGER) AS n_lines,
       string_agg(line, chr(10) ORDER BY pos) AS text
FROM o GROUP BY 1, 2""")
def text_chunks(spark, sf):
    d = _dealt(load_table(spark, sf, "documents", ["doc_id", "text"]))
    return X.text_chunks(d, "doc_id", "text", P.chunk_chars)


# ------------------------------------------------------- entries and the KB

_ENTRY_SQL = f"""
SELECT page_id, {_TITLE_SQL} AS title, {_CONTENT_SQL} AS content,
  (SELECT list({{'text': t, 'url': u}} ORDER BY i) FROM (
     SELECT unnest(regexp_extract_all(html, {S.lit(S.LINK_RE)}, 1)) AS u,
            unnest(regexp_extract_all(html, {S.lit(S.LINK_RE)}, 2)) AS raw_t,
            unnest(generate_series(1, len(regexp_extract_all(html, {S.lit(S.LINK_RE)}, 1)))) AS i)
     CROSS JOIN LATERAL (SELECT {S.rules('raw_t', S.INLINE_RULES)} AS t)) AS links
FROM {_QUOTED}"""


@query("kb_documents", f"""
WITH e AS ({_ENTRY_SQL}),
parts AS (
  SELECT page_id, 0 AS ord, 'title' AS doc_type, title AS text, '' AS url FROM e
  UNION ALL SELECT page_id, 1, 'content', content, '' FROM e
  UNION ALL SELECT page_id, CAST(i + 1 AS INTEGER), 'link', links[i].text, links[i].url
            FROM (SELECT page_id, links, unnest(generate_series(1, len(links))) AS i FROM e))
SELECT page_id || ':' || lpad(CAST(ord AS VARCHAR), {K.ORD_DIGITS}, '0') AS doc_id, page_id, CAST(ord AS INTEGER) AS ord, doc_type, text, url FROM parts""")
def kb_documents(spark, sf):
    """Flagship: pages -> entries -> typed knowledge-base rows."""
    from kbweave.operators.partitioning import gate
    e = K.entries_struct(X.page_entries(_pages(spark, sf)))
    return K.expand_entries(gate(e, K.entry_ok("entry")))
FLAGSHIP = "kb_documents"


# ------------------------------------------------- model replies (JSON path)

def _replies(spark, sf):
    """Replies derived from every page's extracted entry (see damaged_replies)."""
    return EN.damaged_replies(X.page_entries(_pages(spark, sf)))


def _parsed(spark, sf):
    return EN.parse_replies(_replies(spark, sf))


_REPLY_SQL = f"""
e AS ({_ENTRY_SQL}),
r0 AS (SELECT page_id, content,
         CASE WHEN page_id % 17 = 0 THEN NULL ELSE title END AS t,
         list_transform(links, lambda x, i: {{'text': x.text,
             'url': CASE WHEN page_id % 13 = 0 AND i = 1 THEN NULL ELSE x.url END}}) AS l FROM e),
r1 AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN CAST(to_json({{'title': t, 'content': content}}) AS VARCHAR)
                            ELSE CAST(to_json({{'title': t, 'content': content, 'links': l}}) AS VARCHAR) END AS j FROM r0),
r2 AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN substr(j, 1, CAST(floor(length(j) / 2) AS BIGINT)) ELSE j END AS j FROM r1),
replies AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '```json' || chr(10) || j || chr(10) || '```' ELSE j END AS reply FROM r2),
cleaned AS (SELECT page_id, reply, CASE WHEN starts_with(reply, '```')
               THEN array_to_string(list_filter(string_split(reply, chr(10)), lambda x: NOT starts_with(x, '```')), chr(10))
               ELSE reply END AS json FROM replies),
st AS (SELECT *, CASE
          WHEN NOT coalesce(try(json_array_length('[' || json || ']')) = 1, false) THEN 'bad_json'
          WHEN try(json_type(json)) <> 'OBJECT' THEN 'not_object'
          WHEN NOT list_has_all(try(json_keys(json)), ['title', 'content', 'links']) THEN 'missing_fields'
          ELSE 'ok' END AS status FROM cleaned)"""


@query("json_fence_clean", f"""
WITH {_REPLY_SQL}
SELECT page_id, starts_with(reply, '```') AS fenced, CAST(length(json) AS INTEGER) AS json_chars,
       md5(json) AS json_md5 FROM cleaned""")
def json_fence_clean(spark, sf):
    r = _replies(spark, sf).withColumn("json", EN.clean_fence("reply"))
    return r.select("page_id", F.col("reply").startswith(EN.FENCE).alias("fenced"),
                    F.length("json").alias("json_chars"), F.md5(F.encode("json", "UTF-8")).alias("json_md5"))


@query("json_parse", f"""
WITH {_REPLY_SQL}
SELECT page_id, status, CASE WHEN status = 'ok' THEN json ->> 'title' END AS title,
       CASE WHEN status = 'ok' THEN md5(json ->> 'content') END AS content_md5,
       CASE WHEN status = 'ok' AND json_type(json, '$.links') = 'ARRAY'
            THEN CAST(json_array_length(json, '$.links') AS INTEGER) END AS n_links
FROM st""")
def json_parse(spark, sf):
    p = _parsed(spark, sf)
    return p.select("page_id", "status", F.col("entry.title").alias("title"),
                    F.md5(F.encode("entry.content", "UTF-8")).alias("content_md5"),
                    F.when(F.col("entry.links").isNotNull(), F.size("entry.links")).alias("n_links"))


@query("json_validate", f"""
WITH {_REPLY_SQL}
SELECT page_id, coalesce(list_has_all(try(json_keys(json)), ['title', 'content', 'links']), false) AS valid
FROM cleaned""")
def json_validate(spark, sf):
    r = _replies(spark, sf).withColumn("json", EN.clean_fence("reply"))
    return r.select("page_id", EN.has_fields("json").alias("valid"))


@query("entry_quarantine", f"""
WITH {_REPLY_SQL}
SELECT page_id, status FROM st WHERE status <> 'ok'""")
def entry_quarantine(spark, sf):
    _, bad = EN.split_quarantine(_parsed(spark, sf))
    return bad.select("page_id", "status")


@query("batch_status", f"""
WITH {_REPLY_SQL}
SELECT status, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM st GROUP BY status""")
def batch_status(spark, sf):
    return EN.batch_status(_parsed(spark, sf))


@query("page_entries", f"""
WITH {_REPLY_SQL}
SELECT page_id, json ->> 'title' AS title, CAST(length(json ->> 'content') AS INTEGER) AS content_chars,
       CAST(json_array_length(json, '$.links') AS INTEGER) AS n_links
FROM st WHERE status = 'ok'""")
def page_entries(spark, sf):
    """Batch job pages -> entries: successes only; submission order is the
    ``page_id`` column (no global sort is paid for it)."""
    good, _ = EN.split_quarantine(_parsed(spark, sf))
    return (good.select("page_id", F.col("entry.title").alias("title"),
                        F.length("entry.content").alias("content_chars"),
                        F.size("entry.links").alias("n_links")))


@query("kb_atomic", f"""
WITH {_REPLY_SQL},
ok AS (SELECT page_id, json ->> 'title' AS title, json ->> 'content' AS content, json -> '$.links' AS lj
       FROM st WHERE status = 'ok'),
li AS (SELECT page_id, i, lj -> ('$[' || (i - 1) || ']') AS lk
       FROM (SELECT page_id, lj, unnest(generate_series(1, CASE WHEN json_type(lj) = 'ARRAY' THEN CAST(json_array_length(lj) AS BIGINT) ELSE 0 END)) AS i FROM ok)),
bad AS (SELECT DISTINCT page_id FROM li WHERE lk ->> 'text' IS NULL OR lk ->> 'url' IS NULL),
good AS (SELECT * FROM ok WHERE title IS NOT NULL AND content IS NOT NULL AND json_type(lj) = 'ARRAY'
         AND page_id NOT IN (SELECT page_id FROM bad)),
parts AS (SELECT page_id, 0 AS ord, 'title' AS doc_type, title AS text, '' AS url FROM good
  UNION ALL SELECT page_id, 1, 'content', content, '' FROM good
  UNION ALL SELECT li.page_id, CAST(i + 1 AS INTEGER), 'link', lk ->> 'text', lk ->> 'url' FROM li JOIN good USING (page_id))
SELECT page_id || ':' || lpad(CAST(ord AS VARCHAR), {K.ORD_DIGITS}, '0') AS doc_id, page_id, CAST(ord AS INTEGER) AS ord, doc_type, text, url FROM parts""")
def kb_atomic(spark, sf):
    """Entries from the JSON path; an entry with any bad part is rejected whole."""
    good, _ = EN.split_quarantine(_parsed(spark, sf))
    from kbweave.operators.partitioning import gate
    return K.expand_entries(gate(good, K.entry_ok("entry")))


# ---------------------------------------------------------------- dialogue
from kbweave.functions.text import PY_SPACE_CLASS  # noqa: E402
from kbweave.operators import dialog as D  # noqa: E402
from kbweave.plans import answer as A  # noqa: E402
from kbweave.plans.lookback import lookback  # noqa: E402

# A second lexicon for the same operator, whose keywords occur in the
# multilingual conversation table, so the template path runs on real rows.
ALT_INTENTS = [
    ("greeting", ["Hallo", "Bonjour", "Hello"]),
    ("farewell", [" und "]),
    ("small_talk", [" que "]),
    ("off_topic", ["and"]),
]


def _conv(spark, sf):
    return load_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])


def _intent_sql(intents, col="text"):
    whens = " ".join(
        f"WHEN ({' OR '.join(f'contains({col}, {S.lit(w)})' for w in words)}) THEN {S.lit(name)}"
        for name, words in intents)
    return f"CASE {whens} ELSE NULL END"


def _classified_sql(intents):
    return (f"SELECT conv_id, turn, text, {_intent_sql(intents)} AS intent FROM conversations "
            f"WHERE role = 'user'")


def _cls_cols():
    return ("CASE WHEN intent IS NULL THEN 'business' ELSE 'conversational' END AS intent_type, "
            "intent, intent IS NULL AS requires_search")


@query("intent_classify", f"""
SELECT conv_id, turn, {_cls_cols()} FROM ({_classified_sql(D.DEFAULT_INTENTS)})""")
def intent_classify(spark, sf):
    u = _conv(spark, sf).where(F.col("role") == "user")
    c = u.select("conv_id", "turn", D.classify("text").alias("c"))
    return c.select("conv_id", "turn", "c.intent_type", "c.intent", "c.requires_search")


@query("intent_classify_lexicon", f"""
SELECT conv_id, turn, {_cls_cols()} FROM ({_classified_sql(ALT_INTENTS)})""")
def intent_classify_lexicon(spark, sf):
    u = _conv(spark, sf).where(F.col("role") == "user")
    c = u.select("conv_id", "turn", D.classify("text", ALT_INTENTS).alias("c"))
    return c.select("conv_id", "turn", "c.intent_type", "c.intent", "c.requires_search")


@query("intent_route", f"""
SELECT conv_id, turn, CASE WHEN intent IS NULL THEN 'retrieval' ELSE 'template' END AS route
FROM ({_classified_sql(ALT_INTENTS)})""")
def intent_route(spark, sf):
    u = _conv(spark, sf).where(F.col("role") == "user")
    c = u.select("conv_id", "turn", D.classify("text", ALT_INTENTS).alias("c"))
    return c.select("conv_id", "turn", D.route("c.requires_search").alias("route"))


def _template_sql(intent="intent"):
    h = "(('0x' || substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 8))::BIGINT)"
    def pick(vs):
        return f"[{', '.join(S.lit(v) for v in vs)}][{h} % {len(vs)} + 1]"
    whens = " ".join(f"WHEN {intent} = {S.lit(n)} THEN {pick(vs)}" for n, vs in D.DEFAULT_TEMPLATES.items())
    return f"CASE {whens} ELSE {pick(D.DEFAULT_TEMPLATES['off_topic'])} END"


@query("template_reply", f"""
SELECT conv_id, turn, intent, {_template_sql()} AS reply
FROM ({_classified_sql(ALT_INTENTS)}) WHERE intent IS NOT NULL""")
def template_reply(spark, sf):
    u = _conv(spark, sf).where(F.col("role") == "user")
    c = u.select("conv_id", "turn", D.classify("text", ALT_INTENTS).alias("c"))
    c = c.where(F.col("c.intent").isNotNull())
    return c.select("conv_id", "turn", F.col("c.intent").alias("intent"),
                    D.template_reply("c.intent", "conv_id", "turn").alias("reply"))


@query("history_window", f"""
SELECT conv_id, turn, CAST(len(h) AS INTEGER) AS hist_len, array_to_string(h, chr(10)) AS history FROM (
  SELECT conv_id, turn, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN {P.history_len - 1} PRECEDING AND CURRENT ROW) AS h FROM conversations)""")
def history_window(spark, sf):
    """Bounded history (last 6 messages) of every message, skew-safe."""
    h = lookback(_conv(spark, sf), "conv_id", "turn", {"h": P.history_len}, ["role", "text"],
                 block_rows=P.lookback_block_rows)
    return h.select("conv_id", "turn", F.size("h").alias("hist_len"),
                    F.array_join(F.transform("h", lambda m: F.concat(m["role"], F.lit(": "), m["text"])),
                                 "\n").alias("history"))


@query("transcript", f"""
SELECT conv_id, turn, array_to_string(h, chr(10)) AS transcript FROM (
  SELECT conv_id, turn, role, list(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {P.transcript_len - 1} PRECEDING AND CURRENT ROW) AS h
  FROM conversations) WHERE role = 'user'""")
def transcript(spark, sf):
    """Prompt transcript of each user message: last 3 messages, itself included."""
    h = lookback(_conv(spark, sf), "conv_id", "turn", {"s": P.transcript_len}, ["role", "text"],
                 block_rows=P.lookback_block_rows)
    return h.where(F.col("role") == "user").select("conv_id", "turn", D.transcript("s").alias("transcript"))


_STRIP_SQL = f"regexp_replace(text, {S.lit('^' + PY_SPACE_CLASS + '+|' + PY_SPACE_CLASS + '+$')}, '', 'g')"


# Exit messages derived from the table: in every conversation whose id leaves 3
# modulo 5 the user message at turn 2 becomes one (the table itself has none).
_EXITS = """(SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 3 AND turn = 2 AND role = 'user' THEN chr(12288) || ' Exit '
             ELSE text END AS text FROM conversations)"""


@query("session_truncate", f"""
WITH conv AS {_EXITS},
ex AS (SELECT conv_id, min(turn) AS first_exit FROM conv
            WHERE role = 'user' AND lower({_STRIP_SQL}) IN ('quit', 'exit') GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role FROM conv c LEFT JOIN ex USING (conv_id)
WHERE ex.first_exit IS NULL OR c.turn < ex.first_exit""")
def session_truncate(spark, sf):
    """Conversations cut before their exit message."""
    leaves = (F.col("conv_id") % 5 == 3) & (F.col("turn") == 2) & (F.col("role") == "user")
    conv = _conv(spark, sf).withColumn("text", F.when(leaves, F.lit("\u3000 Exit ")).otherwise(F.col("text")))
    return D.truncate_sessions(conv).select("conv_id", "turn", "role")


# Retrieval for dialogue: user messages against the page-derived KB.

def _kb(spark, sf):
    """The page-derived KB as an ingest stores it: one table with embeddings, so
    retrieval and hit projection are column-pruned scans of it."""
    from kbweave.config import scratch_path
    path = scratch_path(spark, "kb")
    K.kb_rows(K.entries_struct(X.page_entries(_pages(spark, sf))), P.text_dim).write.parquet(path)
    return spark.read.parquet(path)


def _kb_sql():
    return ORACLE["kb_documents"]


def _topk_ctes(q_table, q_id, d_table, d_id, dim, k):
    return f"""
dt AS ({_tf_sql(d_table, d_id, dim, 'doc_id')}),
qt AS ({_tf_sql(q_table, q_id, dim, 'query_id')}),
dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS n FROM dt GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qt GROUP BY 1),
dots AS (SELECT qt.query_id, dt.doc_id, sum(qt.tf * dt.tf) AS dot FROM qt JOIN dt USING (bucket) GROUP BY 1, 2),
s AS (SELECT q.{q_id} AS query_id, d.{d_id} AS doc_id, round(coalesce(dots.dot, 0) / nullif(qn.n * dn.n, 0), 12) AS sim
      FROM {q_table} q CROSS JOIN {d_table} d
      LEFT JOIN dots ON dots.query_id = q.{q_id} AND dots.doc_id = d.{d_id}
      LEFT JOIN qn ON qn.query_id = q.{q_id} LEFT JOIN dn ON dn.doc_id = d.{d_id}
      WHERE q.text IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, doc_id) AS rn FROM s),
top AS (SELECT query_id, rn AS rank, doc_id, sim FROM rk WHERE rn <= {k})"""


def _dialog_ctes(intents):
    return f"""
kb AS ({_kb_sql()}),
u AS (SELECT conv_id * 1000000 + turn AS qid, * FROM ({_classified_sql(intents)})),
bq AS (SELECT qid, text FROM u WHERE intent IS NULL),
{_topk_ctes('bq', 'qid', 'kb', 'doc_id', P.text_dim, P.top_k)},
hits AS (SELECT top.query_id, top.rank, top.sim, kb.text, kb.url FROM top JOIN kb USING (doc_id)),
agg AS (SELECT query_id, count(*) AS nh,
          string_agg('{D.BULLET}' || text || ' (Similarity: ' || printf('%.2f', sim) || ')', chr(10) ORDER BY rank) AS context,
          max(CASE WHEN rank = 1 THEN text END) AS answer,
          coalesce(string_agg(CASE WHEN url <> '' THEN '{D.BULLET}' || text || ': ' || url END, chr(10) ORDER BY rank), '') AS refs
        FROM hits GROUP BY 1),
tr AS (SELECT conv_id, turn, array_to_string(list(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {P.transcript_len - 1} PRECEDING AND CURRENT ROW), chr(10)) AS transcript
       FROM conversations),
d AS (SELECT u.conv_id, u.turn, u.text, u.intent, agg.nh, coalesce(agg.context, '') AS context,
             coalesce(agg.answer, '') AS answer, agg.refs, tr.transcript
      FROM u LEFT JOIN agg ON agg.query_id = u.qid JOIN tr ON tr.conv_id = u.conv_id AND tr.turn = u.turn)"""


def _prompt_sql():
    return (f"{S.lit('[Context]' + chr(10) + 'User Query: ')} || text || "
            f"{S.lit(chr(10) + chr(10) + '[Relevant Information]' + chr(10))} || context || "
            f"{S.lit(chr(10) + chr(10) + '[Previous Conversation]' + chr(10))} || transcript || "
            f"{S.lit(chr(10) + chr(10) + D.DEFAULT_INSTRUCTIONS)}")


def _reply_sql():
    return (f"answer || chr(10) || chr(10) || CASE WHEN coalesce(nh, 0) > 0 THEN "
            f"{S.lit(D.LINKS_HEADER + chr(10))} || refs ELSE '' END")


def _answers(spark, sf, intents=D.DEFAULT_INTENTS, kb=None):
    return A.answer_messages(_conv(spark, sf), _kb(spark, sf) if kb is None else kb, P, intents)


@query("context_lines", f"""
WITH {_dialog_ctes(D.DEFAULT_INTENTS)}
SELECT conv_id, turn, context FROM d WHERE intent IS NULL""")
def context_lines(spark, sf):
    a = _answers(spark, sf)
    return a.where(F.col("route") == "retrieval").select("conv_id", "turn", "context")


@query("prompt_build", f"""
WITH {_dialog_ctes(D.DEFAULT_INTENTS)}
SELECT conv_id, turn, {_prompt_sql()} AS prompt FROM d WHERE intent IS NULL""")
def prompt_build(spark, sf):
    a = _answers(spark, sf)
    return a.where(F.col("route") == "retrieval").select("conv_id", "turn", "prompt")


@query("answer_extractive", f"""
WITH {_dialog_ctes(D.DEFAULT_INTENTS)}
SELECT conv_id, turn, answer FROM d WHERE intent IS NULL""")
def answer_extractive(spark, sf):
    a = _answers(spark, sf)
    return a.where(F.col("route") == "retrieval").select("conv_id", "turn", "answer")


@query("answer_format", f"""
WITH {_dialog_ctes(D.DEFAULT_INTENTS)}
SELECT conv_id, turn, {_reply_sql()} AS reply FROM d WHERE intent IS NULL""")
def answer_format(spark, sf):
    a = _answers(spark, sf)
    return a.where(F.col("route") == "retrieval").select("conv_id", "turn", "reply")


@query("dialog_answers", f"""
WITH {_dialog_ctes(ALT_INTENTS)}
SELECT conv_id, turn, CASE WHEN intent IS NULL THEN 'business' ELSE 'conversational' END AS intent_type, intent,
       CASE WHEN intent IS NULL THEN 'retrieval' ELSE 'template' END AS route,
       CASE WHEN intent IS NULL THEN {_reply_sql()} ELSE {_template_sql()} END AS reply
FROM d""")
def dialog_answers(spark, sf, kb=None):
    """End to end: every user message answered (template or retrieval) from ``kb`` (default: one ingested now)."""
    a = _answers(spark, sf, ALT_INTENTS, kb)
    return a.select("conv_id", "turn", "intent_type", "intent", "route", "reply")


# ---------------------------------------------------------------- streaming
from kbweave.streaming import jobs as ST  # noqa: E402


@query("stream_kb", ORACLE["kb_documents"])
def stream_kb(spark, sf):
    """Incremental KB ingest (file stream, availableNow); equals kb_documents."""
    out = ST.ingest_kb_stream(spark, f"{sf.rstrip('/')}/pages.parquet")
    return spark.read.parquet(out).drop("embedding")


@query("stream_history", ORACLE["history_window"])
def stream_history(spark, sf):
    """Keyed-state bounded history; equals history_window on in-order input."""
    out = ST.history_stream(spark, f"{sf.rstrip('/')}/conversations.parquet", P)
    return spark.read.parquet(out).select("conv_id", "turn", "hist_len", "history")


@query("stream_topk", ORACLE["topk_text"])
def stream_topk(spark, sf):
    """Benchmark queries as a stream against the documents snapshot."""
    docs = _dealt(load_table(spark, sf, "documents", ["doc_id", "text"]))
    out = ST.topk_stream(spark, f"{sf.rstrip('/')}/benchmark.parquet",
                         T.StructType([T.StructField("item_id", T.LongType()),
                                       T.StructField("text", T.StringType())]),
                         docs, "item_id", P)
    return (spark.read.parquet(out)
            .select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity")))


@query("topk_by_type", f"""
WITH kb0 AS ({_kb_sql()}),
kb AS (SELECT * FROM kb0 WHERE doc_type = 'title'),
{_topk_ctes('benchmark', 'item_id', 'kb', 'doc_id', P.text_dim, P.top_k)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(sim, 6) AS similarity FROM top""")
def topk_by_type(spark, sf):
    """Retrieval scoped to one document type (titles) of the page-derived KB."""
    kb = _kb(spark, sf).where(F.col("doc_type") == "title")
    q = load_table(spark, sf, "benchmark", ["item_id", "text"])
    top = R.topk_stored(kb, q, P.top_k, query_id="item_id", dim=P.text_dim)
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


@query("topk_stored", f"""
WITH kb AS ({_kb_sql()}),
{_topk_ctes('benchmark', 'item_id', 'kb', 'doc_id', P.text_dim, P.top_k)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(sim, 6) AS similarity FROM top""")
def topk_stored(spark, sf, kb=None):
    """Every benchmark text against the vectors stored at ingest (default k)."""
    q = load_table(spark, sf, "benchmark", ["item_id", "text"])
    top = R.topk_stored(_kb(spark, sf) if kb is None else kb, q, query_id="item_id", dim=P.text_dim)
    return top.select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


@query("kb_embedded", f"WITH kb AS ({_kb_sql()}) {_tf_sql('kb', 'doc_id', P.text_dim)}")
def kb_embedded(spark, sf):
    """The non-zero entries of the embeddings that an ingest stores."""
    v = _kb(spark, sf).select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0")
    return v.select("doc_id", "bucket", F.col("x").cast("long").alias("tf"))


_GEN_SQL = f"""
WITH {_dialog_ctes(ALT_INTENTS)},
rep AS (SELECT conv_id, turn, text, intent, context,
               CASE WHEN intent IS NULL THEN {_reply_sql()} ELSE {_template_sql()} END AS reply FROM d),
lagged AS (SELECT *, lag(text, 1) OVER w AS t1, lag(reply, 1) OVER w AS r1,
                     lag(text, 2) OVER w AS t2, lag(reply, 2) OVER w AS r2
           FROM rep WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ent AS (SELECT *, list_filter(['User: ' || t2, 'Assistant: ' || r2, 'User: ' || t1, 'Assistant: ' || r1,
                               'User: ' || text], lambda x: x IS NOT NULL) AS e FROM lagged),
gen AS (SELECT *, array_to_string(e[greatest(len(e) - 2, 1):len(e)], chr(10)) AS transcript FROM ent)
SELECT conv_id, turn, {_prompt_sql()} AS prompt, reply FROM gen"""


@query("dialog_generated", _GEN_SQL)
def dialog_generated(spark, sf):
    """Generating mode: prompts show generated replies, not recorded rows."""
    g = A.generated_dialog(_conv(spark, sf), _kb(spark, sf), P, ALT_INTENTS)
    return g.select("conv_id", "turn", "prompt", "reply")


@query("stream_dialog", _GEN_SQL)
def stream_dialog(spark, sf):
    """Generating mode as two incremental stages with keyed history state."""
    out = ST.dialog_stream(spark, f"{sf.rstrip('/')}/conversations.parquet", _kb(spark, sf), P, ALT_INTENTS)
    return spark.read.parquet(out).select("conv_id", "turn", "prompt", "reply")


@query("entry_file_key", f"""
SELECT page_id, substr(md5({S.rules('html', S.MARKDOWN_RULES)}), 1, 8) AS fingerprint,
       '{run_stamp(P.run_ts)}_' || substr(md5({S.rules('html', S.MARKDOWN_RULES)}), 1, 8) AS entry_key
FROM pages""")
def entry_file_key(spark, sf):
    """Key of each page's structured-entry file: run stamp + fingerprint of
    the page's markdown (first 8 hex digits of its md5)."""
    from kbweave.functions.text import fingerprint
    md = X.page_markdown(_pages(spark, sf, ("page_id", "html")))
    fp = md.select("page_id", fingerprint("md").alias("fingerprint"))
    return fp.select("page_id", "fingerprint",
                     F.concat(F.lit(run_stamp(P.run_ts) + "_"), F.col("fingerprint")).alias("entry_key"))


@query("history_window_blocks", ORACLE["history_window"])
def history_window_blocks(spark, sf):
    """Same result as ``history_window`` through the skew-safe path forced on:
    global index + blocks of 100 rows with halos (what a conversation larger
    than a block would take)."""
    h = lookback(_conv(spark, sf), "conv_id", "turn", {"h": P.history_len}, ["role", "text"],
                 block_rows=100)
    return h.select("conv_id", "turn", F.size("h").alias("hist_len"),
                    F.array_join(F.transform("h", lambda m: F.concat(m["role"], F.lit(": "), m["text"])),
                                 "\n").alias("history"))


# ------------------------------------------------- model step with a callable

def _failing(texts):
    """Deterministic model: repeats the query's first line; refuses prompts of even length."""
    if any(len(t) % 2 == 0 for t in texts):
        raise ValueError("refused")
    return ["Re: " + t.split("\n")[1].removeprefix("User Query: ") for t in texts]


@query("failed_turns", f"""
WITH {_dialog_ctes(ALT_INTENTS)},
p AS (SELECT *, {_prompt_sql()} AS prompt FROM d)
SELECT conv_id, turn, CASE WHEN intent IS NULL THEN 'retrieval' ELSE 'template' END AS route,
       CASE WHEN intent IS NULL AND length(prompt) % 2 = 1 THEN 'Re: ' || string_split(prompt, chr(10))[2][13:] END AS answer,
       CASE WHEN intent IS NULL AND length(prompt) % 2 = 0 THEN 'ValueError: refused' END AS answer_error FROM p""")
def failed_turns(spark, sf):
    """The model step with a callable that fails on some prompts, retried and told apart."""
    a = A.answer_messages(_conv(spark, sf), _kb(spark, sf), P, ALT_INTENTS, model=_failing, sleep=lambda _: None)
    return a.select("conv_id", "turn", "route", "answer", "answer_error")


def _structuring(texts):
    """Deterministic model: an entry of the first line; broken JSON for short pages, no links for some."""
    import json
    out = []
    for t in texts:
        e = {"title": t.split("\n")[0], "content": t, "links": []}
        if len(t) % 5 == 0:
            del e["links"]
        j = json.dumps(e)
        out.append(j[:-2] if len(t) % 7 == 0 else f"```json\n{j}\n```" if len(t) % 3 == 0 else j)
    return out


@query("model_structuring", f"""
WITH m AS (SELECT page_id, {S.rules('html', S.MARKDOWN_RULES)} AS md FROM pages),
s AS (SELECT *, length(md) % 7 <> 0 AND length(md) % 5 <> 0 AS ok FROM m)
SELECT page_id, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN ok THEN string_split(md, chr(10))[1] END AS title, CASE WHEN ok THEN md END AS content FROM s""")
def model_structuring(spark, sf):
    """Markdown -> model -> clean -> parse -> validate, retried as one unit."""
    from kbweave.operators.model import structure_pages
    md = X.page_markdown(_pages(spark, sf, ("page_id", "html")))
    parsed = EN.parse_replies(structure_pages(md, _structuring, sleep=lambda _: None))
    return parsed.select("page_id", F.when(F.col("status") == "ok", "ok").otherwise("failed").alias("status"),
                         F.col("entry.title").alias("title"), F.col("entry.content").alias("content"))


@query("file_round_trip", f"""
WITH e AS ({_ENTRY_SQL})
SELECT substr(md5(content), 1, 8) AS fingerprint, title, content, CAST(len(links) AS INTEGER) AS n_links FROM e""")
def file_round_trip(spark, sf):
    """Entries written as JSON files and read back."""
    from kbweave.config import scratch_path
    from kbweave.functions.text import fingerprint
    from kbweave.sources import files as FS
    path = scratch_path(spark, "entries-json")
    e = X.page_entries(_pages(spark, sf)).withColumn("fingerprint", fingerprint("content"))
    FS.write_entries_json(e, path)
    return FS.read_entries_json(spark, path, lines=True).select(
        fingerprint("content").alias("fingerprint"), "title", "content", F.size("links").alias("n_links"))


@query("kb_append_dedup", ORACLE["kb_documents"])
def kb_append_dedup(spark, sf):
    """The pages ingested twice with dedup: every row is stored once."""
    from kbweave.config import scratch_path
    from kbweave.plans import jobs as J
    path = scratch_path(spark, "kb-append")
    for _ in range(2):
        J.ingest(spark, load_table(spark, sf, "pages"), path, dedup=True)
    return spark.read.parquet(path).drop("embedding")


# ------------------------------------ strict replies, rejections, stores, files

_HOSTILE = 8      # kinds of replies that json_strict makes of the pages


def _hostile(entries: DataFrame) -> DataFrame:
    """A reply per page, of the kind that its id says: what a JSON parser may take by mistake."""
    k = F.col("page_id") % _HOSTILE
    t = F.regexp_replace("title", r"[^A-Za-z0-9 ]", "")
    whole = F.concat(F.lit('{"title":"'), t, F.lit('","content":"c","links":[]}'))
    return entries.select("page_id", F.when(k == 1, F.replace(whole, F.lit('"'), F.lit("'")))
                          .when(k == 2, F.concat(F.lit('[["title","'), t, F.lit('"],["content","c"],["links",[]]]')))
                          .when(k == 3, F.replace(whole, F.lit('"c"'), F.lit("NaN")))
                          .when(k == 4, F.replace(whole, F.lit('{"title"'), F.lit('{"title":"first","title"')))
                          .when(k == 5, F.concat(whole, F.lit(" and more")))
                          .when(k == 6, F.concat(whole, F.lit('],[{"x":1}')))
                          .when(k == 7, F.replace(whole, F.lit('"links":[]'), F.lit('"links":null'))).otherwise(whole).alias("reply"))


@query("json_strict", f"""
SELECT page_id, CASE page_id % {_HOSTILE} WHEN 0 THEN 'ok' WHEN 4 THEN 'ok' WHEN 7 THEN 'ok' WHEN 2 THEN 'not_object' ELSE 'bad_json' END AS status,
       CASE WHEN page_id % {_HOSTILE} IN (0, 4, 7) THEN regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g') END AS title
FROM ({_ENTRY_SQL})""")
def json_strict(spark, sf):
    """Single quotes, pairs, NaN, repeated keys, trailing text and closed wrappers, parsed strictly."""
    p = EN.parse_replies(_hostile(X.page_entries(_pages(spark, sf))))
    return p.select("page_id", "status", F.col("entry.title").alias("title"))


def _touchy(texts):
    """Embedder that fails on some titles and gives others a vector of the wrong size."""
    if any(len(t) % 7 == 3 for t in texts):
        raise ValueError("refused")
    return [[1.0] * (P.text_dim + (len(t) % 11 == 5)) for t in texts]


@query("kb_rejected", f"""
WITH {_REPLY_SQL},
ok AS (SELECT page_id, json ->> 'title' AS title, json ->> 'content' AS content, json -> '$.links' AS lj FROM st WHERE status = 'ok'),
li AS (SELECT page_id, i, lj -> ('$[' || (i - 1) || ']') AS lk
       FROM (SELECT page_id, lj, unnest(generate_series(1, CASE WHEN json_type(lj) = 'ARRAY' THEN CAST(json_array_length(lj) AS BIGINT) ELSE 0 END)) AS i FROM ok)),
texts AS (SELECT page_id, title AS t FROM ok UNION ALL SELECT page_id, content FROM ok UNION ALL SELECT page_id, lk ->> 'text' FROM li),
f AS (SELECT page_id, bool_or(length(t) % 7 = 3) AS failed, bool_or(length(t) % 11 = 5) AS wide FROM texts GROUP BY 1),
u AS (SELECT page_id, bool_or(lk ->> 'text' IS NULL) AS no_text, bool_or(lk ->> 'url' IS NULL) AS no_url FROM li GROUP BY 1),
r AS (SELECT ok.page_id, CASE WHEN title IS NULL THEN 'null_title' WHEN content IS NULL THEN 'null_content'
        WHEN json_type(lj) <> 'ARRAY' THEN 'null_links' WHEN no_text THEN 'link_without_text' WHEN no_url THEN 'link_without_url'
        WHEN failed THEN 'embedding_failed' WHEN wide THEN 'wrong_dimension' END AS reason
      FROM ok LEFT JOIN f USING (page_id) LEFT JOIN u USING (page_id))
SELECT page_id, reason FROM r WHERE reason IS NOT NULL""")
def kb_rejected(spark, sf):
    """Parsed entries that are not stored, with the reason of each (null parts, failing embedder)."""
    good, _ = EN.split_quarantine(_parsed(spark, sf))
    return K.rejected(K.judged(good.select("page_id", "entry"), P.text_dim, _touchy)).select("page_id", "reason")


@query("kb_vector_store", """
WITH kb AS (""" + ORACLE["kb_documents"] + """), n AS (SELECT count(DISTINCT text) AS n FROM kb)
SELECT 1 AS run, n AS embedded, n AS stored FROM n UNION ALL SELECT 2, 0, n FROM n""")
def kb_vector_store(spark, sf):
    """Texts embedded and stored by an ingest, and by the same ingest once more."""
    from kbweave.config import scratch_path
    from kbweave.operators import vector_store as VS
    from kbweave.operators.hashing import hashed_vectors
    e = K.entries_struct(X.page_entries(_pages(spark, sf))).select("page_id", "entry")
    path, out = scratch_path(spark, "vectors"), None
    for run in (1, 2):
        before = VS.read_store(spark, path).count()
        VS.judged_by_store(e, path, P.text_dim, hashed_vectors(P.text_dim))
        row = VS.read_store(spark, path).select(F.count(F.lit(1)).alias("stored")).select(
            F.lit(run).alias("run"), (F.col("stored") - before).alias("embedded"), "stored")
        row = spark.createDataFrame(row.collect(), row.schema)           # one row, counted now
        out = row if out is None else out.unionByName(row)
    return out


@query("kb_versions", ORACLE["kb_documents"])
def kb_versions(spark, sf):
    """Pages stored as two batches, the second after a broken attempt and twice, read as their latest version."""
    from kbweave.config import scratch_path
    from kbweave.sources import kb_store as KS
    rows = K.kb_rows(K.entries_struct(X.page_entries(_pages(spark, sf))), P.text_dim)
    path = scratch_path(spark, "kb-batches")
    KS.append_batch(rows.withColumn("text", F.lit("old")), path, "b1")
    KS.write_data(rows.withColumn("text", F.lit("never committed")), path, "b2")
    for _ in range(2):
        KS.append_batch(rows, path, "b2")
    KS.write_data(rows, path, "b3")                                        # dies before its commit
    return KS.latest(KS.read_kb(spark, path)).drop("embedding")


@query("markdown_files", f"""
SELECT page_id, length(md) AS md_chars, md5(md) AS md_md5 FROM (SELECT page_id, {S.rules('html', S.MARKDOWN_RULES)} AS md FROM pages)""")
def markdown_files(spark, sf):
    """Every page's markdown written as a text file of its own (a row per source key in the table
    sink beside it), and the files read back whole."""
    from kbweave.config import scratch_path
    from kbweave.sources import files as FS
    path = scratch_path(spark, "markdown")
    md = X.source_keys(_pages(spark, sf), P).select("page_id", "page_key").join(X.page_markdown(_pages(spark, sf)), "page_id")
    FS.write_markdown(md.select(F.col("page_key").alias("source_key"), "md"), f"{path}/table")
    FS.write_markdown_files(md.select("page_id", "md"), f"{path}/files", "page_id")
    back = FS.read_text_files(spark, f"{path}/files")
    n = F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("long")
    text = F.regexp_replace("md", r"\n$", "")                              # the line sink ends the file
    return back.select(n.alias("page_id"), F.length(text).cast("long").alias("md_chars"), F.md5(F.encode(text, "UTF-8")).alias("md_md5"))


_MD_PLAIN = "regexp_replace(md, '!?\\[([^\\]\\[]*)\\]\\([^)\\s]*\\)', '\\1', 'g')"


@query("markdown_entries", rf"""
WITH m AS (SELECT page_id, {S.rules('html', S.MARKDOWN_RULES)} AS md FROM pages),
h AS (SELECT *, list_filter(string_split(md, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} +')) AS heads FROM m)
SELECT page_id, trim(regexp_replace(regexp_replace(CASE WHEN len(heads) > 0 THEN heads[1] ELSE string_split(md, chr(10))[1] END,
         '^#{{1,6}} +', ''), '!?\[([^\]\[]*)\]\([^)\s]*\)', '\1', 'g')) AS title,
       md5(array_to_string(list_transform(string_split({_MD_PLAIN}, chr(10)), lambda x: regexp_replace(x, '^#{{1,6}} +', '')), chr(10))) AS content_md5,
       CAST(len(regexp_extract_all(md, '\[[^\]\[]*\]\([^)\s]*\)')) - len(regexp_extract_all(md, '!\[[^\]\[]*\]\([^)\s]*\)')) AS INTEGER) AS n_links
FROM h""")
def markdown_entries(spark, sf):
    """Entries of the pages' markdown, as an ingest of markdown files makes them."""
    e = X.markdown_entries(X.page_markdown(_pages(spark, sf, ("page_id", "html"))))
    return e.select("page_id", "title", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), F.size("links").alias("n_links"))


# A lexicon of many keywords: every word of six letters or more of the documents.
_LEXICON_SQL = """
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS keyword FROM documents),
lex AS (SELECT keyword, ('0x' || substr(md5(keyword), 1, 7))::BIGINT AS priority,
               ['greeting', 'farewell', 'small_talk', 'off_topic'][CAST(('0x' || substr(md5(keyword), 8, 4))::BIGINT % 8 + 1 AS INTEGER)] AS intent
        FROM words)"""


@query("intent_lexicon_large", f"""
WITH {_LEXICON_SQL},
hits AS (SELECT c.conv_id, c.turn, min(struct_pack(p := priority, i := intent)) AS h
         FROM conversations c JOIN lex ON contains(c.text, lex.keyword) WHERE c.role = 'user' AND lex.intent IS NOT NULL GROUP BY 1, 2)
SELECT c.conv_id, c.turn, CASE WHEN h IS NULL THEN 'business' ELSE 'conversational' END AS intent_type, h.i AS intent, h IS NULL AS requires_search
FROM conversations c LEFT JOIN hits USING (conv_id, turn) WHERE c.role = 'user'""")
def intent_lexicon_large(spark, sf):
    """Every user message against a lexicon of all long words of the documents, in one pass each."""
    from kbweave.operators import lexicon as LX
    w = load_table(spark, sf, "documents", ["text"]).select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("keyword")).distinct()
    def u(start, n):
        return F.conv(F.substring(F.md5("keyword"), start, n), 16, 10).cast("long")
    names = F.array(*[F.lit(x) for x in ("greeting", "farewell", "small_talk", "off_topic")])
    lex = w.select("keyword", u(1, 7).alias("priority"), F.get(names, (u(8, 4) % 8).cast("int")).alias("intent")).where(F.col("intent").isNotNull())
    c = LX.classify_by_lexicon(_conv(spark, sf).where(F.col("role") == "user"), lex)
    return c.select("conv_id", "turn", "cls.intent_type", "cls.intent", "cls.requires_search")


@query("template_reply_table", ORACLE["template_reply"])
def template_reply_table(spark, sf):
    """``template_reply`` with lexicon and variants as tables."""
    lex = spark.createDataFrame([(i, name, w) for i, (name, ws) in enumerate(ALT_INTENTS) for w in ws], "priority int, intent string, keyword string")
    variants = spark.createDataFrame([(n, i, t) for n, vs in D.DEFAULT_TEMPLATES.items() for i, t in enumerate(vs)], "intent string, variant int, text string")
    u = _conv(spark, sf).where(F.col("role") == "user")
    c = D.classify_by_table(u, lex).where(F.col("cls.intent").isNotNull()).select("conv_id", "turn", F.col("cls.intent").alias("intent"))
    return D.template_reply_by_table(c, variants).select("conv_id", "turn", "intent", "reply")


# ------------------------------------------------------- streams and recurrences

@query("stream_history_blocks", ORACLE["history_window"])
def stream_history_blocks(spark, sf):
    """Bounded history from stored tails: the conversations arrive as four files, one a micro-batch,
    cut by turn so that most conversations go on in a later one."""
    from kbweave.config import scratch_path
    path = scratch_path(spark, "conversation-files")
    conv = _conv(spark, sf)
    for i in range(4):
        lo, hi = 2 * i, 2 * i + 2 if i < 3 else 1 << 60
        conv.where((F.col("turn") >= lo) & (F.col("turn") < hi)).coalesce(1).write.mode("append").parquet(path)
    out = ST.history_blocks_stream(spark, path, P, files_per_trigger=1)
    return spark.read.parquet(out).select("conv_id", "turn", "hist_len", "history")


@query("stream_topk_maintained", _TOPK_SELF)
def stream_topk_maintained(spark, sf):
    """Every stored vector as a standing query while the vectors arrive in four micro-batches."""
    from kbweave.config import scratch_path
    path = scratch_path(spark, "vector-files")
    e = load_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    e.repartition(4, "vec_id").write.parquet(path)
    out = ST.topk_maintained_stream(spark, path, e.schema, e, doc_id="vec_id", query_id="vec_id", dim=P.dim, files_per_trigger=1)
    return ST.latest_epoch(spark, out).select("query_id", "rank", "doc_id", r6(F.col("similarity")).alias("similarity"))


def _recalling(prompts):
    """Deterministic model whose answer depends on the whole prompt; refuses some prompts."""
    import hashlib
    out = []
    for p in prompts:
        h = hashlib.md5(p.encode()).hexdigest()
        if h[0] in "01":
            raise ValueError("refused")
        out.append(f"Re {h[:12]}")
    return out


_MODEL_SHOWN = "array_to_string(list_transform(h[greatest(len(h) - 2, 1):len(h)], lambda x: x), chr(10))"
_MODEL_SQL = f"""
WITH RECURSIVE {_dialog_ctes(ALT_INTENTS)},
msgs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM (
  SELECT conv_id, turn, text, intent, context, nh, refs, CASE WHEN intent IS NOT NULL THEN {_template_sql()} END AS fixed FROM d)),
rounds AS (
  SELECT CAST(0 AS BIGINT) AS no, conv_id, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS prompt, CAST(NULL AS VARCHAR) AS reply,
         CAST(NULL AS VARCHAR) AS answer_error, CAST([] AS VARCHAR[]) AS hist FROM (SELECT DISTINCT conv_id FROM msgs)
  UNION ALL
  SELECT no, conv_id, turn, prompt, reply, CASE WHEN intent IS NULL AND reply IS NULL THEN 'ValueError: refused' END,
         CASE WHEN reply IS NULL THEN h ELSE list_append(h, 'Assistant: ' || reply) END
  FROM (
    SELECT *, CASE WHEN intent IS NOT NULL THEN fixed WHEN md5(prompt)[1] IN ('0', '1') THEN NULL
                   ELSE 'Re ' || md5(prompt)[1:12] || chr(10) || chr(10) || CASE WHEN coalesce(nh, 0) > 0 THEN {S.lit(D.LINKS_HEADER + chr(10))} || refs ELSE '' END END AS reply
    FROM (
      SELECT *, {_prompt_sql()} AS prompt
      FROM (SELECT *, {_MODEL_SHOWN} AS transcript FROM (
        SELECT m.*, list_append(r.hist, 'User: ' || m.text) AS h FROM rounds r JOIN msgs m ON m.conv_id = r.conv_id AND m.no = r.no + 1)))))
SELECT conv_id, turn, prompt, reply, answer_error FROM rounds WHERE no > 0"""


@query("dialog_model", _MODEL_SQL)
def dialog_model(spark, sf):
    """Generating mode in batch with a model that answers the prompt it is shown, two turns a round."""
    from kbweave.plans.wavefront import generated_dialog_with_model
    return generated_dialog_with_model(_conv(spark, sf), _kb(spark, sf), _recalling, P, ALT_INTENTS, turns_per_round=2, sleep=lambda _: None)
