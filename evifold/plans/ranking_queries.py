"""Queries of ranking and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.functions.ordered import running
from evifold.operators import ranking as R
from evifold.operators.blending import blended_top_k
from evifold.sources.tables import table

_T = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]')"
TITLES = "title is not null and doc_id % 20 = 0"


def _bm25_sql(text: str, query_rows: str, k1: str = "1.5", distinct: bool = False) -> str:
    plus = float(k1) + 1
    return f"""
docs AS (SELECT doc_id, {_T.format(text)} AS t FROM documents),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, greatest(1.0, avg(len(t))) AS avg_len FROM docs),
counts AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (SELECT query_id, term, {'1' if distinct else 'count(*)'} AS qtf FROM (SELECT query_id, unnest(t) AS term FROM ({query_rows})) GROUP BY query_id, term),
scores AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {plus} / (tf + {k1} * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM asked JOIN dfs USING (term) JOIN counts USING (term), stats GROUP BY query_id, doc_id)"""


_TITLE_ROWS = f"SELECT doc_id AS query_id, {_T.format('title')} AS t FROM documents WHERE {TITLES}"


_FIELDED = "repeat(coalesce(title, '') || ' ', 4) || ' ' || coalesce(text, '')"


def _title_top(spark: SparkSession, d: str, k: int, rank: str = "rank") -> DataFrame:
    docs = table(spark, d, "documents")
    return R.bm25_top_k(docs, docs.where(TITLES), "doc_id", F.concat_ws(" ", F.repeat(F.concat(F.coalesce("title", F.lit("")), F.lit(" ")), 4), F.col("text")), "doc_id", F.col("title"), k, rank=rank)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _title_top(spark, d, 10).select("query_id", "doc_id", "score", "rank")


def bm25_anchor_blend(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return _paired_blend(docs)
    body = F.concat_ws(" ", F.repeat(F.concat(F.coalesce("title", F.lit("")), F.lit(" ")), 4), F.col("text"))
    return blended_top_k(docs, "doc_id", body, docs.where(TITLES), "doc_id", F.col("title"), F.col("snippet"), 10).select("query_id", "doc_id", "score", "rank")


def _paired_blend(docs: DataFrame) -> DataFrame:
    """The blend over all pairs of query and document, for tables where rows share an id or have none: their scores are added up."""
    body = F.concat_ws(" ", F.repeat(F.concat(F.coalesce("title", F.lit("")), F.lit(" ")), 4), F.col("text"))
    focus = R.bm25(docs, docs.where(TITLES), "doc_id", body, "doc_id", F.col("title")).withColumnRenamed("score", "focus")
    anchor = R.bm25(docs, docs.where("snippet is not null and doc_id % 20 = 0"), "doc_id", body, "doc_id", F.col("snippet"), distinct_query=True)
    both = focus.join(anchor.withColumnRenamed("score", "anchor"), ["query_id", "doc_id"], "left")
    score = F.round(R.max_normalised("focus", ["query_id"], 0.8) + R.max_normalised("anchor", ["query_id"], 0.2), 6)
    return R.top_k(both.withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("doc_id")], 10).select("query_id", "doc_id", "score", "rank")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title is not null")
    best = R.bm25_top_k(docs, docs.where("doc_id % 20 = 0"), "doc_id", F.concat_ws(" ", "title", "title", "snippet"), "doc_id", F.col("title"), 8, k1=1.2, distinct_query=True)
    return best.select("query_id", "doc_id", "score", "rank")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return R.dense_top_k(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", "embedding", 10).select("query_id", "vec_id", "score", "rank")


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    lexical = _title_top(spark, d, 8, "r1").select("query_id", "doc_id", "r1")
    docs = table(spark, d, "documents")
    plain = R.bm25_top_k(docs, docs.where("snippet is not null and doc_id % 20 = 0"), "doc_id", F.col("text"), "doc_id", F.col("snippet"), 8, rank="r2")
    return lexical.join(plain.select("query_id", "doc_id", "r2"), ["query_id", "doc_id"], "full")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = _two_lists(spark, d).withColumn("rrf", F.round(R.reciprocal_rank("r1", "r2"), 9))
    return R.top_k(fused, ["query_id"], [F.desc("rrf"), F.asc("doc_id")], 12).select("query_id", "doc_id", "rrf", "rank")


def section_diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    best = _title_top(spark, d, 40)
    named = best.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.group_diverse(named, ["query_id"], "source", [F.asc("rank")], 8).select("query_id", "doc_id", "source", "rank", "selected")


def domain_diverse_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("score is not null and doc_kind = 'web_page'").select("doc_id", "lang", "source", "title", (F.col("score") * 100).alias("points"))
    keyed = docs.withColumn("lang", F.coalesce("lang", F.lit("none")))
    ranked = R.domain_diverse(keyed, ["lang"], "source", "points", "title", "doc_id")
    return ranked.select("lang", "doc_id", F.round("adjusted", 4).alias("adjusted"), "rank")


def round_robin_fuse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("pmid is not null and rank_no is not null and channel is not null")
    lists = rows.select("pub_year", "pmid", "channel", "rank_no").where("pub_year is not null")
    fused = R.round_robin_fuse(lists, ["pub_year"], "pmid", "channel", "rank_no")
    return fused.select("pub_year", "pmid", "first_rank", "first_list", "position")


def source_priority_blend(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title is not null")
    words = docs.select("doc_id", "source", R.distinct_tokens(F.col("title")).alias("t"), R.distinct_tokens(F.col("snippet")).alias("s"), R.distinct_tokens(F.col("text")).alias("x"), F.col("score").isNotNull().cast("int").alias("has_score"))
    blend = F.round(0.6 * R.overlap_share(F.col("t"), F.col("x")) + 0.4 * R.overlap_share(F.col("s"), F.col("x")), 6)
    narrow = words.select("source", "doc_id", "has_score", blend.alias("blend"))
    return running(narrow, ["source"], [F.desc("blend"), F.desc("has_score"), F.asc("doc_id")], "rank").drop("has_score")


def bigram_phrase_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("title is not null")
    words = docs.select("doc_id", R.tokens(F.col("title")).alias("q"), R.tokens(F.col("text")).alias("t"))
    shared = F.size(F.array_intersect(R.bigrams(F.col("q")), R.bigrams(F.col("t"))))
    overlap = R.overlap_share(F.array_distinct("q"), F.array_distinct("t"))
    return words.select("doc_id", shared.cast("bigint").alias("shared_bigrams"), F.round(80 * overlap + 20 * F.least(F.lit(2), shared), 6).alias("points"))


def alias_components(spark: SparkSession, d: str) -> DataFrame:
    rows = paper_aliases(table(spark, d, "paper_rows"))
    edges = rows.where("size(aliases) > 0").select(F.explode("aliases").alias("a"), F.col("aliases")[0].alias("b"))
    return R.components(edges, "a", "b")


def paper_aliases(rows: DataFrame) -> DataFrame:
    """``rows`` with ``aliases``: PMID, DOI and S2 identities of a paper row, in this order; never titles."""
    pmid = F.regexp_replace(F.coalesce("pmid", F.lit("")), "^PMID:", "")
    pmid = F.when((pmid == "") & F.col("source_id").startswith("PMID:"), F.substring("source_id", 6, 100)).otherwise(pmid)
    doi = F.regexp_replace(F.lower(F.trim(F.coalesce("doi", F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    listed = F.array(
        F.when(pmid.rlike("^[0-9]+$"), F.concat(F.lit("PMID:"), pmid)),
        F.when(doi.startswith("10.") & doi.contains("/"), F.concat(F.lit("DOI:"), doi)),
        F.when(F.col("paper_id").rlike("^[0-9a-fA-F]{40}$"), F.concat(F.lit("S2:"), F.lower("paper_id"))),
    )
    return rows.withColumn("aliases", F.array_compact(listed))


def identity_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Papers fused over shared identities: canonical id (PMID before S2; groups without either vanish), channels, RRF."""
    rows = paper_aliases(table(spark, d, "paper_rows")).where("size(aliases) > 0 and channel is not null and rank_no is not null")
    edges = rows.select(F.explode("aliases").alias("a"), F.col("aliases")[0].alias("b"))
    member = R.components(edges, "a", "b")
    named = member.groupBy("component").agg(
        F.coalesce(F.min(F.when(F.col("node").startswith("PMID:"), F.col("node"))), F.min(F.when(F.col("node").startswith("S2:"), F.col("node")))).alias("paper"), F.count(F.lit(1)).alias("n_aliases")
    )
    placed = rows.select("channel", "rank_no", F.col("aliases")[0].alias("node")).join(member, "node")
    best = placed.groupBy("component", "channel").agg(F.min("rank_no").alias("r"))
    fused = best.groupBy("component").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("rrf"), F.count(F.lit(1)).alias("n_channels"))
    return fused.join(named.where("paper is not null"), "component").select("paper", "n_aliases", "n_channels", "rrf")


_ALIASES = r"""
al AS (SELECT paper_row_id, channel, rank_no,
  CASE WHEN regexp_replace(coalesce(pmid, ''), '^PMID:', '') = '' AND starts_with(source_id, 'PMID:') THEN substr(source_id, 6) ELSE regexp_replace(coalesce(pmid, ''), '^PMID:', '') END AS p,
  regexp_replace(lower(trim(coalesce(doi, ''))), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '') AS o, paper_id AS s FROM paper_rows),
ids AS (SELECT paper_row_id, channel, rank_no, list_filter([
  CASE WHEN regexp_full_match(p, '[0-9]+') THEN 'PMID:' || p END, CASE WHEN starts_with(o, '10.') AND contains(o, '/') THEN 'DOI:' || o END,
  CASE WHEN regexp_full_match(s, '[0-9a-fA-F]{40}') THEN 'S2:' || lower(s) END], lambda x: x IS NOT NULL) AS a FROM al),
e AS (SELECT DISTINCT unnest(a) AS x, a[1] AS y FROM ids WHERE len(a) > 0 {where}),
n AS (SELECT x AS node FROM e UNION SELECT y FROM e),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT node, node AS c FROM n UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON r.node = b.x),
member AS (SELECT node, min(c) AS component FROM reach GROUP BY node)"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_anchor_blend, history_window, dense_topk, rrf_fusion, section_diverse_topk, domain_diverse_rank, round_robin_fuse, source_priority_blend, bigram_phrase_score, alias_components, identity_fuse)}

_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, doc_id)"
_SNIPPETS = f"SELECT doc_id AS query_id, {_T.format('snippet')} AS t FROM documents WHERE snippet IS NOT NULL AND doc_id % 20 = 0"


def _renamed(sql: str, suffix: str) -> str:
    """The same common table expressions under other names."""
    for name in ("docs", "stats", "counts", "dfs", "asked", "scores"):
        sql = sql.replace(f"{name} AS (", f"{name}{suffix} AS (").replace(f"FROM {name} ", f"FROM {name}{suffix} ").replace(f"FROM {name})", f"FROM {name}{suffix})").replace(f"JOIN {name} ", f"JOIN {name}{suffix} ").replace(f", {name} GROUP", f", {name}{suffix} GROUP")
    return sql


SQL = {
    "bm25_topk": f"WITH {_bm25_sql(_FIELDED, _TITLE_ROWS)}, r AS (SELECT *, {_TOP.format('score')} AS rank FROM scores) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10",
    "bm25_anchor_blend": f"""WITH {_bm25_sql(_FIELDED, _TITLE_ROWS)}, {_renamed(_bm25_sql(_FIELDED, _SNIPPETS, distinct=True), '2')},
b AS (SELECT s.query_id, s.doc_id, s.score AS f, t.score AS a FROM scores s LEFT JOIN scores2 t USING (query_id, doc_id)),
m AS (SELECT *, max(f) OVER w AS fm, max(a) OVER w AS am FROM b WINDOW w AS (PARTITION BY query_id)),
x AS (SELECT query_id, doc_id, round(CASE WHEN fm > 0 THEN 0.8 * f / fm ELSE 0 END + CASE WHEN am > 0 THEN 0.2 * coalesce(a, 0) / am ELSE 0 END, 6) AS score FROM m),
r AS (SELECT *, {_TOP.format('score')} AS rank FROM x) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""",
    "history_window": f"WITH {_bm25_sql('title || chr(32) || title || chr(32) || coalesce(snippet, chr(32))', _TITLE_ROWS, '1.2', True).replace('FROM documents),', 'FROM documents WHERE title IS NOT NULL),', 1)}, r AS (SELECT *, {_TOP.format('score')} AS rank FROM scores) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 8",
    "dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v, v q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""",
    "rrf_fusion": f"""WITH {_bm25_sql(_FIELDED, _TITLE_ROWS)}, {_renamed(_bm25_sql('text', _SNIPPETS), '2')},
a AS (SELECT * FROM (SELECT query_id, doc_id, {_TOP.format('score')} AS r1 FROM scores) WHERE r1 <= 8), b AS (SELECT * FROM (SELECT query_id, doc_id, {_TOP.format('score')} AS r2 FROM scores2) WHERE r2 <= 8),
f AS (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + r1), 0.0) + coalesce(1.0 / (60 + r2), 0.0), 9) AS rrf FROM a FULL JOIN b USING (query_id, doc_id)),
r AS (SELECT *, {_TOP.format('rrf')} AS rank FROM f) SELECT query_id, doc_id, rrf, rank FROM r WHERE rank <= 12""",
    "section_diverse_topk": f"""WITH {_bm25_sql(_FIELDED, _TITLE_ROWS)}, r AS (SELECT *, {_TOP.format('score')} AS rank FROM scores), b AS (SELECT query_id, doc_id, rank, source FROM r JOIN documents USING (doc_id) WHERE rank <= 40),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 AS later FROM b),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, rank) AS selected FROM l) SELECT query_id, doc_id, source, rank, selected FROM s WHERE selected <= 8""",
    "domain_diverse_rank": """WITH p AS (SELECT doc_id, coalesce(lang, 'none') AS lang, source, title, score * 100 AS points FROM documents WHERE score IS NOT NULL AND doc_kind = 'web_page'),
a AS (SELECT *, points - 30.0 * (row_number() OVER (PARTITION BY lang, source ORDER BY points DESC, title DESC NULLS LAST, doc_id) - 1) AS adjusted FROM p)
SELECT lang, doc_id, round(adjusted, 4) AS adjusted, row_number() OVER (PARTITION BY lang ORDER BY adjusted DESC, title DESC NULLS LAST, doc_id) AS rank FROM a""",
    "round_robin_fuse": """WITH f AS (SELECT pub_year, pmid, min({'r': rank_no, 'l': channel}) AS place FROM paper_rows WHERE pmid IS NOT NULL AND rank_no IS NOT NULL AND channel IS NOT NULL AND pub_year IS NOT NULL GROUP BY pub_year, pmid)
SELECT pub_year, pmid, place.r AS first_rank, place.l AS first_list, row_number() OVER (PARTITION BY pub_year ORDER BY place.r, place.l, pmid) AS position FROM f""",
    "source_priority_blend": f"""WITH w AS (SELECT doc_id, source, list_distinct({_T.format('title')}) AS t, list_distinct({_T.format('snippet')}) AS s, list_distinct({_T.format('text')}) AS x, score IS NOT NULL AS h FROM documents WHERE title IS NOT NULL),
b AS (SELECT doc_id, source, h, round(0.6 * (len(list_intersect(t, x)) / greatest(1, len(t))) + 0.4 * (len(list_intersect(s, x)) / greatest(1, len(s))), 6) AS blend FROM w)
SELECT source, doc_id, blend, row_number() OVER (PARTITION BY source ORDER BY blend DESC, h DESC, doc_id) AS rank FROM b""",
    "bigram_phrase_score": f"""WITH w AS (SELECT doc_id, {_T.format('title')} AS q, {_T.format('text')} AS t FROM documents WHERE title IS NOT NULL),
g AS (SELECT doc_id, list_distinct(list_transform(q[1:len(q)-1], lambda x, i: x || ' ' || q[i+1])) AS qb, list_distinct(list_transform(t[1:len(t)-1], lambda x, i: x || ' ' || t[i+1])) AS tb, list_distinct(q) AS q, list_distinct(t) AS t FROM w)
SELECT doc_id, CAST(len(list_intersect(qb, tb)) AS BIGINT) AS shared_bigrams, round(80 * (len(list_intersect(q, t)) / greatest(1, len(q))) + 20 * least(2, len(list_intersect(qb, tb))), 6) AS points FROM g""",
    "alias_components": "WITH RECURSIVE " + _ALIASES.replace("{where}", "") + " SELECT node, component FROM member",
    "identity_fuse": "WITH RECURSIVE " + _ALIASES.replace("{where}", "AND channel IS NOT NULL AND rank_no IS NOT NULL") + """,
named AS (SELECT component, coalesce(min(node) FILTER (starts_with(node, 'PMID:')), min(node) FILTER (starts_with(node, 'S2:'))) AS paper, count(*) AS n_aliases FROM member GROUP BY component),
best AS (SELECT component, channel, min(rank_no) AS r FROM ids JOIN member ON node = a[1] WHERE len(a) > 0 AND channel IS NOT NULL AND rank_no IS NOT NULL GROUP BY component, channel),
fused AS (SELECT component, round(sum(1.0 / (60 + r)), 9) AS rrf, count(*) AS n_channels FROM best GROUP BY component)
SELECT paper, n_aliases, n_channels, rrf FROM fused JOIN named USING (component) WHERE paper IS NOT NULL""",
}
