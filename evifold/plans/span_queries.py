"""Queries of spans, windows and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifold.operators import spans as S
from evifold.operators.events import source_id
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text", "title")


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    out = S.sentence_spans(_texts(spark, d), "doc_id", F.col("text"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max("end").cast("bigint").alias("last"), F.max(F.length("sentence")).cast("bigint").alias("longest"))


def window_ids(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", S.window_id(F.concat(F.lit("doc"), F.col("doc_id")), F.substring("text", 1, 500), F.lit(0), F.lit(500)).alias("window_id"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Browse steps as windows: the focus decides where a window of 900 characters begins."""
    rows = steps(spark, d).where("run_id is not null and a.action = 'browse' and a.source_id is not null")
    start = F.pmod(F.length(F.coalesce("a.reading_focus", F.lit(""))) * 37, F.lit(1_200)).cast("bigint")
    return rows.select("run_id", source_id(F.col("a.source_id")).alias("source"), "turn", "log_id", start.alias("start"), (start + 900).alias("end"))


def repeated_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated_windows(_windows(spark, d), ["source"], ["turn", "log_id"], "start", "end").select("log_id", "repeated")


def token_scopes(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d)
    spans = S.sentence_spans(docs, "doc_id", F.col("text")).select("doc_id", F.col("sentence_no").alias("span_id"), "start", "end")
    chars = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / 7)))).alias("token_no"), F.length("text").alias("_n"))
    tokens = chars.select("doc_id", "token_no", (F.col("token_no") * 7).alias("start"), F.least(F.col("token_no") * 7 + 7, F.col("_n")).alias("end"))
    return S.overlapping_tokens(spans, tokens, "doc_id").groupBy("doc_id").agg(F.sum("n").alias("pairs"), F.max("last").alias("last"))


def evidence_cards(spark: SparkSession, d: str) -> DataFrame:
    at = F.array(F.struct(F.lit(300).alias("start"), F.lit(340).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(30).alias("end")), F.struct(F.lit(100).alias("start"), F.lit(150).alias("end")), F.struct(F.lit(900).alias("start"), F.lit(950).alias("end")))
    return _texts(spark, d).select("doc_id", S.evidence_card(F.col("text"), at, 3, "|").alias("card"))


def table_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.table_windows(_texts(spark, d), "doc_id", F.col("text"), F.col("title"), 120).drop("window")


def word_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_rows").select("paper_row_id", S.word_prefix(F.col("abstract"), 120).alias("prefix"))


def sentence_previews(spark: SparkSession, d: str) -> DataFrame:
    sentences = S.sentence_spans(table(spark, d, "paper_rows"), "paper_row_id", F.col("abstract"))
    scored = sentences.withColumn("score", F.coalesce(F.regexp_count("sentence", F.lit("[0-9]+")), F.lit(0)))
    return S.sentence_preview(scored, "paper_row_id", "score", 300)


def context_account(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null")
    out = S.context_account(rows, ["run_id"], ["turn", "log_id"], F.ceil(F.octet_length("executed_action") / 3.15), 120, 400, 600)
    return out.select("log_id", "total", "state")


def preview_compaction(spark: SparkSession, d: str) -> DataFrame:
    out = S.fitting_rows(table(spark, d, "paper_rows").where("channel is not null"), ["channel", "pub_year"], [F.col("rank_no"), F.col("paper_row_id")], F.length("title"), 600)
    return out.select("paper_row_id", "used")


def longest_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null")
    return S.longest_first(rows, ["run_id"], "log_id", F.length("executed_action"), 60, 500).select("log_id", "kept")


def compacted_transcript(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null").withColumn("kind", F.coalesce("a.action", F.lit("none")))
    out = S.compacted_transcript(rows, ["run_id"], ["turn", "log_id"], F.col("kind"), F.length("executed_action"), 1, 100, 130)
    return out.select("log_id", F.col("kept_chars").cast("bigint").alias("kept_chars"))


def retention_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("run_id is not null")
    sig = F.concat_ws("|", "a.action", "a.channel", F.lower("a.query"), "a.source_id")
    out = S.retention_groups(rows, ["run_id"], ["turn", "log_id"], sig, F.col("feedback_status") != "ok", F.coalesce(F.col("a.action") == "stop", F.lit(False)), 3)
    return out.select("log_id", F.col("unit").cast("bigint").alias("unit"), F.col("rank").cast("bigint").alias("rank"), "kept")


def evidence_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs")
    return rows.select("output_id", S.projected(F.col("original_data"), ["lang"]).alias("projection"))


def trimmed_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paper_rows").where("abstract is not null").select(F.lower("doi").alias("doi"), "paper_row_id", "abstract")
    return S.trimmed_windows(rows.where("doi is not null"), ["doi"], ["paper_row_id"], "abstract").select("paper_row_id", F.length("trimmed").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_spans, window_ids, repeated_windows, token_scopes, evidence_cards, table_windows, word_prefixes, sentence_previews, context_account, preview_compaction, longest_first, compacted_transcript,
        retention_groups, evidence_projection, trimmed_edges,
    )
}

_SPANS = "sp AS (SELECT doc_id, sentence_no, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY sentence_no) AS e FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS sentence_no FROM (SELECT doc_id, regexp_extract_all(text, '{0}') AS p FROM documents WHERE text IS NOT NULL)))".format(S.SENTENCE)
_W = f"WITH {_STEPS}, w AS (SELECT trim(split_part(source, '#', 1)) AS src, turn, log_id, length(coalesce(focus, '')) * 37 % 1200 AS lo FROM s WHERE run_id IS NOT NULL AND action = 'browse' AND source IS NOT NULL)"
SQL = {
    "sentence_spans": f"WITH {_SPANS} SELECT doc_id, count(*) AS sentences, CAST(max(e) AS BIGINT) AS last, max(length(s)) AS longest FROM sp GROUP BY 1",
    "window_ids": "SELECT doc_id, 'doc' || doc_id || '-v' || substring(sha256(substring(text, 1, 500) || chr(31) || '0' || chr(31) || '500'), 1, 16) AS window_id FROM documents WHERE text IS NOT NULL",
    "repeated_windows": f"""{_W}, p AS (SELECT b.log_id, b.lo AS blo, a.lo AS lo, a.lo + 900 AS hi FROM w b LEFT JOIN w a ON a.src = b.src AND (a.turn, a.log_id) < (b.turn, b.log_id)),
o AS (SELECT *, max(hi) OVER (PARTITION BY log_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM p), i AS (SELECT *, sum(CASE WHEN far IS NULL OR lo > far THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM o),
g AS (SELECT log_id, blo, isl, min(lo) AS a, max(hi) AS b FROM i GROUP BY 1, 2, 3) SELECT log_id, bool_or(coalesce(a <= blo AND blo + 900 <= b, false)) AS repeated FROM g GROUP BY 1""",
    "token_scopes": f"WITH {_SPANS} SELECT doc_id, CAST(sum((e - 1) // 7 - (e - length(s)) // 7 + 1) AS BIGINT) AS pairs, CAST(max((e - 1) // 7) AS BIGINT) AS last FROM sp GROUP BY 1",
    "evidence_cards": "SELECT doc_id, substring(text, 1, 30) || '|' || substring(text, 101, 50) || '|' || substring(text, 301, 40) AS card FROM documents WHERE text IS NOT NULL",
    "word_prefixes": r"SELECT paper_row_id, CASE WHEN length(abstract) <= 120 THEN abstract WHEN regexp_extract(substring(abstract, 1, 121), '(?s)^(.*\S)\s', 1) <> '' THEN regexp_extract(substring(abstract, 1, 121), '(?s)^(.*\S)\s', 1) ELSE substring(abstract, 1, 120) END AS prefix FROM paper_rows",
    "sentence_previews": f"""WITH p AS (SELECT paper_row_id, unnest(p) AS s, generate_subscripts(p, 1) AS n FROM (SELECT paper_row_id, regexp_extract_all(abstract, '{S.SENTENCE}') AS p FROM paper_rows WHERE abstract IS NOT NULL)),
c AS (SELECT *, sum(length(s)) OVER (PARTITION BY paper_row_id ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, len(regexp_extract_all(s, '[0-9]+')) DESC, n ROWS UNBOUNDED PRECEDING) AS c FROM p)
SELECT paper_row_id, string_agg(s, '' ORDER BY n) AS preview, CAST(sum(length(s)) AS BIGINT) AS chars FROM c WHERE c <= 300 OR n = 1 GROUP BY 1""",
    "context_account": "WITH t AS (SELECT log_id, CAST(120 + coalesce(sum(ceil(strlen(executed_action) / 3.15)) OVER (PARTITION BY run_id ORDER BY turn, log_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS total FROM case_steps WHERE run_id IS NOT NULL) SELECT *, CASE WHEN total > 600 THEN 'hard' WHEN total > 400 THEN 'soft' ELSE 'ok' END AS state FROM t",
    "preview_compaction": "SELECT * FROM (SELECT paper_row_id, CAST(sum(coalesce(length(title), 0)) OVER (PARTITION BY channel, pub_year ORDER BY rank_no, paper_row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM paper_rows WHERE channel IS NOT NULL) WHERE used <= 600",
    "longest_first": """WITH z AS (SELECT run_id, log_id, coalesce(length(executed_action), 0) AS z FROM case_steps WHERE run_id IS NOT NULL), o AS (SELECT *, greatest(0, z - 60) AS spare, greatest(0, sum(z) OVER (PARTITION BY run_id) - 500) AS over FROM z),
b AS (SELECT *, coalesce(sum(spare) OVER (PARTITION BY run_id ORDER BY z DESC, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) SELECT log_id, CAST(z - least(spare, greatest(0, over - before)) AS BIGINT) AS kept FROM b""",
    "compacted_transcript": f"WITH {_STEPS}, k AS (SELECT log_id, coalesce(action, 'none') AS kind, coalesce(length(executed_action), 0) AS z, row_number() OVER (PARTITION BY run_id, coalesce(action, 'none') ORDER BY turn DESC, log_id DESC) AS b FROM s WHERE run_id IS NOT NULL) SELECT log_id, CASE WHEN kind = 'search' THEN least(z, 100) WHEN kind = 'browse' AND b > 1 THEN least(z, 130) ELSE z END AS kept_chars FROM k",
    "retention_groups": f"""WITH {_STEPS}, k AS (SELECT run_id, turn, log_id, coalesce(feedback_status <> 'ok', false) AS bad, coalesce(action = 'stop', false) AS st, concat_ws('|', action, channel, lower(query), source) AS sig FROM s WHERE run_id IS NOT NULL),
l AS (SELECT *, coalesce(lag(bad) OVER w AND lag(sig) OVER w = sig, false) AS linked FROM k WINDOW w AS (PARTITION BY run_id ORDER BY turn, log_id)),
u AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY turn, log_id ROWS UNBOUNDED PRECEDING) AS unit FROM l),
p AS (SELECT *, CASE WHEN bool_or(bad) OVER v THEN 0 WHEN bool_or(st) OVER v THEN 1 ELSE 2 END AS p FROM u WINDOW v AS (PARTITION BY run_id, unit)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY p, unit DESC) AS rank FROM p) SELECT log_id, CAST(unit AS BIGINT) AS unit, rank, rank <= 3 AS kept FROM r""",
    "evidence_projection": """WITH j AS (SELECT output_id, original_data->>'arm' AS a, original_data->>'id' AS i FROM eval_outputs WHERE original_data IS NOT NULL)
SELECT output_id, '{' || concat_ws(',', '"arm":"' || a || '"', '"id":"' || i || '"') || '}' AS projection FROM j UNION ALL SELECT output_id, NULL FROM eval_outputs WHERE original_data IS NULL""",
}
