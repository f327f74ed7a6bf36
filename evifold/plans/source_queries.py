"""Queries of readers, event logs, calls and operators over single texts, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evifold.operators import credit as C
from evifold.operators import passages as P
from evifold.operators import selection as L
from evifold.operators import traces as X
from evifold.operators import windows as V
from evifold.plans.checkpoints import checkpoint_dir
from evifold.plans.event_queries import _STEPS, steps
from evifold.sources import readers as S
from evifold.sources.tables import table


def _scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "case_steps").where("run_id is not null and feedback_status is not null")
    return rows.select(F.col("run_id").alias("run"), F.when(F.col("feedback_status") == "ok", "state").otherwise("failure").alias("kind"), F.col("log_id").alias("seq"), F.coalesce("error_code", F.lit("none")).alias("data"))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "events")
    S.append_events(_log(spark, d), path)
    return S.scan_events(spark, path, kind="failure").groupBy("data").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


def checkpoint_state(spark: SparkSession, d: str) -> DataFrame:
    return S.checkpoint_state(_log(spark, d))


def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    return S.next_sequence(_log(spark, d)).select("run", "seq", "kind", "data")


def call_receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("a.query is not null").select("log_id", F.col("a.query").alias("key"), "feedback_status")
    status = F.when(F.col("s") == "ok", "complete").when(F.col("s") == "timeout", "pending").otherwise("failed")
    receipts = rows.where("log_id % 2 = 0").groupBy("key").agg(F.max("feedback_status").alias("s"), F.max("log_id").cast("string").alias("data")).select("key", status.alias("status"), "data")
    return S.once(rows.select("log_id", "key"), receipts).select("log_id", "step", "receipt")


def csv_benchmark(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "benchmark")
    pool = table(spark, d, "exclusion_pool").select("problem", F.col("accepted_answer").alias("answer"))
    pool.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', quoteAll=True)
    read = S.read_csv_benchmark(spark, path)
    return read.select("id", F.length("problem").alias("chars"), F.md5(F.col("answers")[0]).alias("answer"))


def conversation_benchmark(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "conversations")
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pool = table(spark, d, "exclusion_pool").where("problem is not null and accepted_answer is not null")
    pool.select(F.col("question_id").alias("prompt_id"), F.array(turn("user", F.col("problem")), turn("assistant", F.col("accepted_answer"))).alias("prompt")).write.json(path)
    return S.read_conversation_benchmark(spark, path).select("id", F.md5("problem").alias("problem"))


def answer_sets(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("title is not null")
    kind = F.when(F.col("paper_row_id") % 2 == 0, "Set Answer").otherwise("Single Answer")
    answers = S.set_answers(F.concat_ws(",", "title", F.lit(" "), "pub_year"), kind)
    return papers.select("paper_row_id", F.array_join(answers, "|").alias("answers"), F.size(answers).cast("bigint").alias("n"), S.sample_size(F.col("paper_row_id")).cast("bigint").alias("sample"))


def content_addressed(spark: SparkSession, d: str) -> DataFrame:
    return S.content_addressed(table(spark, d, "documents"), "text").select("sha256", F.length("body").cast("bigint").alias("chars"))


def summary_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "summary")
    rows = table(spark, d, "case_steps").select("log_id", "arm", F.col("new_evidence_ids").alias("issues"))
    S.write_summary_csv(rows, path, ["log_id", "arm", "issues"], ["log_id"])
    back = spark.read.csv(path, header=True, schema="log_id bigint, arm string, issues string")
    return back.select("log_id", "arm", F.coalesce("issues", F.lit("")).alias("issues"))


def xml_documents(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("title is not null and abstract is not null")
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"\s+", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit('<?xml version="1.0"?><article><front><article-meta><title-group><article-title>'), safe(F.col("title")), F.lit("</article-title></title-group><abstract><p>"), safe(F.col("abstract")), F.lit("</p></abstract></article-meta></front></article>"))
    parsed = P.parse_sections(papers.select("paper_row_id", xml.alias("xml")), "paper_row_id", "xml")
    return parsed.select(F.col("item_id").alias("paper_row_id"), "title", F.size("sections").cast("bigint").alias("sections"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = steps(spark, d).where("a.query is not null and a.channel is not null")
    text = F.concat(F.lit('thinking <tool name="search" channel="'), F.col("a.channel"), F.lit('">'), F.col("a.query"), F.lit("</tool> then"))
    call = X.tool_call(text)
    return rows.select("log_id", call["tool"].alias("tool"), call["attributes"]["channel"].alias("channel"), call["body"].alias("body"))


def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_outputs").where("original_data is not null")
    torn = F.concat(F.lit("```json\n"), F.regexp_replace("original_data", r"\}$", ",}"), F.lit("\n```"))
    return rows.select("output_id", F.get_json_object(X.repair_json(torn), "$.id").alias("id"))


def preview_texts(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("title is not null")
    return papers.select("paper_row_id", X.preview_text(F.concat(F.lit("<b>"), F.col("title"), F.lit("</b>&amp;  x"))).alias("preview"))


def aligned_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return V.aligned_windows(docs, "doc_id", F.col("text"), F.lit(500), F.lit(1_400))


def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return V.clipped_texts(docs, "doc_id", F.col("text"), 80, 400).select("doc_id", F.length("clipped").alias("chars"))


def unread_first(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("channel is not null and pub_year is not null")
    state = F.when(F.col("rank_no") % 4 == 0, "blocked").when(F.col("rank_no") % 4 == 1, "read").when(F.col("rank_no") % 4 == 2, "unread")
    out = L.unread_first(papers.withColumn("state", state).withColumn("pos", F.col("rank_no") * 1_000_000 + F.col("paper_row_id")), ["channel", "pub_year"], "pos", "state")
    return out.select("paper_row_id", "slot")


def above_threshold(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null")
    return L.above_threshold(docs, ["source"], "score", "doc_id", 0.5, 5).select("source", "doc_id", "rank")


def anchored_queries(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "paper_rows").where("title is not null and abstract is not null")
    return papers.select("paper_row_id", L.anchored_query(F.col("abstract"), F.col("title"), 64, 32).alias("query"))


def token_surrogate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_tax", (F.col("l_quantity") / 100).alias("q")))).alias("t"))
    part = lambda name: F.transform("t", lambda x: x[name])
    value = C.token_surrogate(part("l_discount"), part("l_tax"), part("q"), F.lit(0.5), 1.2)
    return rows.select("l_orderkey", F.round(F.aggregate(value, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        event_log, checkpoint_state, event_sequence, call_receipts, csv_benchmark, conversation_benchmark, answer_sets, content_addressed, summary_csv, xml_documents, tool_calls, repaired_json, preview_texts, aligned_windows,
        clipped_texts, unread_first, above_threshold, anchored_queries, token_surrogate,
    )
}

_LOG = "log AS (SELECT run_id AS run, CASE WHEN feedback_status = 'ok' THEN 'state' ELSE 'failure' END AS kind, log_id AS seq, coalesce(error_code, 'none') AS data FROM case_steps WHERE run_id IS NOT NULL AND feedback_status IS NOT NULL)"
SQL = {
    "event_log": f"WITH {_LOG} SELECT data, count(*) AS n, max(seq) AS last FROM log WHERE kind = 'failure' GROUP BY 1",
    "checkpoint_state": f"WITH {_LOG} SELECT run, arg_max(data, seq) AS data FROM log WHERE kind = 'state' GROUP BY 1",
    "event_sequence": f"WITH {_LOG} SELECT run, row_number() OVER (PARTITION BY run ORDER BY seq, kind, data) AS seq, kind, data FROM log",
    "call_receipts": f"""WITH {_STEPS}, r AS (SELECT query AS key, max(feedback_status) AS st, CAST(max(log_id) AS VARCHAR) AS data FROM s WHERE query IS NOT NULL AND log_id % 2 = 0 GROUP BY 1)
SELECT log_id, CASE WHEN key IS NULL THEN 'call' WHEN st = 'ok' THEN 'reuse' WHEN st = 'timeout' THEN 'error' ELSE 'fail' END AS step, CASE WHEN st = 'ok' THEN data END AS receipt FROM s LEFT JOIN r ON query = key WHERE query IS NOT NULL""",
    "csv_benchmark": "SELECT md5(problem) AS id, length(problem) AS chars, md5(accepted_answer) AS answer FROM exclusion_pool",
    "conversation_benchmark": "SELECT question_id AS id, md5('Patient: ' || problem || chr(10) || chr(10) || 'Physician: ' || accepted_answer) AS problem FROM exclusion_pool WHERE problem IS NOT NULL AND accepted_answer IS NOT NULL",
    "answer_sets": """WITH a AS (SELECT paper_row_id, concat_ws(',', title, ' ', pub_year) AS t FROM paper_rows WHERE title IS NOT NULL), l AS (SELECT paper_row_id, CASE WHEN paper_row_id % 2 = 0 THEN list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') ELSE [t] END AS l FROM a)
SELECT paper_row_id, array_to_string(l, '|') AS answers, len(l) AS n, least(greatest(100, CAST(floor(0.2 * paper_row_id) AS BIGINT)), 500) AS sample FROM l""",
    "content_addressed": "SELECT sha256(text) AS sha256, any_value(length(text)) AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "summary_csv": "SELECT log_id, arm, coalesce(array_to_string(new_evidence_ids, ' | '), '') AS issues FROM case_steps",
    "xml_documents": r"SELECT paper_row_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, CASE WHEN trim(abstract) = '' THEN 0 ELSE 1 END AS sections FROM paper_rows WHERE title IS NOT NULL AND abstract IS NOT NULL",
    "tool_calls": rf"WITH {_STEPS} SELECT log_id, 'search' AS tool, channel, regexp_replace(query, '^\s+|\s+$', '', 'g') AS body FROM s WHERE query IS NOT NULL AND channel IS NOT NULL",
    "repaired_json": "SELECT output_id, original_data->>'id' AS id FROM eval_outputs WHERE original_data IS NOT NULL",
    "preview_texts": r"SELECT paper_row_id, trim(regexp_replace(title, '\s+', ' ', 'g')) || ' & x' AS preview FROM paper_rows WHERE title IS NOT NULL",
    "unread_first": """WITH x AS (SELECT *, CASE rank_no % 4 WHEN 1 THEN 1 ELSE 0 END AS r, rank_no * 1000000 + paper_row_id AS pos FROM paper_rows WHERE channel IS NOT NULL AND pub_year IS NOT NULL AND coalesce(rank_no % 4 <> 0, true))
SELECT paper_row_id, row_number() OVER (PARTITION BY channel, pub_year ORDER BY r, pos NULLS FIRST) AS slot FROM x""",
    "above_threshold": "SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM documents WHERE source IS NOT NULL AND score >= 0.5) WHERE rank <= 5",
    "token_surrogate": """WITH t AS (SELECT l_orderkey, l_discount - l_tax AS d, l_tax - l_quantity / 100 AS o FROM lineitem) SELECT l_orderkey, round(sum(least(exp(o), 1.2) * least(exp(d) * 0.5, greatest(0.8, least(1.2, exp(d))) * 0.5)), 6) AS total FROM t GROUP BY 1""",
}
