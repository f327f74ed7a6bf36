"""Sources and sinks: benchmark files, event logs, receipts and caches (SRC)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLE = ["id", "problem", "additional_instructions", "answers"]
CONVERSATION = "prompt_id string, prompt array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,points:double,tags:array<string>>>"
EVENT = "run string, kind string, seq bigint, data string"


def _example(df: DataFrame, id_: Column, problem: Column, answers: Column | None = None, instructions: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(id_.alias("id"), problem.alias("problem"), (none.cast("string") if instructions is None else instructions).alias("additional_instructions"), (none.cast("array<string>") if answers is None else answers).alias("answers"))


def read_csv_benchmark(spark: SparkSession, path: str, problem: str = "problem", answer: str = "answer") -> DataFrame:
    """Examples of a CSV file with a header; quoted fields may hold line breaks; the id is the MD5 of the problem."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return _example(raw, F.md5(problem), F.col(problem), F.array(F.col(answer)))


def read_conversation_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a JSON-lines file of conversations: earlier turns become one text, the last one is the question. Blank lines give none."""
    raw = spark.read.schema(CONVERSATION).json(path).where("prompt_id is not null")
    turns = F.transform("prompt", lambda m: F.concat(F.when(m["role"] == "user", "Patient").otherwise("Physician"), F.lit(": "), m["content"]))
    return _example(raw, F.col("prompt_id"), F.array_join(turns, "\n\n"))


def set_answers(answer: Column, kind: Column) -> Column:
    """Answers of a set, split at commas, trimmed, empty ones dropped; any other answer as the only one."""
    parts = F.filter(F.transform(F.split(answer, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(kind == "Set Answer", parts).otherwise(F.array(answer))


def sample_size(n: Column) -> Column:
    """A fifth of a benchmark, at least 100 and at most 500 examples."""
    return F.least(F.greatest(F.lit(100), (F.lit(0.2) * n).cast("int")), F.lit(500))


@F.pandas_udf(T.StringType())
def decipher(text: pd.Series, password: pd.Series) -> pd.Series:
    """Base64 text XORed with the repeated SHA-256 of the password; NULL and undecodable texts give NULL."""

    def one(t: str | None, p: str | None) -> str | None:
        if t is None or p is None:
            return None
        try:
            raw = np.frombuffer(base64.b64decode(t), np.uint8)
            key = np.resize(np.frombuffer(hashlib.sha256(p.encode()).digest(), np.uint8), len(raw))
            return (raw ^ key).tobytes().decode()
        except ValueError:
            return None

    return pd.Series([one(t, p) for t, p in zip(text, password)], dtype=object)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv_benchmark,
    "conversations": read_conversation_benchmark,
    "parquet": lambda spark, path, problem="problem", answer="answer": _example(spark.read.parquet(path), F.md5(problem), F.col(problem), F.array(F.col(answer))),
    "jsonl": lambda spark, path, schema, problem="problem", answer="answer": _example(spark.read.schema(schema).json(path), F.md5(problem), F.col(problem), F.array(F.col(answer))),
}


def load_benchmark(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Examples (id, problem, additional_instructions, answers) by a registered reader; unknown kinds raise ValueError."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


def append_events(events: DataFrame, path: str) -> None:
    """Appends (run, kind, seq, data) to a log partitioned by kind. Rows without run or kind are refused."""
    if events.where("run is null or kind is null").limit(1).count():
        raise ValueError("events need a run and a kind")
    events.select("run", "kind", "seq", "data").write.mode("append").partitionBy("kind").parquet(path)


def scan_events(spark: SparkSession, path: str, run: str | None = None, kind: str | None = None) -> DataFrame:
    """Events of a log, of one run or kind if named; partition and row-group pruning keep the scan small."""
    rows = spark.read.schema(EVENT).parquet(path)
    if run is not None:
        rows = rows.where(F.col("run") == run)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def checkpoint_state(events: DataFrame, kind: str = "state") -> DataFrame:
    """Last state of each run."""
    return events.where(F.col("kind") == kind).groupBy("run").agg(F.max_by("data", "seq").alias("data"))


def once(requests: DataFrame, receipts: DataFrame, key: str = "key") -> DataFrame:
    """``requests`` with ``step``: reuse a completed call, error for a pending one, fail for a failed one, else call. Receipts have one row per key."""
    found = requests.join(receipts.select(key, F.col("status").alias("_s"), F.col("data").alias("receipt")), key, "left")
    step = F.when(F.col("_s").isNull(), "call").when(F.col("_s") == "complete", "reuse").when(F.col("_s") == "pending", "error").otherwise("fail")
    return found.withColumn("step", step).withColumn("receipt", F.when(step == "reuse", F.col("receipt"))).drop("_s")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """``requests`` with ``value``: the newest unexpired entry of the cache, NULL if there is none."""
    live = cache.where(F.col("expires_at") > now).groupBy(key).agg(F.max_by("value", "expires_at").alias("value"))
    return requests.join(live, key, "left")


def replay(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """``requests`` (request) with the frozen ``response`` and ``verdict``: ok, missing, or corrupt if its own digest differs."""
    keyed = requests.withColumn("digest", F.sha2("request", 256))
    found = keyed.join(receipts.select("digest", "response", "response_digest"), "digest", "left")
    verdict = F.when(F.col("response").isNull(), "missing").when(F.sha2("response", 256) != F.col("response_digest"), "corrupt").otherwise("ok")
    return found.withColumn("verdict", verdict).withColumn("response", F.when(verdict == "ok", F.col("response"))).drop("response_digest")


def cascade(base: DataFrame, key: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """``base`` with (body, route): the first source, in order, that has a body for the key. Sources have one row per key."""
    out = base
    for name, df in sources:
        out = out.join(df.select(key, F.col("body").alias(f"_{name}")), key, "left")
    bodies = [F.nullif(F.trim(F.col(f"_{name}")), F.lit("")) for name, _ in sources]
    route = F.coalesce(*(F.when(b.isNotNull(), F.lit(name)) for b, (name, _) in zip(bodies, sources)))
    return out.withColumn("body", F.coalesce(*bodies)).withColumn("route", route).drop(*(f"_{name}" for name, _ in sources))


def content_addressed(df: DataFrame, body: str) -> DataFrame:
    """(sha256, body): each distinct body once under its digest; NULL bodies are left out."""
    return df.where(F.col(body).isNotNull()).select(F.sha2(F.col(body), 256).alias("sha256"), F.col(body).alias("body")).dropDuplicates(["sha256"])


def write_summary_csv(df: DataFrame, path: str, columns: list[str], order: list[str], issues: str = "issues") -> None:
    """One CSV file per partition in fixed column order, lists of issues joined by `` | ``, NULL as nothing."""
    joined = df.withColumn(issues, F.array_join(issues, " | ")) if issues in columns else df
    joined.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def next_sequence(events: DataFrame) -> DataFrame:
    """``events`` with ``seq`` renumbered 1.. per run in the order of (seq, kind, data)."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run").orderBy("seq", "kind", "data")).cast("bigint"))
