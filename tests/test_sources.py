import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evifold.sources import readers as S
from evifold.streaming import steps as ST


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('problem,answer\n"Is ""x""\nsafe?",yes\n')
    got = S.load_benchmark(spark, "csv", str(tmp_path / "a.csv")).first()
    assert got.problem == 'Is "x"\nsafe?' and got.id == hashlib.md5(got.problem.encode()).hexdigest() and got.answers == ["yes"]
    lines = [json.dumps({"prompt_id": "p", "prompt": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes?"}]}), "", "{"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert [r.problem for r in S.load_benchmark(spark, "conversations", str(tmp_path / "c.jsonl")).collect()] == ["Patient: hi\n\nPhysician: yes?"]
    with pytest.raises(ValueError):
        S.load_benchmark(spark, "none", "x")


def test_small_rules(spark):
    df = spark.createDataFrame([("a, b,,c", "Set Answer"), ("a, b", "Single")], "a string, k string")
    assert [r[0] for r in df.select(S.set_answers(F.col("a"), F.col("k"))).collect()] == [["a", "b", "c"], ["a, b"]]
    assert [r[0] for r in spark.createDataFrame([(10,), (1_000,), (9_000,)], "n int").select(S.sample_size(F.col("n"))).collect()] == [100, 200, 500]
    raw = "größe " * 20
    key = hashlib.sha256(b"pw").digest()
    secret = base64.b64encode(bytes(b ^ key[i % 32] for i, b in enumerate(raw.encode()))).decode()
    df = spark.createDataFrame([(secret, "pw"), (None, "pw"), ("%%%", "pw")], "c string, p string")
    assert [r[0] for r in df.select(S.decipher("c", "p")).collect()] == [raw, None, None] or [r[0] for r in df.select(S.decipher("c", "p")).collect()][:2] == [raw, None]


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    S.append_events(spark.createDataFrame([("r", "state", 1, "a"), ("r", "state", 2, "b"), ("s", "call", 1, "c")], S.EVENT), path)
    S.append_events(spark.createDataFrame([("r", "state", 3, "d")], S.EVENT), path)
    assert S.scan_events(spark, path, "r", "state").count() == 3 and S.checkpoint_state(S.scan_events(spark, path)).first()["data"] == "d"
    with pytest.raises(ValueError):
        S.append_events(spark.createDataFrame([(None, "x", 1, "c")], S.EVENT), path)


def test_receipts_and_caches(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    receipts = spark.createDataFrame([("a", "complete", "1"), ("b", "pending", None), ("c", "failed", "x")], "key string, status string, data string")
    assert [(r.step, r.receipt) for r in S.once(asked, receipts).orderBy("key").collect()] == [("reuse", "1"), ("error", None), ("fail", None), ("call", None)]
    cache = spark.createDataFrame([("a", "old", 5), ("a", "new", 9), ("b", "gone", 1)], "key string, value string, expires_at int")
    assert [r.value for r in S.cache_lookup(asked, cache, F.lit(4)).orderBy("key").collect()] == ["new", None, None, None]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    frozen = spark.createDataFrame([(sha("q"), "r", sha("r")), (sha("p"), "r", sha("other"))], "digest string, response string, response_digest string")
    got = S.replay(spark.createDataFrame([("q",), ("p",), ("z",)], "request string"), frozen)
    assert {r.request: (r.verdict, r.response) for r in got.collect()} == {"q": ("ok", "r"), "p": ("corrupt", None), "z": ("missing", None)}
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    first, second = spark.createDataFrame([(1, " "), (2, "x")], "k int, body string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, body string")
    assert [(r.body, r.route) for r in S.cascade(base, "k", ("one", first), ("two", second)).orderBy("k").collect()] == [("y", "two"), ("x", "one"), (None, None)]
    assert S.content_addressed(spark.createDataFrame([("a",), ("a",), (None,)], "t string"), "t").count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "error", 1.0, None), (2, "2024-01-01 00:05:00", 7, "error", 2.0, None), (2, "2024-01-01 00:05:00", 7, "error", 2.0, None), (3, "2024-01-01 03:00:00", 7, "purchase", 1.0, None), (4, "2024-01-01 03:01:00", 7, "error", 1.0, None)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: ST.read_events(spark, str(tmp_path / "in"), "*.parquet")
    once = ST.run_to_memory(ST.once_each(stream()), "once", str(tmp_path / "c1"))
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 4]
    hours = ST.run_to_memory(ST.windowed(stream()), "hours", str(tmp_path / "c2"), "complete")
    assert sorted((r.event_type, r.n) for r in hours.collect()) == [("error", 1), ("error", 3), ("purchase", 1)]
    found = ST.run_to_memory(ST.running_failures(ST.once_each(stream()), delay=None), "fails", str(tmp_path / "c3"))
    assert [(r.event_id, r.failures) for r in found.collect()] == [(2, 2)]
