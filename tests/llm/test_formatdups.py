import json
import re

from evifold.llm import formatdups as D


def _key(logged):
    try:
        j = json.loads(logged)
    except (TypeError, ValueError):
        return None
    words = lambda v: " ".join(re.findall(r"[^\W_]+", (v or "").casefold()))
    if not isinstance(j, dict) or words(j.get("action")) != "search" or not words(j.get("query")):
        return None
    return words(j.get("channel")), tuple(words(x) for x in j.get("requirement_ids") or []), words(j["query"])


ACTIONS = [
    '{"action": "search", "requirement_ids": ["R1", "R2"], "channel": "web", "query": "Größe des Effekts"}',
    '{"query": "“GRÖSSE, des\\u3000effekts”", "channel": "WEB", "action": "Search", "requirement_ids": ["r1", "R2"]}',
    '{"action": "search", "requirement_ids": ["R2", "R1"], "channel": "web", "query": "Größe des Effekts"}',
    '{"action": "search", "requirement_ids": ["R1 R2"], "channel": "web", "query": "Größe des Effekts"}',
    '{"action": "search", "channel": "web", "query": "Größe des Effekts"}',
    '{"action": "search", "requirement_ids": ["R1"], "channel": "web", "query": "…"}',
    '{"action": "browse", "source_id": "x"}', '{"action": "search", "query": "cut o', "", None, "null", "[]", "7",
    '{"action": "search", "query": "a b"}', '{"action": "search", "query": "A-B", "channel": null}', '{"action": "search", "query": "ab"}',
]


def _expected(rows):
    first, pairs, counts = {}, set(), {}
    for i, x in sorted(rows):
        if (k := _key(x)) is None:
            continue
        if k in first:
            pairs.add((first[k], i))
        first.setdefault(k, i)
        counts[first[k]] = counts.get(first[k], 0) + 1
    return pairs, counts


def test_against_brute_force(spark):
    rows = [(i, ACTIONS[(i * 7) % len(ACTIONS)]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "log_id bigint, executed_action string").selectExpr("*", "'x' AS h", "1 AS canon")
    pairs, counts = _expected(rows)
    texts = D.canonical_searches(df)
    assert {tuple(r) for r in D.duplicate_pairs(texts).collect()} == pairs and pairs
    assert {tuple(r) for r in D.distinct_records(texts).collect()} == set(counts.items())


def test_hot_group_and_collision_path(spark, monkeypatch):
    rows = [(i, ACTIONS[0] if i % 3 else ACTIONS[13]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "log_id bigint, executed_action string").repartition(4)
    pairs, _ = _expected(rows)
    texts = D.canonical_searches(df)
    assert {tuple(r) for r in D.duplicate_pairs(texts).collect()} == pairs
    from pyspark.sql import functions as F

    def colliding(t):
        return t.where("canon is not null").select("item_id", F.lit(b"same").alias("h"), F.xxhash64("canon").alias("chk"))

    monkeypatch.setattr(D, "keyed", colliding)
    assert {tuple(r) for r in D.duplicate_pairs(texts).collect()} == pairs


def test_empty_table(spark):
    df = spark.createDataFrame([], "log_id bigint, executed_action string")
    assert D.duplicate_pairs(D.canonical_searches(df)).count() == 0 and D.distinct_records(D.canonical_searches(df)).count() == 0


def _canon(spark, queries, signs):
    rows = [(i, json.dumps({"action": "search", "query": q})) for i, q in enumerate(queries)]
    got = {r.item_id: r.canon for r in D.canonical_searches(spark.createDataFrame(rows, "log_id bigint, executed_action string"), signs=signs).collect()}
    return [got.get(i) for i in range(len(queries))]


def test_characters_are_canonical(spark):
    a = _canon(spark, ["कि", "की", "café", "café", "ａｓｐｉｒｉｎ", "Aspirin", "ﬁbrosis", "fibrosis", "ｱｽﾋﾟﾘﾝ", "アスピリン"], False)
    assert a[0] != a[1] and all(a[k] == a[k + 1] for k in (2, 4, 6, 8)) and len(set(a)) == 6


def test_signs(spark):
    asked = ["p < 0.05", "p > 0.05", "p 0 05", "dose -5", "dose 5", "dose - 5", "0.5 mg, daily.", "5 mg daily"]
    kept, plain = _canon(spark, asked, True), _canon(spark, asked, False)
    assert len(set(kept[:3])) == 3 and kept[3] != kept[4] == kept[5] and kept[6].endswith("0.5 mg daily")
    assert len(set(plain[:3])) == 1 and plain[3] == plain[4]
