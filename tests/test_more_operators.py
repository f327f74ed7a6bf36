import random

from pyspark.sql import functions as F

from evifold.functions.text import nfkc
from evifold.operators import cleaning as C
from evifold.operators import evaluation as V
from evifold.operators import events as E
from evifold.operators import judging as J
from evifold.operators import ledger as L
from evifold.operators import preparation as P
from evifold.operators import ranking as R
from evifold.operators import spans as S
from evifold.operators import traces as X


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_output_is_paired_over_other_events(spark):
    rows = [("r", 1, "call"), ("r", 2, "other"), ("r", 3, "output"), ("r", 4, "output"), ("r", 5, None), ("r", 6, "output"), ("s", 1, "output"), ("s", 2, "call"), ("s", 3, "call"), ("s", 4, "output")]
    df = spark.createDataFrame(rows, "run string, seq int, kind string")
    got = E.previous_of(df, ["run"], ["seq"], F.col("seq"), F.col("kind") == "call", F.col("kind") == "output")
    assert {(r.run, r.seq): r.paired for r in got.collect() if r.paired} == {("r", 3): 1, ("s", 4): 3}


def test_best_bm25_equals_the_whole_ranking(spark):
    rng = random.Random(1)
    docs = [(i, None if i == 7 else " ".join(rng.choice("alpha beta gamma delta 漢字 x1".split()) for _ in range(rng.randrange(0, 30)))) for i in range(200)] + [(None, "alpha")]
    df = spark.createDataFrame(docs, "id bigint, t string").withColumn("score", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame([(1, "alpha alpha 漢"), (2, "none here"), (3, None), (4, "x1 delta beta")], "q bigint, t string")
    for distinct in (False, True):
        whole = R.top_k(R.bm25(df.where("id is not null"), asked, "id", F.col("t"), "q", F.col("t"), distinct_query=distinct), ["query_id"], [F.desc("score"), F.asc("id")], 5)
        best = R.bm25_top_k(df.where("id is not null"), asked, "id", F.col("t"), "q", F.col("t"), 5, distinct_query=distinct)
        a, b = ({(r.query_id, r["rank"]): (r.id, round(r.score, 5)) for r in x.collect()} for x in (whole, best))
        assert a == b and len(a) == 10
    assert R.bm25_top_k(df.limit(0), asked, "id", F.col("t"), "q", F.col("t"), 5).count() == 0 and R.bm25_top_k(df, asked.limit(0), "id", F.col("t"), "q", F.col("t"), 5).count() == 0


def test_query_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 3}") for i in range(40)], "id bigint, t string")
    want = {tuple(r) for r in R.bm25_top_k(df, df, "id", F.col("t"), "id", F.col("t"), 3).collect()}
    monkeypatch.setattr(R, "BROADCAST_TERMS", 9)
    assert {tuple(r) for r in R.bm25_top_k(df, df, "id", F.col("t"), "id", F.col("t"), 3).collect()} == want


def test_greedy_rounds_equal_the_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcd") if rng.random() < 0.95 else None, rng.randrange(25), rng.randrange(200)) for _ in range(120)]
    got = sorted(map(str, X.greedy_two_way(spark.createDataFrame(rows, "s string, c int, o int").distinct(), "s", "c", "o", 4).collect()))
    counts, seen, want = {}, set(), []
    for s, c, o in sorted(set(rows), key=lambda r: (r[2], r[1], r[0] is not None, r[0] or "")):
        if counts.get(s, 0) < 4 and c not in seen:
            counts[s] = counts.get(s, 0) + 1
            seen.add(c)
            want.append(f"Row(s={s!r}, c={c}, o={o})")
    assert got == sorted(want)
    assert X.greedy_two_way(spark.createDataFrame([], "s string, c int, o int"), "s", "c", "o", 4).count() == 0


def test_bootstrap_by_task_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, float(i * 7 % 11)) for i in range(50)] + [("a", 99, None)], "g string, q int, x double")
    one = {r.g: (r.n, round(r.low, 9), round(r.high, 9)) for r in V.bootstrap_interval(df, ["g"], "q", "x", 200).collect()}
    monkeypatch.setattr(V, "RESAMPLED_AT_ONCE", 3)
    two = {r.g: (r.n, round(r.low, 9), round(r.high, 9)) for r in V.bootstrap_interval(df, ["g"], "q", "x", 200).collect()}
    assert one == two and set(one) == {"a", "b"} and V.bootstrap_interval(df.limit(0), ["g"], "q", "x", 50).count() == 0


def test_scores_keep_the_unobserved(spark):
    df = spark.createDataFrame([(1, "direct", "direct", 0.5), (1, "unknown", "unknown", None), (2, "partial", "direct", 1.0), (3, "direct", "unobservable", 1.0)], "g int, s string, e string, c double")
    got = {r.g: (r.status_accuracy, r.grounded_accuracy, r.score) for r in J.state_grades(df, ["g"], "s", "e", "c").collect()}
    assert got == {1: (1.0, 0.75, 0.9375), 2: (0.0, 0.0, 0.0), 3: (None, None, None)}
    lit = F.lit
    none = lit(None).cast("double")
    core = lambda a, b: {"a": (a, 0.75), "b": (b, 0.25)}
    row = _one(
        spark, J.stage_scalar(core(lit(1.0), lit(0.5)), lit(1), lit(False)), J.stage_scalar(core(lit(1.0), none), lit(1), lit(False)), J.stage_scalar(core(lit(0.4), lit(0.4)), lit(1), lit(True)),
        J.stage_scalar(core(lit(0.4), none), lit(None).cast("int"), lit(False), excluded=frozenset("b")), J.quality_r(lit(50.0), lit(True), lit(False), lit(False), lit(False)), J.quality_r(lit(50.0), lit(False), lit(False), lit(True), lit(False)),
        J.quality_r(lit(50.0), lit(False), lit(False), lit(False), lit(True)), J.quality_r(none, lit(False), lit(None).cast("boolean"), lit(False), lit(False)),
    )
    assert [None if x is None else round(x, 4) for x in row] == [0.925, None, 0.4, 0.4, None, 0.0, 0.245, None]


def test_quotes_are_repaired_only_when_unique():
    assert J.repair_quote("THE dose “was”  raised", 'x the Dose\n"was" raised y') == 'the Dose\n"was" raised'
    assert J.repair_quote("a b", "a b and a  b") is None and J.repair_quote("q", None) is None and J.repair_quote("", "x") is None and J.repair_quote("strasse", "die Straße") == "Straße"


def test_contexts_attempts_and_retries(spark):
    df = spark.createDataFrame([("q", "t1", ["a", "b", "c"]), ("q", "t2", ["b"]), ("q", "t3", None), ("q", "t4", [])], "q string, t string, acts array<string>")
    known = spark.createDataFrame([("q", "p1", ["a"]), ("q", "p2", ["a", "b"]), ("q", "p0", ["a", "b"]), ("x", "p9", ["b"])], "q string, p string, acts array<string>")
    got = {r.t: (r.matched, r.context) for r in L.longest_context(df, known, ["q"], "acts", "p").collect()}
    assert got == {"t1": (2, "p0"), "t2": (0, None), "t3": (0, None), "t4": (0, None)}
    tries = [(1, 1, False, True), (1, 2, True, None), (2, 1, False, False), (2, 2, True, True), (3, 1, None, True), (3, 2, False, True), (3, 3, False, True), (4, 1, False, True)]
    out = L.retry_outcomes(spark.createDataFrame(tries, "k int, n int, ok boolean, again boolean"), ["k"], [F.col("n")], F.col("ok"), F.col("again"), 3)
    assert {r.k: (r.outcome, r.first_ok) for r in out.collect()} == {1: ("ok", 2), 2: ("not_retryable", None), 3: ("exhausted", None), 4: ("open", None)}
    finals = spark.createDataFrame([(1, 1, True, False), (2, 1, True, False), (2, 2, True, False), (3, 1, False, None), (4, 1, True, True)], "k int, n int, v boolean, odd boolean")
    assert {r.k: r.verdict for r in L.final_attempt(finals, ["k"], "n", F.col("v"), F.col("odd")).collect()} == {1: "selected", 2: "after_valid", 3: "needs_attention", 4: "needs_attention"}


def test_spans_are_exact(spark):
    text = "  First one. ![x](y)Second?  {{ a.b }}\nlast 2.5 mg\n\nEnd"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "![a](b)"), (1, text)], "id int, t string").withColumn("start", F.lit("clash"))
    kept = C.retained_spans(df.drop("start"), "id", F.col("t")).collect()
    assert all(text[r.start : r.end] == r.span for r in kept) and len(kept) == 6 and {r.span_no for r in kept} == {1, 2, 3}
    lines = C.clean_lines(df.drop("start"), "id", F.col("t")).collect()
    assert all(text[r.start : r.end] == r.line for r in lines if r.id == 1) and len(lines) == 7
    sentences = S.sentence_spans(df.drop("start"), "id", F.col("t")).where("id = 1").orderBy("start").collect()
    assert all(text[r.start : r.end] == r.sentence for r in sentences) and max(r.end for r in sentences) == len(text)


def test_tables_and_edges():
    rows = ["| aspirin | 1 |", "| placebo | 2 |", "| aspirin gout | 3 |", "| none | 4 |"]
    assert S.row_window(rows, {"gout"}, 45) == (1, 2) and S.row_window(rows, {"gout"}, 10) is None and S.row_window([], {"x"}, 10) is None and S.row_window(rows, set(), 200) == (0, 3)
    long = "This sentence was already shown to the reader in an earlier window of the same source, word for word."
    assert S.trim_seen_edges(f"{long} New text follows here.", [long]) == "New text follows here." and S.trim_seen_edges(f"New text. {long}", ["x " + long]) == "New text."
    assert S.trim_seen_edges(None, []) is None and S.trim_seen_edges("Short. New.", ["Short."]) == "Short. New."


def test_windows_covered_together(spark):
    rows = [("s", 1, 0, 10), ("s", 2, 10, 20), ("s", 3, 5, 15), ("s", 4, 15, 25), ("t", 1, 5, 9), ("s", 5, None, 3), ("s", 6, 4, 4)]
    got = S.repeated_windows(spark.createDataFrame(rows, "src string, n int, a int, b int"), ["src"], ["n"], "a", "b").collect()
    assert {(r.src, r.n) for r in got if r.repeated} == {("s", 3)}


def test_short_texts_and_languages(spark):
    row = _one(
        spark, S.word_prefix(F.lit("alpha beta gamma"), 11), S.word_prefix(F.lit("alphabetagamma"), 5), S.word_prefix(F.lit(""), 5), S.word_prefix(F.lit(None).cast("string"), 5), C.language_matches(F.lit("Is this drug safe?"), F.lit("是的，这种药物对老年患者是安全的。")),
        C.language_matches(F.lit("ok"), F.lit("fine")), C.anchors_in_order(F.lit("a b a c"), F.array(F.lit("a"), F.lit("a"), F.lit("c"))), C.anchors_in_order(F.lit("a b"), F.array(F.lit("b"), F.lit("a"))), nfkc(F.lit("ｃａｆｅ́")), nfkc(F.lit(None).cast("string")),
    )
    assert list(row) == ["alpha beta", "alpha", "", None, False, None, [1, 5, 7], None, "café", None]


def test_registry_walk_and_merges(spark):
    rows = [(1, '{"a": [{"id": "x"}, {"id": 7, "b": {"id": true}}]}'), (2, "{broken"), (3, None), (4, "[" * 5_000)]
    got = P.registered_values(spark.createDataFrame(rows, "k bigint, j string"), "k", "j", ["id"]).collect()
    assert sorted((r.k, r.path, r.value) for r in got) == [(1, "$.a[0].id", "x"), (1, "$.a[1].id", "7")]
    parts = spark.createDataFrame([(0, "b"), (1, "a")], "w int, v string")
    assert [r.v for r in P.complete_merge(parts, "w", 2, ["v"]).collect()] == ["a", "b"] and P.complete_merge(parts, "w", 3, ["v"]).count() == 0
    state = P.finalised(spark.createDataFrame([(1,), (2,), (2,), (4,)], "k int"), spark.createDataFrame([(1, True), (2, True), (3, True)], "k int, ok boolean"), ["k"], "ok")
    assert {r.k: r.state for r in state.collect()} == {1: "accepted", 2: "repeated", 3: "no_session", 4: "no_decision"}
