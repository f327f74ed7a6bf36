import random

import pytest
from pyspark.sql import functions as F

from evifold.operators import credit as C
from evifold.operators import curation as U
from evifold.operators import evaluation as V
from evifold.operators import events as E
from evifold.operators import passages as P
from evifold.operators import ranking as R
from evifold.operators import textrules as T
from evifold.operators import traces as X
from evifold.plans.text_queries import decontaminate, jaccard_members, jaccard_pairs
from evifold.plans.trace_queries import prefix_chain_merge


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_bm25_counts_repeated_query_terms_and_all_documents(spark):
    docs = spark.createDataFrame([(1, "aspirin gout"), (2, "gout"), (3, ""), (4, None), (5, "字 gout")], "id int, t string")
    asked = spark.createDataFrame([(1, "gout gout"), (2, None), (3, "none")], "q int, text string")
    got = {(r.query_id, r.id): r.score for r in R.bm25(docs, asked, "id", F.col("t"), "q", F.col("text")).collect()}
    import math

    idf, avg = math.log(1 + (5 - 3 + 0.5) / 3.5), 1.0
    assert set(got) == {(1, 1), (1, 2), (1, 5)} and got[1, 2] == round(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / avg)), 6)
    once = R.bm25(docs, asked, "id", F.col("t"), "q", F.col("text"), distinct_query=True)
    assert {(r.query_id, r.id): r.score for r in once.collect()}[1, 2] == pytest.approx(got[1, 2] / 2, abs=1e-6)


def test_window_rewrites_equal_the_greedy_loops(spark):
    rng = random.Random(3)
    items = [(g, i, rng.choice("abc"), float(rng.randrange(0, 80)), f"t{i}") for g in range(20) for i in range(12)]
    df = spark.createDataFrame(items, "g int, i int, d string, s double, t string")
    got = {(r.g, r.i): r["rank"] for r in R.domain_diverse(df, ["g"], "d", "s", "t", "i").collect()}
    for g in range(20):
        left, counts, place = [x for x in items if x[0] == g], {}, 0
        while left:
            best = max(left, key=lambda x: (x[3] - 30 * counts.get(x[2], 0), x[4]))
            left.remove(best)
            counts[best[2]] = counts.get(best[2], 0) + 1
            place += 1
            assert got[g, best[1]] == place
    lists = [(g, rng.randrange(3), k, rng.choice("uvwxyz")) for g in range(20) for k in range(1, 9)]
    fused = R.round_robin_fuse(spark.createDataFrame(lists, "g int, l int, r int, id string"), ["g"], "id", "l", "r")
    got = {(r.g, r.id): r.position for r in fused.collect()}
    for g in range(20):
        order = []
        for _, _, _, x in sorted((x for x in lists if x[0] == g), key=lambda x: (x[2], x[1], x[3])):
            if x not in order:
                order.append(x)
        assert [i for i, _ in sorted(((i, got[g, i]) for i in order), key=lambda p: p[1])] == order


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "q")] + [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    got = dict(rows(R.components(spark.createDataFrame(edges, "u string, v string"), "u", "v"), "node", "component"))
    assert got["c"] == "a" and got["y"] == "x" and got["z"] == "z" and {got[f"n{i}"] for i in range(41)} == {"n0"} and {got[f"h{i}"] for i in range(50)} == {"h0"} and got["hub"] == "h0"


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(R.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
    assert [r[0] for r in df.select(R.overlap_share(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]
    assert df.select(R.bigrams(F.split(F.lit("x y z"), " "))).first()[0] == ["x y", "y z"]


def test_event_folds(spark):
    log = [("r", 1, "f"), ("r", 2, "f"), ("r", 3, "ok"), ("r", 4, "f"), ("s", 1, None)]
    df = spark.createDataFrame(log, "run_id string, turn int, k string")
    got = E.failures_since_success(df, ["run_id"], ["turn"], F.col("k") == "ok", F.col("k") == "f")
    assert rows(got, "run_id", "turn", "failures") == [("r", 1, 1), ("r", 2, 2), ("r", 3, 0), ("r", 4, 1), ("s", 1, 0)]
    many = spark.createDataFrame([("r", i, "f" if i < 9 else "ok") for i in range(1, 14)], "run_id string, turn int, k string")
    charged = rows(E.charge_budget(many, ["run_id"], ["turn"], F.col("k") == "f"), "turn", "exempt", "charged", "stopped")
    assert charged[6] == (7, 5, 2, False) and charged[10] == (11, 5, 6, True)
    assert E.latest_by(df, ["run_id"], "k", ["turn"]).where("run_id = 's'").first()["k"] is None


def test_unknown_poisons_earlier_returns_only(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, None), ("r", 3, 2.0), ("r", 4, 0.0)], "run string, i int, x double")
    assert rows(C.return_to_go(df, ["run"], ["i"], "x"), "i", "rtg") == [(1, None), (2, None), (3, 2.0), (4, 0.0)]


def test_advantages(spark):
    df = spark.createDataFrame([("q", "a", 1.0), ("q", "a", 3.0), ("q", "b", 4.0), ("q", "c", None), ("p", "a", 1.0)], "q string, m string, x double")
    got = sorted(((r.q, r.m, r.x, r.local_advantage) for r in C.leave_one_out(df, ["q"], "m", "x").collect()), key=str)
    assert got == [("p", "a", 1.0, None), ("q", "a", 1.0, -3.0), ("q", "a", 3.0, -1.0), ("q", "b", 4.0, 2.0), ("q", "c", None, None)]
    four = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", 1.0), ("b", None), ("b", 2.0), ("b", 3.0)], "g string, x double")
    held = C.group_advantage(four, ["g"], "x", 4)
    assert held.where("g = 'b' and advantage is not null").count() == 0 and held.where("g = 'a'").agg(F.sum("advantage")).first()[0] == 0
    assert spark.range(1).select(C.discounted_return(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)), 0.5, F.lit(1.0), 9.0)).first()[0] == 1.25
    tokens = spark.range(1).select(C.token_surrogate(*(F.array(F.lit(x)) for x in (0.0, 0.0, -9.0)), F.lit(1.0))).first()[0]
    assert tokens == [2.0]


def test_strict_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 0.0), ("b", 1.0)], "g string, x double")
    assert rows(df.groupBy("g").agg(C.strict_mean(F.col("x")).alias("m")), "g", "m") == [("a", None), ("b", 0.5)]


def test_grid_pairs_and_bootstrap(spark):
    cells = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 0.0), ("q2", "a", None), ("q2", "b", 1.0), ("q3", "a", 0.5), ("q3", "b", 0.5)], "q string, arm string, x double")
    assert V.full_grid(cells.where("q != 'q3' or arm = 'a'"), ["q"], "arm", ["x"]).count() == 6
    p = V.paired(cells, ["q"], "arm", "x").first()
    assert (p.common, p.a_wins, p.b_wins, p.ties, p.delta) == (2, 1, 0, 1, -0.5)
    deltas = spark.createDataFrame([("g", i, float(i % 5)) for i in range(200)] + [("g", 999, None)], "g string, q int, x double")
    low, mean, high, n = V.bootstrap_interval(deltas, ["g"], "q", "x", 400).select("low", "mean", "high", "n").first()
    assert n == 200 and mean == 2.0 and 1.7 < low < 2.0 < high < 2.3
    assert V.bootstrap_interval(deltas.repartition(5), ["g"], "q", "x", 400).first()["low"] == pytest.approx(low, abs=1e-9)
    order = V.rotated_order(spark.createDataFrame([(q, a) for q in range(7) for a in "xyz"], "q int, arm string"), "q", "arm")
    assert {(r.arm, r.slot) for r in order.where("q = 6").collect()} == {("x", 2), ("y", 0), ("z", 1)}


def test_rubric_score_without_positive_points_is_null(spark):
    df = spark.createDataFrame([("a", 5.0, True), ("a", -3.0, True), ("b", -1.0, True)], "g string, p double, m boolean")
    assert rows(df.groupBy("g").agg(V.rubric_score(F.col("p"), F.col("m")).alias("s")), "g", "s") == [("a", 0.4), ("b", None)]


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.sample("abcdefghij", rng.randrange(1, 9)))) for i in range(120)] + [(500, ""), (501, None)]
    df = spark.createDataFrame(texts, "i int, t string")
    for least in (0.5, 0.8):
        got = set(rows(U.near_pairs(df.withColumnRenamed("i", "a"), df.withColumnRenamed("i", "b"), "a", "b", "t", least), "a", "b"))
        sets = {i: set(t.split()) for i, t in texts if t}
        assert got == {(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def test_curation(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", i % 5 != 0) for i in range(30)] + [(None, "s0", True)], "i int, s string, ok boolean")
    assert U.hash_sample(df, "i", "x", 5).count() == 5 and rows(U.hash_sample(df.repartition(7), "i", "x", 5), "i") == rows(U.hash_sample(df, "i", "x", 5), "i")
    assert U.stratified_sample(df.where("i is not null"), "s", "i", "x", 2).count() == 6
    assert U.atomic_filter(df.withColumn("k", F.col("i") % 10), ["k"], F.col("ok")).where("k in (0, 5)").count() == 0
    shards = [r[0] for r in U.shard_of(df.where("i is not null").select("i"), "i", 4).orderBy("i").select("shard").collect()]
    assert shards == [0] * 8 + [1] * 8 + [2] * 7 + [3] * 7
    assert U.conflicts(spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2)], "k string, v int"), ["k"], F.col("v")).first()["k"] == "a"
    old, new = spark.createDataFrame([("a", "1"), ("b", "2")], "p string, h string"), spark.createDataFrame([("b", "3"), ("c", "4")], "p string, h string")
    assert rows(U.manifest_diff(old, new, "p", "h"), "p", "change") == [("a", "removed"), ("b", "changed"), ("c", "added")]


def test_text_rules(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(T.clean_text, " a\x01\t\n b ") == "a b" and one(T.clean_text, None) is None
    assert one(T.script_hint, "a" * 100) == "latin" and one(T.script_hint, "字" * 100) == "cjk" and one(T.script_hint, "a") == "unknown" and one(T.script_hint, None) == "unknown"
    assert one(T.english_eligible, "the patient is in a trial and the answer to this is what you can see") is True and one(T.english_eligible, None) is False
    assert one(T.host, "https://user@www.A.example:80/x") == "a.example" and one(T.host, "ftp://x") is None
    assert one(T.citations, '<cite id="a, b">x</cite><cite id="c">y</cite>') == ["a", "b", "c"]
    assert one(T.study_design, "A systematic review of randomized trials") == "systematic_review"
    assert one(lambda c: T.table_signature(T.folded(c))["structure"], "| a | b |") == "table_like" and one(lambda c: T.table_signature(T.folded(c))["structure"], "A sentence.") == "prose"


def test_passages(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 4, 4), ("a", 7, 9), ("a", 9, 8), ("b", None, 2)], "k string, s int, e int")
    assert rows(P.merge_intervals(df, ["k"], "s", "e"), "k", "island_start", "island_end", "n") == [("a", 1, 5, 3), ("a", 7, 9, 1)]
    assert spark.range(1).select(P.fair_shares(F.array(*map(F.lit, (10, 1, 90))), 30)).first()[0] == [10, 1, 19]
    page = "<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><h1>Head</h1><p>One &amp; two</p><h2>Sub</h2><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    assert P.html_sections(page) == {"title": "Head", "sections": [{"heading": "Head", "text": "One & two"}, {"heading": "Sub", "text": "a | b"}]}
    assert P.markdown_sections("# T\nx\n\n## S\ny")["sections"][1] == {"heading": "S", "text": "y"}
    xml = "<?xml version='1.0'?><article xmlns='u'><article-title>T</article-title><body><sec><title>M</title><p>We did.</p></sec></body></article>"
    assert P.xml_sections(xml) == {"title": "T", "sections": [{"heading": "M", "text": "We did."}]} and P.xml_sections("<a")["sections"] == []
    listed = spark.createDataFrame([(1, None), (2, page), (3, xml), (4, "")], "i bigint, t string")
    got = {r.item_id: r for r in P.parse_sections(listed, "i", "t").collect()}
    assert got[1].title is None and got[2].title == "Head" and got[3].title == "T" and got[4].sections == []


def test_traces(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    call = one(X.tool_call, 'x <tool name="search" k="1" q="a b"> body </tool>')
    assert call.tool == "search" and call.attributes == {"k": "1", "q": "a b"} and call.body == "body" and one(X.tool_call, "none") is None
    assert one(X.repair_json, '```json\n{"b": 1, "a": [1,],}\n```') == '{"a":[1],"b":1}' and one(X.repair_json, '{"a":1,"a":2}') is None and one(X.repair_json, None) is None
    assert one(X.normalised, "ﬁt, Straße!") == "fit strasse" and one(X.preview_text, "a<b>b</b>&amp;​ c") == "a b & c"
    assert one(X.query_rewrites, "What is the effect of a randomized trial of aspirin on gout in adults") [0].startswith("What is")
    assert one(X.citation_marks_sound, '<cite id="a">x</cite>') and not one(X.citation_marks_sound, '<cite id="a">x')
    picked = X.greedy_two_way(spark.createDataFrame([("s", "c1", 1), ("s", "c1", 2), ("s", "c2", 3), ("s", "c3", 4), ("t", "c2", 5), ("t", "c4", 6)], "s string, c string, o int"), "s", "c", "o", 2)
    assert rows(picked, "o") == [(1,), (3,), (6,)]
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(1.0).alias("weight")), F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit(2.0).alias("weight")))
    assert spark.range(1).select(X.record_faults(spans, F.lit(9))).first()[0] == "overlap" and spark.range(1).select(X.weighted_mass(spans)).first()[0] == 9.0
    assert spark.range(1).select(X.record_faults(F.slice(spans, 1, 1), F.lit(2))).first()[0] == "out_of_range"
    batched = X.batches(spark.range(10), "id", "s", 4).groupBy("batch").count()
    assert rows(batched, "batch", "count") == [(0, 4), (1, 4), (2, 2)]


def test_prefix_chain_merge_compares_whole_queries(spark, tmp_path):
    queries = ["aspirin for gout", "Aspirin for gout in adults", "aspirin for migraine", "aspirin for migraine"]
    steps = [(i, "r", i, f'{{"action": "search", "query": "{q}"}}') for i, q in enumerate(queries)]
    spark.createDataFrame(steps, "log_id bigint, run_id string, turn int, executed_action string").write.parquet(str(tmp_path / "case_steps.parquet"))
    assert rows(prefix_chain_merge(spark, str(tmp_path)), "run_id", "chains", "n") == [("r", 2, 4)]


def test_jaccard_pairs_ask_for_repeated_titles(spark, tmp_path):
    papers = [(3, "one two three four five"), (20, "one two three four five"), (7, "one two three four five six"), (27, "one two three four five six"), (40, "apart"), (8, "never asked"), (9, None)]
    spark.createDataFrame(papers, "paper_row_id bigint, title string").write.parquet(str(tmp_path / "paper_rows.parquet"))
    assert rows(jaccard_pairs(spark, str(tmp_path)), "query_id", "id", "jaccard") == [(3, 3, 1.0), (3, 7, 0.833333), (40, 40, 1.0)]
    assert rows(jaccard_members(spark, str(tmp_path)), "paper_row_id", "id") == [(3, 3), (7, 7), (8, 8), (20, 3), (27, 7), (40, 40)]


def test_decontaminate_finds_ids_equals_near_and_contained(spark, tmp_path):
    word = [f"word{k}" for k in range(60)]
    cyrillic = "Можно ли принимать это лекарство вместе с аспирином каждый день утром и вечером до еды при подагре"
    pool = [("q1", "Short one?", None), ("q2", "短い質問", None), ("q3", " ".join(word[:40]), None), ("q4", cyrillic, None), ("q5", None, None), ("q6", "", "kept as text only"), ("q1", "Short one?", None), ("q1", "Another text of one", None)]
    outputs = [
        (1, "x", "SHORT  one"), (2, "x", "短い質問"), (3, "q5", None), (4, "x", " ".join(["before", "it", *word[10:24], "after"])), (5, "x", cyrillic.replace("утром", "днём")),
        (6, "x", "Short one?"), (7, "x", "another short one"), (8, "x", " ".join(word[:12])), (9, "q3", " ".join(word[:40])), (10, "x", "Kept, as text only!"), (11, None, None),
    ]
    spark.createDataFrame(pool, "question_id string, problem string, normalized_text string").write.parquet(str(tmp_path / "exclusion_pool.parquet"))
    spark.createDataFrame(outputs, "output_id bigint, example_id string, problem string").write.parquet(str(tmp_path / "eval_outputs.parquet"))
    got = decontaminate(spark, str(tmp_path))
    equal = [(i, q, "normalised_exact") for i, q in ((1, "q1"), (2, "q2"), (6, "q1"), (10, "q6"))]
    assert rows(got, "output_id", "question_id", "kind") == sorted([*equal, (3, "q5", "id"), (4, "q3", "contained"), (5, "q4", "near_duplicate"), (9, "q3", "id")])
    assert [r.share for r in got.where("output_id in (4, 9)").orderBy("output_id").collect()] == [round(2 / 28, 6), 1.0]


def test_searches_are_compared_with_the_whole_run(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(9))
    df = spark.createDataFrame([("r", i, words(i)) for i in range(70)] + [("r", 70, words(0) + "s"), ("r", 71, words(0))], "run string, o int, q string")
    assert rows(X.repeated_queries(df, "run", "o", F.col("q")), "o", "best") == [(71, 1.0)]
    assert rows(X.similar_queries(df.where("o < 71"), ["run"], "o", F.col("q"), 0.98), "o") == [(70,)]


def test_running_sums_over_a_hot_key(spark):
    from evifold.functions.ordered import numbered, running

    rng = random.Random(5)
    items = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([1, 2, None])) for i in range(2_000)]
    df = spark.createDataFrame(items, "k string, i int, v int").repartition(5)
    got = {r.i: (r.n, r.s) for r in running(df, ["k"], [F.desc("i")], "n", {"s": F.col("v")}).collect()}
    for k in ("hot", "a", "b", None):
        n = s = 0
        for _, i, v in sorted((x for x in items if x[0] == k), key=lambda x: -x[1]):
            n += 1
            assert got[i] == (n, s)
            s += v or 0
    assert [r.place for r in numbered(df.where("k is not null"), [F.col("i")]).orderBy("i").collect()] == list(range(sum(x[0] is not None for x in items)))
    assert running(df.limit(0), ["k"], [F.col("i")], "n").count() == 0


def test_dense_search_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(300)] + [(900, None), (901, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i bigint, v array<double>").repartition(4)
    got = {}
    for r in R.dense_top_k(df, df.where("i % 20 = 0"), "i", "v", "i", "v", 5, block=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.i
    sound = [(i, v) for i, v in rows if i is not None and v and any(v)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)
    for q, v in sound:
        if q % 20 == 0:
            want = sorted(sound, key=lambda x: (-cos(v, x[1]), x[0]))[:5]
            assert [got[q][k] for k in range(1, 6)] == [i for i, _ in want]
    assert R.dense_top_k(df, df.limit(0), "i", "v", "i", "v", 5).count() == 0 and R.dense_top_k(df.limit(0), df, "i", "v", "i", "v", 5).count() == 0
