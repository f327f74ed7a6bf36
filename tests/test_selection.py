import random

from pyspark.sql import functions as F

from evifold.operators import selection as S


def test_headings_and_sections(spark):
    df = spark.createDataFrame([("3. References:", "Smith et al. 2010;12"), ("Funding", "x"), (None, None), ("Menu", "home news"), ("Results", "A long sentence. " * 20), ("Share", "© 2020. All rights reserved. Privacy policy.")], "h string, t string")
    got = [tuple(r) for r in df.select(S.heading_kind(F.col("h")), S.section_class(F.col("h"), F.col("t"))).collect()]
    assert got == [("bibliography", "bibliography"), ("publication_metadata", "publication_metadata"), ("content", "content"), ("web_boilerplate", "web_boilerplate"), ("content", "content"), ("web_boilerplate", "web_boilerplate")]
    penalties = [r[0] for r in spark.createDataFrame([("Keywords", "reduced by 5 %"), ("Keywords", "words"), ("Results", "x" * 400), ("Results", "All rights reserved")], "h string, t string").select(S.quality_penalty(F.col("h"), F.col("t"))).collect()]
    assert penalties == [0.0, 2.0, 0.0, 100.0]


def _three_slots(rows):
    """The rule as a loop: rows are (rank, section, good, complement) in rank order."""
    chosen = [rows[0]]
    rest = rows[1:]
    if rest:
        second = next((r for r in rest if r[3]), rest[0])
        chosen.append(second)
        left = [r for r in rest if r is not second][:3]
        pool = [r for r in left if r[2]] or left
        if pool:
            used = {r[1] for r in chosen}
            chosen.append(next((r for r in pool if r[1] not in used), pool[0]))
    return [r[0] for r in chosen]


def test_three_slots_against_the_loop(spark):
    rng = random.Random(1)
    groups = {g: [(k, rng.choice("abc"), rng.random() < 0.5, rng.random() < 0.2) for k in range(1, rng.randrange(2, 8))] for g in range(60)}
    df = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g int, rank int, section string, good boolean, complement boolean")
    got = {}
    for r in S.three_slots(df, ["g"], "rank", "section", F.col("good"), "complement").where("slot is not null").collect():
        got.setdefault(r.g, {})[r.slot] = r["rank"]
    for g, rows in groups.items():
        assert [got[g][s] for s in sorted(got[g])] == _three_slots(rows)


def test_rerank_leaves_the_tail(spark):
    df = spark.createDataFrame([("q", i, float(i % 4), float(-i)) for i in range(1, 8)], "q string, pos int, a double, b double")
    got = {r.pos: r.final for r in S.rerank_head(df, ["q"], "pos", ["a", "b"], head=4).collect()}
    assert {got[5], got[6], got[7]} == {5, 6, 7} and got[5] == 5 and sorted(got.values()) == list(range(1, 8))


def test_windows_of_candidates(spark):
    rows = [("r", f"c{i}", i, i <= 5, float(i % 3), ["unread", "read", "blocked", None][i % 4]) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "r string, id string, age int, new boolean, s double, state string")
    shown = [r.id for r in S.visible(df, ["r"], F.col("new"), F.col("s"), F.col("age"), "id", 8, 3).orderBy("slot").collect()]
    assert shown[:3] == ["c1", "c2", "c3"] and shown[3] == "c8" and len(shown) == 8 and shown[-1] == "c9"
    order = [r.id for r in S.unread_first(df, ["r"], "age", "state").orderBy("slot").collect()]
    assert order == ["c3", "c4", "c7", "c8", "c1", "c5", "c9"]
    merged = S.merge_pools(df.where("new"), df.where("age > 3"), ["r"], "id", "age", 20).orderBy("slot")
    assert [r.id for r in merged.collect()] == [f"c{i}" for i in range(1, 11)]
    assert S.above_threshold(df, ["r"], "s", "id", 1.0, 4).count() == 4


def test_scores(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(S.authority(F.lit("a.who.int"), {"who.int": 110, "int": 70}))[0] == 110 and one(S.authority(F.lit("x"), {"who.int": 110}))[0] == 60
    assert one(S.citation_fit(F.lit("dose 5 mg works"), F.lit("the dose of 5 works")))[0] == 1.0 and one(S.citation_fit(F.lit("dose 6"), F.lit("dose 5")))[0] == -1.0
    assert one(S.anchored_query(F.lit("é" * 10), F.lit("f"), 5, 9))[0] == "éé\nf\nf"
    words = lambda *w: F.array(*map(F.lit, w))
    full = one(S.web_score(words("what", "aspirin"), words("gout"), words("aspirin", "gout", "cohort"), F.lit("http://x/tag/1"), F.lit(100), F.lit(999.0)))[0]
    assert full == 200 + 10 + 12 - 10 - 180
    score = one(S.paper_score(words("a", "b"), words("a", "b", "c"), F.lit("x" * 240), F.lit("2010-01"), F.lit("meta_analysis"), F.lit(True)))[0]
    assert score == 80 + 20 + 30 + 12 + 2.5 + 2
