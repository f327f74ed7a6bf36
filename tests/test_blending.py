import random

import duckdb
import pytest

from evifold.operators import blending as B
from evifold.operators import ranking as R
from evifold.plans import ranking_queries as Q

WORDS = "alpha beta gamma delta epsilon zeta 漢 字 x1 of the in".split()


def _documents(n, rng):
    rows = []
    for i in range(1, n + 1):
        words = lambda least, most: " ".join(rng.choices(WORDS, [1, 1, 2, 2, 3, 3, 1, 1, 1, 9, 9, 9], k=rng.randrange(least, most)))
        title = rng.choice([None, "", "rare" + str(i % 40), "the", words(1, 6), words(1, 6), words(1, 6), words(1, 6)])
        text = rng.choice([None, "", words(0, 80), words(0, 80), words(0, 80)]) if i > 20 else f"{title or ''} only here"
        rows.append((i, title, rng.choice([None, "", "nowhere else", words(3, 25), words(3, 25)]), text))
    return rows + [(n + i, *r[1:]) for i, r in enumerate(rows[:30], 1)]


def _table(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, title string, snippet string, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _both(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = Q.bm25_anchor_blend(spark, folder)
    found = con.execute(Q.SQL["bm25_anchor_blend"])
    return sorted(map(tuple, got.select([d[0] for d in found.description]).collect())), sorted(found.fetchall())


@pytest.mark.parametrize("limits", [{}, {"CELLS": 700, "PAIRS": 13}, {"BROADCAST_TERMS": 150}, {"BROADCAST_TERMS": 150, "NUMBERED_TERMS": 5}, {"LEFT_OUT": 1.0, "CELLS": 700}, {"LEFT_OUT": 0.0}])
def test_blend_equals_its_sql(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(R if name == "BROADCAST_TERMS" else B, name, value)
    got, want = _both(spark, _table(spark, tmp_path, _documents(500, random.Random(11))))
    assert got == want and len(got) > 100


def test_blend_of_a_term_that_all_documents_have(spark, tmp_path):
    got, want = _both(spark, _table(spark, tmp_path, [(i, "the", "the the" if i % 40 else None, "the") for i in range(1, 90)]))
    assert got == want and len(got) == 40


def test_blend_without_queries_and_with_shared_ids(spark, tmp_path):
    assert _both(spark, _table(spark, tmp_path / "a", [(20, None, "alpha", "alpha"), (21, "alpha", None, "alpha")])) == ([], [])
    rows = _documents(100, random.Random(5))
    got, want = _both(spark, _table(spark, tmp_path / "b", rows + [(40, "alpha of beta", "gamma", "gamma delta"), (41, rows[40][1], None, rows[40][3])]))
    assert got == want and got


def test_blend_moves_no_row_for_each_pair(spark, tmp_path):
    folder = _table(spark, tmp_path, [(i, f"the a{i % 50}", f"the b{i % 70}", f"the b{i % 70} c{i}") for i in range(1, 2001)])
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in _listed(spark)}
    before = stages()
    assert Q.bm25_anchor_blend(spark, folder).count() == 1000
    moved = sum(n for key, n in stages().items() if key not in before)
    assert moved < 2_000 * 100 / 4  # each of the 100 queries shares a word with each of the 2,000 documents


def _listed(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
