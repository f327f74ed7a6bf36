import random
import re

import numpy as np

from evifold.llm import contamination
from evifold.llm.contamination import _back, _places, _times, find_leaks, lcs_length

FILLER = [f"w{k}" for k in range(400)]


def _corpus(seed):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(60)]
    pool = [(f"q{k}", " ".join(rng.choice(common) if rng.random() < 0.7 else f"n{k}x{rng.randrange(9)}" for _ in range(60)), " ".join(rng.choice(common) for _ in range(40))) for k in range(40)]
    docs = []
    for i in range(300):
        words = [rng.choice(FILLER) if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            q = rng.choice(pool)[rng.choice((1, 2))].split()
            n = rng.choice((11, 12, 13, 14, 20, 40))
            s = rng.randrange(0, len(q) - n + 1)
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in q[s : s + n]]
        docs.append((i, " ".join(words)))
    return docs, pool


def _brute(docs, pool):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").casefold())
    grams = lambda t: {tuple(w[k : k + 13]) for w in [words(t)] for k in range(len(w) - 12)}
    return {(i, q) for i, t in docs for q, p, a in pool if q is not None and grams(t) & (grams(p) | grams(a))}


def test_recall_against_brute_force(spark):
    docs, pool = _corpus(5)
    docs += [(900, None), (901, ""), (902, pool[3][1]), (902, pool[3][1]), (903, "ß " * 3_000)]
    pool += [pool[0], ("none", None, None), (None, pool[1][1], None), ("short", "too short", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS keys", "'x' AS ids").repartition(3)
    held = spark.createDataFrame(pool, "question_id string, problem string, accepted_answer string")
    got = find_leaks(df, held).collect()
    want = _brute(docs, pool)
    assert {(r.item_id, r.question_id) for r in got if r.kind == "verbatim"} == want and len(want) > 40
    assert len(got) == len({(r.item_id, r.question_id, r.field) for r in got})
    assert find_leaks(df.limit(0), held).count() == 0 and find_leaks(df, held.limit(0)).count() == 0


def test_paraphrase(spark):
    rng = random.Random(6)
    held = [(f"q{k}", " ".join(f"t{k}y{rng.randrange(30)}" for _ in range(48)), None) for k in range(8)]
    words = held[2][1].split()
    changed = " ".join("other" if k % 9 == 8 else w for k, w in enumerate(words))
    df = spark.createDataFrame([(1, changed), (2, " ".join(FILLER))], "doc_id bigint, text string")
    got = find_leaks(df, spark.createDataFrame(held, "question_id string, problem string, accepted_answer string")).collect()
    assert [(r.item_id, r.question_id, r.kind) for r in got] == [(1, "q2", "paraphrase")]


def test_paraphrase_with_every_fourth_word_replaced(spark):
    rng = random.Random(8)
    held = [(f"q{k}", " ".join(f"t{k}y{rng.randrange(30)}" for _ in range(48)), None) for k in range(8)]
    changed = [(k, " ".join("other" if n % 4 == k else w for n, w in enumerate(held[k][1].split()))) for k in range(4)]
    df = spark.createDataFrame([*changed, (9, " ".join(FILLER))], "doc_id bigint, text string")
    got = find_leaks(df, spark.createDataFrame(held, "question_id string, problem string, accepted_answer string")).collect()
    assert sorted((r.item_id, r.question_id, r.kind) for r in got) == [(k, f"q{k}", "paraphrase") for k in range(4)]


def test_linear_algebra_against_dense():
    rng = np.random.RandomState(0)
    ids = rng.randint(0, 9, (50, 16)).astype(np.uint32)
    weights = rng.rand(9)
    weights[0] = 0
    dense = np.zeros((50, 9))
    for r, row in enumerate(ids):
        for t in set(row.tolist()):
            dense[r, t] = np.sqrt((row == t).sum()) * weights[t]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    basis = rng.rand(9, 4)
    assert np.allclose(_times(ids, weights, basis), dense @ basis, atol=1e-5)
    product = rng.rand(50, 4)
    assert np.allclose(_back(ids, weights, product, 9), dense.T @ product, atol=1e-5)


def test_lcs_against_table():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, _places(b)) == t[-1][-1]


def test_answer_check_short_fields_and_scripts_without_blanks(spark):
    rng = random.Random(9)
    held = [(f"q{k}", " ".join(f"t{k}y{rng.randrange(30)}" for _ in range(16)), " ".join(f"a{k}z{rng.randrange(30)}" for _ in range(20))) for k in range(6)]
    held += [("brief", "which dose of aspirin helps", "two tablets"), ("han", "患者服用该药物后出现头痛应当如何处理并且何时复诊", None)]
    one = held[1][1].split()
    one[5] = one[11] = "other"
    docs = [
        (1, " ".join(one) + " . " + held[1][2]), (2, " ".join(one)), (3, "So: WHICH dose of Aspirin helps?"), (4, "which dose of it helps"),
        (5, "前言。" + held[7][1] + "。结束"), (6, " ".join(FILLER)),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.item_id, r.question_id, r.field): r for r in find_leaks(df, spark.createDataFrame(held, "question_id string, problem string, accepted_answer string")).collect()}
    assert got[1, "q1", "problem"].kind == "paraphrase" and got[1, "q1", "problem"].other_share == 1.0 and got[1, "q1", "accepted_answer"].kind == "verbatim"
    assert got[2, "q1", "problem"].other_share == 0.0 and (2, "q1", "accepted_answer") not in got
    assert got[3, "brief", "problem"].kind == "short" and got[5, "han", "problem"].kind == "verbatim" and {k[0] for k in got} == {1, 2, 3, 5}


def test_pool_in_blocks(spark, monkeypatch):
    docs, pool = _corpus(5)
    df, held = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(pool, "question_id string, problem string, accepted_answer string")
    monkeypatch.setattr(contamination, "POOL_ROWS", 15)
    monkeypatch.setattr(contamination, "POOL_WORDS", 150)
    assert {(r.item_id, r.question_id) for r in find_leaks(df, held, paraphrases=False).where("kind = 'verbatim'").collect()} == _brute(docs, pool)


def test_common_subsequences_of_many_pairs():
    rng = np.random.RandomState(4)
    windows, passages = rng.randint(0, 6, (300, 16)).astype(np.uint32), rng.randint(0, 6, (300, 40)).astype(np.uint32)
    passages[:100, 25:] = 0
    for w, p, n in zip(windows, passages, contamination.lcs_lengths(windows, passages)):
        text = "".join(contamination._char(x) for x in w if x)
        held = "".join(contamination._char(x) for x in p if x)
        assert n == lcs_length(text, _places(held))
    lists = [p[p > 0] for p in passages]
    pairs = contamination._pair_lengths(windows, np.arange(300), np.arange(300), lists)
    assert (pairs == contamination.lcs_lengths(windows, passages)).all()
