import random

import pytest

from evifold.llm.splitting import ANY, LINE, NEVER, PARAGRAPH, SENTENCE, RangeMax, boundary_strengths, piece_spans, split_oversized


def _check(text, limit, overlap):
    spans = piece_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    return spans


def test_range_maximum_against_brute_force():
    rng = random.Random(1)
    import numpy as np

    for n in (1, 2, 7, 64, 300):
        s = np.array([rng.randrange(5) for _ in range(n)], np.uint8)
        table = RangeMax(s, n)
        for _ in range(200):
            lo = rng.randrange(n)
            hi = rng.randrange(lo, n)
            best = max(s[lo : hi + 1])
            assert table.best(lo, hi) == (best, max(k for k in range(lo, hi + 1) if s[k] == best))


def test_random_texts_round_trip():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", ". ", "\n", "\n\n", "漢字", "。", "é", "👍🏽", ", ", "x" * 30]) for _ in range(rng.randrange(1, 400)))
        limit = rng.choice([30, 64, 200])
        _check(text, limit, rng.choice([0, 5, limit // 3]))


def test_prefers_stronger_boundaries_and_the_rightmost_of_equals():
    text = "a" * 50 + ".\n\n" + "b" * 20 + ". " + "c" * 10 + ". " + "d" * 60
    spans = _check(text, 90, 0)
    assert text[: spans[0][1]].endswith("\n\n")
    text = "a" * 50 + ". " + "b" * 20 + ". " + "c" * 60
    assert text[: _check(text, 90, 0)[0][1]].endswith("b. ")


def test_strengths():
    s = boundary_strengths("Ab. Cd\r\nx\n\ny。z")
    assert s[4] == SENTENCE and s[7] == NEVER and s[8] == LINE and s[11] == PARAGRAPH and s[13] == SENTENCE and s[1] == ANY


def test_unbroken_run_and_long_text():
    _check("x" * 10_000, 1800, 200)
    _check(("Satz eins. " * 40 + "\n\n") * 2_000, 1800, 200)


def test_no_cut_inside_a_cluster():
    text = "é" * 3_000
    for _, b in _check(text, 1_000, 100)[:-1]:
        assert text[b] == "e"


def test_bad_parameters():
    with pytest.raises(ValueError):
        piece_spans("abc", 9, 4)


def test_operator_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "kurz", "x"), (4, "kurz", "x"), (5, "wort " * 1_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = split_oversized(df).orderBy("item_id", "piece_no").collect()
    assert [r.piece for r in got if r.item_id == 4] == ["kurz", "kurz"] and {r.item_id for r in got} == {3, 4, 5}
    for r in got:
        assert r.piece == dict((a, b) for a, b, _ in rows)[r.item_id][r.start_char : r.end_char]
    assert split_oversized(df.limit(0)).count() == 0
