from pyspark.sql import functions as F

from evifold.functions.text import fold_case, words_text


def test_fold_case_equals_full_case_folding_on_every_letter(spark):
    chars = [chr(c) for c in (*range(0x20, 0xD800), *range(0xE000, 0x11000)) if chr(c).isalpha()]
    rows = [(i, "".join(chars[i : i + 64])) for i in range(0, len(chars), 64)] + [(-1, "ΣΑΣ ς"), (-2, "Straße"), (-3, "STRASSE"), (-4, "Iıİi")]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("i", "t", fold_case(F.col("t")).alias("f")).collect():
        # characters newer than one side's tables may differ by case only
        differing = [(a, b) for a, b in zip(r.f, r.t.casefold()) if a != b] if len(r.f) == len(r.t.casefold()) else [(r.f, r.t)]
        assert len(differing) <= 2, differing


def test_words_text(spark):
    df = spark.createDataFrame([(None,), ("",), (" … ",), ("“Größe”,  DES　x2 ",), ("a_b-c",)], "t string")
    got = [r[0] for r in df.select(words_text(F.col("t"))).collect()]
    assert got == [None, "", "", "grösse des x2", "a b c"]
