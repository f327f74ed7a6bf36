import pytest

from evifold.llm.mojibake import evidence, find_wrong_decoding, restore

SOUND = [
    "", "plain ascii", "Das Verhältnis wurde geprüft — für “alle” Größen.", "CONCLUSÃO, AVALIAÇÃO e ÂNGULO pela MANHÃ: sim.", "Ângulo e manhã: © ® § ¼", "«Ça va»: â, ï, ½ — all well", "Grösse: ≥ 5 cm²", "β-blocker, α-agonist, ΔFEV₁",
    "│ Arm │ n │", "Þorri and Ðakar", "¿Cuándo conviene cambiar?", "Les effets de l’âge, l’hémoglobine glyquée.", "Качество доказательств признано низким из-за малой выборки. Он сказал: «СССР».", "偏头痛患者在停药前应先咨询医生。与安慰剂相比，使死亡率下降了56.3%。",
    "追跡終了時に両群の差は認められなかった。", "Łuszczycą (2016): zmniejszył jakość życia o 10% w porównaniu.", "The dose was 20 µg at 25 °C (±4).", "“Ã” is a letter.", "Caçlransen, Kaümerez and Naérdoric",
]
TEXTS = ["Das Verhältnis wurde für alle Größen geprüft — “sehr gut”.", "Les effets indésirables ont été évalués après l’âge.", "La dosis se aumentó después de la guía; ¿cuándo?", "A avaliação não é uma conclusão às cegas.", "Качество доказательств признано низким.", "研究者认为获益大于风险。随访结束时没有差异。", "Zmniejszył jakość życia, wątpliwość."]
WAYS = [("utf-8", "cp1252"), ("utf-8", "latin1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250")]


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts(text):
    assert evidence(text) is None and restore(text) == text


@pytest.mark.parametrize("true,taken", WAYS)
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text, true, taken):
    try:
        damaged = text.encode(true).decode(taken)
    except UnicodeDecodeError:
        damaged = "".join(bytes([b]).decode(taken, "ignore") or chr(b) for b in text.encode(true))
    assert evidence(damaged) is not None
    assert restore(damaged) == text


def test_only_the_damaged_span_is_changed():
    assert restore("Der Bär — und die GrÃ¶ÃŸe.") == "Der Bär — und die Größe."


def test_twice_damaged_and_lost():
    twice = "naïve estimate…".encode().decode("latin1").encode().decode("latin1")
    assert restore(twice) == "naïve estimate…"
    assert evidence("caf�") == "lost"


@pytest.mark.parametrize("true,taken", [("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1251", "latin1"), ("gbk", "latin1"), ("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1250", "latin1")])
def test_single_byte_damage_is_found(true, taken):
    found = 0
    for text in TEXTS:
        try:
            damaged = text.encode(true).decode(taken)
        except UnicodeError:
            continue
        if damaged != text:
            assert evidence(damaged) is not None, damaged
            found += 1
    assert found


def test_operator(spark):
    df = spark.createDataFrame([(1, "GrÃ¶ÃŸe"), (2, None), (3, ""), (4, "Größe"), (5, "x" * 50_000 + " cafÃ©"), (1, "GrÃ¶ÃŸe")], "doc_id bigint, text string").selectExpr("*", "1 AS evidence")
    got = find_wrong_decoding(df, with_text=True).orderBy("item_id").collect()
    assert [r.item_id for r in got] == [1, 1, 5] and got[0].restored == "Größe" and got[0].complete
    assert find_wrong_decoding(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a dose of 40 Ág daily", "took 50 碌g.", "No se observ贸 ninguna diferencia", "reviewed by Feþntoric in 2020", "ôNo part of it was read.ö", "imputed (▒7 %) again", "\nò Text size: A A A", "у 64 ОЮЖХЕМРНБ Я ЮМЕЛХЕИ", "Veldanvir: ЮМЕЛХЕИ (2015)"])
def test_short_damage_is_found(text):
    assert evidence(text) is not None


@pytest.mark.parametrize("true,taken", [("utf-8", "koi8_r"), ("utf-8", "cp866"), ("utf-8", "cp850"), ("utf-8", "iso8859_15"), ("utf-8", "cp1254"), ("utf-8", "big5"), ("utf-8", "gbk")])
def test_more_encodings_are_found(true, taken):
    found = 0
    for word in " ".join(TEXTS).split():
        try:
            damaged = word.encode(true).decode(taken)
        except UnicodeDecodeError:
            continue
        if damaged != word:
            found += evidence(" ".join([damaged] * 3)) is not None
    assert found >= 5


@pytest.mark.parametrize("text", ["МЕТОДЫ И РЕЗУЛЬТАТЫ", "ПРОТИВОПОКАЗАНИЯ", "Les malades âgés ont reçu 5 µg.", "Доза 5 мкг и 7 мг.", "患者25人にrador を投与", "│ Arm │ n │\n│ a │ 5 │"])
def test_more_sound_texts(text):
    assert evidence(text) is None


def test_damage_made_six_times():
    text = six = "Größe — naïve"
    for _ in range(6):
        six = six.encode().decode("latin1")
    assert restore(six) == text
