import numpy as np

from evifold.llm.boilerplate import furniture, furniture_lines, main_body, smoothed, text_to_tag_ratio, threshold

PAGE = """Skip to main content
* [Home](/home)
* [News](/news)
News › Topics › Effect of Aspirin
# Effect of aspirin on headache
By Smith, Leeds
Menu choices at the canteen were changed to lower salt, as judged by two readers.
## Background
| Arm | n |
| --- | --- |
| a | 2 |
Dose: 15 mg daily
Patients could subscribe to reminder messages for 3 weeks.
Advertisement
Related articles
* [Managing gout with Aspirin](/a/1)
Aspirin for gout

Conclusions
The result was not convincing.
© 2020 Site. All rights reserved.
Powered by the Site content platform,
version 2.2"""


def test_page():
    assert furniture_lines(PAGE) == [1, 2, 3, 4, 14, 15, 16, 17, 21, 22, 23]


def test_pages_without_furniture_and_with_nothing_else():
    assert furniture_lines("A sentence about a trial.\n\nAnother one.") == []
    assert furniture_lines("Menu\n\nAccept all") == [1, 3]
    assert furniture_lines(" \n\n") == [] and furniture_lines("") == []


def test_other_languages():
    assert furniture_lines("Zum Inhalt springen\nDie Kosten lagen um 4 % höher.\nNach oben") == [1, 3]
    assert furniture_lines("Ce site utilise des cookies pour améliorer votre navigation.\nLa dose a été augmentée.\nÀ lire aussi\n* Titre (2010)") == [1, 3, 4]
    assert furniture_lines("Inicio / Guías / Fitanumab: epilepsia\nLa dosis se aumentó a 5 mg.\nVolver arriba") == [1, 3]


def test_ratio_smoothing_and_threshold():
    assert text_to_tag_ratio("<p>abc &amp; d</p>") < text_to_tag_ratio("abc and d")
    flat = smoothed(np.ones(9))
    assert np.allclose(flat, 1)
    peak = smoothed(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert peak.argmax() == 3 and np.isclose(peak[2], peak[4])
    assert 1 < threshold(np.array([0.9, 1.0, 1.1, 5.0, 5.2])) < 5 and threshold(np.array([2.0, 2.0])) == 2


def test_operator(spark):
    df = spark.createDataFrame([(1, PAGE, 9), (2, None, 9), (3, "", 9), (4, "Menu", 9), (4, "Menu", 9)], "page_id bigint, markdown string, line_no int")
    got = furniture(df, "page_id", "markdown").collect()
    assert sorted((r.item_id, r.line_no) for r in got if r.item_id != 1) == [(4, 1), (4, 1)] and sum(r.item_id == 1 for r in got) == 11
    body = {r.item_id: r.body for r in main_body(df, "page_id", "markdown").collect()}
    assert body[2] is None and body[4] == "" and body[3] == "" and "Menu choices" in body[1] and "Advertisement" not in body[1]
    assert furniture(df.limit(0), "page_id", "markdown").count() == 0


DANISH = """- [Forside](/)
- [Nyheder](/nyheder)
- [Sygdomme](/sygdomme)
- [Kontakt](/kontakt)
Log ind | Opret bruger | Hjælp
# Ny behandling mod gigt
Forskere fra to hospitaler har fulgt 412 patienter med gigt i fire år og målt, hvor ofte de måtte indlægges på ny.
Bivirkningerne var få, og de fleste deltagere fortsatte behandlingen i hele perioden uden at ændre deres dosis.
- Patienter over 70 år fik den halve dosis i de første seks uger.
- Kvinder og mænd havde lige stor gavn af behandlingen.
## Resultater
Antallet af indlæggelser faldt med en tredjedel, og forskellen var den samme på begge hospitaler i hele forløbet.
- [Om os](/om)
- [Privatliv](/privatliv)
- [Presse](/presse)
Til toppen
Annoncer
"""
DUTCH = """Hoofdmenu · Zoeken · Inloggen
<nav>Thuis
Ziekten</nav>
# Minder pijn na een heupoperatie
Onderzoekers volgden 230 mensen die een nieuwe heup kregen en vroegen hen elke week naar hun pijn en naar hun slaap.
De groep die vroeg begon te lopen had minder pijn, en dat verschil bleef na een half jaar nog even groot.
Meer lezen
* [Lopen na een operatie](/a/1)
* [Slapen met pijn](/a/2)
* [Vragen aan de arts](/a/3)
Disclaimer | Privacy | Colofon
"""


def test_languages_and_wording_of_no_list():
    for wording in (True, False):
        assert furniture_lines(DANISH, wording) == [1, 2, 3, 4, 5, 13, 14, 15, 16, 17]
        assert furniture_lines(DUTCH, wording) == [1, 2, 3, 7, 8, 9, 10, 11]


def test_ratio_decides_where_no_wording_is_listed():
    body = "The trial followed 412 patients for four years and counted how often they had to return to the hospital.\n" * 3
    menu = "\n".join(f"- [Entry {k}](/e/{k})" for k in range(6))
    assert furniture_lines(f"{menu}\n# A trial\n{body}", wording=False) == [1, 2, 3, 4, 5, 6]
    assert furniture_lines(body + menu, wording=False) == [4, 5, 6, 7, 8, 9]


def test_tags_of_open_elements_and_unclosed_tags():
    page = "<footer>\nA long line of text about the owners of this site, their address and their many other pages.\n</footer>\n# Title\nA sentence of the article, which is long enough to stand by itself on any page, p <0.05 and a<b in it."
    assert furniture_lines(page, wording=False) == [1, 2, 3]


def test_long_lines_are_read_whole():
    page = "Menu\n" + "word " * 100_000 + "end.\nNach oben"
    assert furniture_lines(page) == [1, 3]
