import random

import pytest

from evifold.llm.qapairs import SuffixAutomaton, defect, defective_pairs

ASKED = "Hello. My doctor suggested aspirin for gout. What should I watch for?"
ANSWER = "The most common adverse event was nausea, reported by a third of the group. Stop it and ask for advice if a rash appears."
CASES = [
    (ASKED, ANSWER, None), (ASKED, None, "empty"), (ASKED, " ​\n", "empty"), (ASKED, "<answer>\n</answer>", "empty"), (ASKED, "```\n```", "empty"), (ASKED, "N/A", "empty"), (ASKED, "<think>hm</think>", "empty"),
    (ASKED, "[empty response]", "empty"), (ASKED, ASKED.upper() + " ", "copied"), (ASKED, "Question: " + ASKED, "copied"), (ASKED, ASKED + "\n\n" + ASKED, "copied"), (ASKED, "You asked: " + ASKED + "\n\n" + ANSWER, None),
    (ASKED, "I'm sorry, but I can't help with that.", "refusal"), (ASKED, "I understand this is stressful. Sorry, I cannot answer questions about aspirin.", "refusal"), ("¿Es seguro tomar aspirina si tengo gota?", "Lo siento, no puedo ayudar con eso.", "refusal"),
    (ASKED, "I can't recommend stopping aspirin on your own, but here is what is known. " + ANSWER, None), (ASKED, "I'm sorry to hear about the rash. " + ANSWER, None),
    (ASKED, "Die Kosten lagen um vier Prozent höher und die Dosis wurde nicht erhöht. Für Menschen mit Gicht ist die Lage unsicher.", "language"),
    (ASKED + " Please answer in German.", "Die Kosten lagen um vier Prozent höher und die Dosis wurde nicht erhöht. Für Menschen mit Gicht ist die Lage unsicher.", None),
    (ASKED, "随访结束时两组之间没有显著差异。第二次就诊后剂量增加到40 mg。", "language"), (ASKED, ANSWER[:-30], "truncated"), (ASKED, ANSWER + " However, the", "truncated"), (ASKED, ANSWER + "\n```\ndose = [5, 10,", "truncated"),
    (ASKED, ANSWER + "\n\n| Drug | Dose |\n| --- | --- |\n| aspirin | 5 mg |", None), (ASKED, ANSWER + "\n| Drug | Dose |\n| --- | --- |\n| aspirin |", "truncated"), (ASKED, ANSWER + "\n3. **", "truncated"), (ASKED, "<answer>" + ANSWER, "truncated"),
    (ASKED, ANSWER + " [2]", None), (ASKED, ANSWER + "\n- aspirin: no change", None), (ASKED, ANSWER + "\nSource: https://a.example/1", None), (ASKED + " Reply in as few words as you can.", "Two weeks", None), (ASKED, "42 mg", None), (ASKED, "0", None),
    (None, ANSWER, None), (None, None, "empty"), ("", "Yes", None),
]


@pytest.mark.parametrize("asked,said,kind", CASES)
def test_defects(asked, said, kind):
    assert defect(asked, said) == kind


def test_suffix_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 15))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 15))]
        least = rng.randrange(1, 4)
        want = [False] * len(b)
        for i in range(len(b)):
            for j in range(i + least, len(b) + 1):
                if any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                    want[i:j] = [True] * (j - i)
        assert SuffixAutomaton(a).covered(b, least) == want


def test_operator(spark):
    rows = [(i, a, s, "x") for i, (a, s, _) in enumerate(CASES)] + [(1, ASKED, None, "x")]
    df = spark.createDataFrame(rows, "output_id bigint, problem string, final_response string, defect string")
    got = sorted((r.item_id, r.defect) for r in defective_pairs(df).collect())
    assert got == sorted([(i, k) for i, (_, _, k) in enumerate(CASES) if k] + [(1, "empty")])
    assert defective_pairs(df.limit(0)).count() == 0


REFUSED = [
    "I'd prefer not to get into that here.", "I have to pass on this one; a clinician would be better placed.", "That's a topic I steer clear of.", "Sorry, no.", "Wolałbym się na ten temat nie wypowiadać.", "Mi dispiace, non posso rispondere a questa domanda.",
    "We are not going to discuss this.", "Daar kan ik geen advies over geven.", "Jeg kan desværre ikke svare på det.", "Je préfère ne pas me prononcer.", "Prefiero no opinar sobre eso. Consulte con su médico.",
]


@pytest.mark.parametrize("said", REFUSED)
def test_refusals_are_composed(said):
    assert defect(ASKED, said) == "refusal"


@pytest.mark.parametrize("said", ["Patients can't answer the questionnaire after surgery, so proxies help.", "We cannot give a firm estimate, but the risk fell by 3%.", "I can't recommend it more: take it with food. The most common adverse event was nausea."])
def test_sentences_like_refusals(said):
    assert defect(ASKED, said) is None


def test_share_alone_decides_on_copies():
    asked = " ".join(f"w{k}" for k in range(200)) + "?"
    said = [f"w{k}" for k in range(200)]
    assert defect(asked, " ".join(said[:171] + ["x"] * 29)) == "copied" and defect(asked, " ".join(said[:168] + ["x"] * 32) + ".") is None


@pytest.mark.parametrize("said", ["De dosis werd niet verhoogd en het risico is voor de meeste mensen nog niet bekend, maar dat wordt nu door ons onderzocht.", "Dosen blev ikke øget, og risikoen er ikke kendt for de fleste, men det skal nu undersøges efter et år.", "이 약은 두 번째 방문 이후에 용량을 늘렸으며 부작용은 드물었습니다."])
def test_more_languages(said):
    assert defect(ASKED, said) == "language"
