"""Defective pairs of a prompt and a response: empty, copied, refusal, language, truncated.

A suffix automaton of the prompt's words measures how much of the response is copied from it; an Aho-Corasick
automaton finds refusals, by whole phrases or composed of a speaker who can't, may not or will not, and an act of
answering or helping; a stack of delimiters and the last line show a response that breaks off; votes of
function words and scripts give the languages of both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIED, LEAST_MATCH = 0.85, 3

# fixed values: placeholders, labels, phrases of refusals and of courtesy, function words
PLACEHOLDERS = frozenset("n a|na|none|null|nil|nan|tbd|tba|todo|undefined|empty|empty response|no response|no answer|no output|placeholder|answer|response|final answer|output|result|your answer here|insert answer here|antwort|réponse|reponse|respuesta|resposta|ответ|答案|回答|答|odpowiedź|lorem ipsum".split("|"))
LABELS = frozenset("question|q|prompt|problem|query|you asked|the question is|the question was|user|user question|human|input|task|frage|pregunta|pergunta|вопрос|问题|質問|pytanie|answer|a|response|repeat|original question".split("|"))
REFUSALS = [
    "i'm sorry, but i can't", "i am sorry, but i can", "i can't help", "i cannot help", "i can't assist", "i cannot assist", "can't help with that", "i cannot answer", "i can't answer", "cannot answer questions", "can't answer questions",
    "i can't provide", "i cannot provide", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to", "must decline", "have to decline", "i decline to", "i won't be able to", "i will not be able to", "i won't answer",
    "falls outside what i'm allowed", "falls outside what i am allowed", "outside the scope of what i", "not allowed to discuss", "i'd rather not", "i would rather not", "is not something i can assist", "not something i can help", "i don't have the ability to respond",
    "i do not have the ability to", "no answer can be given", "i can't comment", "i cannot comment", "i can't discuss", "i cannot discuss", "against my guidelines", "i'm not permitted", "i am not permitted", "i can't give medical advice", "i cannot give medical advice",
    "can't comply", "cannot comply", "cannot fulfill", "can't fulfill", "unable to help", "unable to answer", "unable to assist", "not in a position to", "not comfortable answering", "beyond what i can", "can't respond to", "cannot respond to", "i refuse to", "i must refuse",
    "darf ich keine", "ich darf keine", "keine auskunft", "muss ich ablehnen", "ich lehne es ab", "nicht befugt", "kann ich keine auskunft", "je ne saurais", "je ne suis pas autorisé", "je dois décliner", "je refuse de", "je ne peux rien dire",
    "no voy a responder", "debo declinar", "no se me permite", "não vou responder", "não me é permitido", "tenho de recusar", "recuso-me", "odmawiam", "nie wolno mi", "не буду отвечать", "вынужден отказаться", "не имею права", "不能回答", "拒绝回答", "无权", "不方便回答",
    "kann ich nicht helfen", "kann ich leider nicht", "ich kann diese frage nicht", "kann ich nicht beantworten", "ich darf keine", "darf ich nicht beantworten", "nicht beantworten", "keine auskunft geben", "dazu möchte ich mich nicht äussern",
    "je ne peux pas répondre", "je ne peux pas vous aider", "je ne suis pas en mesure", "ne m'est pas possible de", "je ne peux pas donner", "je préfère ne pas répondre",
    "no puedo ayudar", "no puedo responder", "no me es posible", "no puedo dar", "no puedo ofrecer", "prefiero no responder", "no estoy autorizado",
    "não posso ajudar", "não posso responder", "não me é possível", "não posso fornecer", "não posso dar", "não estou autorizado",
    "не могу ответить", "не могу помочь", "не вправе", "не могу дать", "отказываюсь отвечать",
    "我无法回答", "无法回答这个", "我不能提供", "不能提供", "无法提供", "我无法提供", "不便回答", "无法帮助", "抱歉,我",
    "お答えできません", "回答できません", "お手伝いできません", "提供できません", "お役に立てません",
    "nie mogę pomóc", "nie mogę odpowiedzieć", "nie mogę udzielić", "nie jestem w stanie",
]
COURTESY = [
    "thank you for your question", "thanks for your question", "thank you for asking", "i understand this is", "i understand that this", "please consult", "please speak with", "please talk to", "please see a", "please contact", "if you are worried", "is there anything else",
    "i hope you understand", "i apologize", "i apologise", "i'm sorry to hear", "let me know if", "a pharmacist would be", "consult a healthcare", "seek medical advice", "would you like to talk", "feel free to",
    "bitte wenden sie sich", "bitte sprechen sie", "es tut mir leid", "vielen dank für ihre frage", "haben sie noch", "veuillez consulter", "merci pour votre question", "je suis désolé", "consulte a", "consulte con", "consulte um", "gracias por su pregunta", "lo siento", "desculpe",
    "obrigado pela", "извините", "обратитесь к", "спасибо за вопрос", "请咨询", "抱歉", "感谢您的", "申し訳", "医師に相談してください", "przepraszam", "skonsultuj", "dziękuję za",
]
#: Parts of refusals by language: a speaker who can't, may not or will not; an act of answering or helping; and what declines by itself.
UNWILLING = {
    "en": "can't|cannot|can not|couldn't|could not|won't|will not|wouldn't|not able|unable|not allowed|not permitted|not authorised|not authorized|prefer not|rather not|not going to|not comfortable|not in a position|not willing|unwilling|not qualified|not prepared|not free to|not at liberty|hesitant|not supposed to|not meant to|not designed to",
    "de": "lieber nicht|kann nicht|kann leider nicht|können nicht|kann dazu nicht|kann dazu nichts|kann ich nicht|kann ich nichts|kann ich leider|kann ich dazu|darf nicht|darf ich nicht|darf dazu|darf ich dazu|darf ich keine|darf keine|möchte nicht|möchte ich nicht|möchte ich lieber nicht|möchte mich nicht|werde nicht|werde ich nicht|nicht in der lage|nicht befugt|nicht berechtigt|steht mir nicht zu",
    "fr": "ne peux pas|ne peux rien|ne puis|ne pouvons pas|ne suis pas en mesure|ne suis pas autorisé|ne suis pas habilité|ne saurais|ne veux pas|ne souhaite pas|préfère ne pas|préfère ne rien|ne vais pas|m'est impossible",
    "es": "no puedo|no podemos|no voy a|no me es posible|no estoy autorizado|no estoy en condiciones|no se me permite|prefiero no|no quiero|no debo|no me corresponde|me es imposible",
    "pt": "não posso|não podemos|não vou|não me é possível|não estou autorizado|não estou em condições|não me é permitido|prefiro não|não quero|não devo|não me cabe",
    "it": "non posso|non possiamo|non sono in grado|non sono autorizzato|non mi è possibile|non mi è permesso|preferisco non|non voglio|non intendo|non me la sento|non devo|non saprei",
    "nl": "kan ik geen|kan niet|kan u niet|kan je niet|kan ik niet|kan daar niet|kan daar geen|kan hier geen|mag niet|mag ik niet|mag geen|mag ik geen|wil niet|wil ik niet|niet in staat|niet bevoegd|liever niet|liever geen|ga ik niet",
    "pl": "wolałbym|wolałabym|nie mogę|nie możemy|nie jestem w stanie|nie wolno mi|nie chcę|nie będę|wolę nie|wolałbym nie|wolałabym nie|nie mam prawa|nie jestem upoważniony",
    "ru": "не могу|не можем|не буду|не стану|не вправе|не имею права|не хочу|предпочитаю не|не в состоянии|не уполномочен",
    "sv": "kan inte|kan tyvärr inte|får inte|vill inte|vill helst inte|tänker inte", "da": "kan ikke|kan desværre ikke|må ikke|vil ikke|vil helst ikke|ønsker ikke", "cs": "nemohu|nemůžu|nesmím|nechci|nebudu|raději ne",
    "tr": "edemem|veremem|cevaplayamam|yardımcı olamam|yanıtlayamam",
}
ANSWERING = {
    "en": "answer|help|assist|respond|reply|comment|discuss|provide|give|offer|advise|advice|talk about|talk to you about|speak about|speak to|speculate|say|share|engage|get into|go into|go there|address|weigh in|comply|fulfil|opine|support|say more|take this|take that|take a position|guide you",
    "de": "antwort|beantwort|helfen|hilfe|auskunft|sagen|äussern|rat geben|raten|beraten|empfehl|eingehen|stellung nehmen|weiterhelfen|besprechen|unterstützen|geben",
    "fr": "répondre|aider|dire|conseil|donner|fournir|commenter|discuter|parler|aborder|assister|me prononcer|renseigner|entrer dans",
    "es": "responder|contestar|ayudar|decir|aconsejar|consejo|dar|ofrecer|comentar|hablar|proporcionar|opinar|tratar|entrar en|pronunciarme",
    "pt": "responder|ajudar|dizer|aconselhar|conselho|dar|oferecer|comentar|falar|fornecer|opinar|tratar|entrar em|pronunciar",
    "it": "risponder|aiutar|dire|consigli|dare|fornir|comment|parlar|discuter|pronunciar|assister|entrare nel",
    "nl": "antwoord|beantwoord|helpen|hulp|zeggen|advies|advis|geven|bespreken|ingaan|uitspraak|praten over",
    "pl": "odpowiedzieć|odpowiadać|pomóc|powiedzieć|udzielić|udzielać|doradz|porad|komentować|rozmawiać|wypowiadać|podać|zabierać głosu",
    "ru": "отвечать|ответить|помочь|помогать|сказать|говорить|совет|дать|давать|комментировать|обсуждать|рекоменд|консультировать|высказываться",
    "sv": "svara|hjälpa|säga|råd|ge|diskutera|kommentera", "da": "svare|besvare|hjælpe|sige|råd|give|diskutere|kommentere", "cs": "odpovědět|odpovídat|pomoci|pomoct|říci|říct|poradit|radit|poskytnout|komentovat",
    "tr": "edemem|veremem|cevaplayamam|yardımcı olamam|yanıtlayamam",
}
DECLINING = [
    "i decline", "i must decline", "i'll have to decline", "i respectfully decline", "i pass on", "i'll pass", "i will pass", "have to pass", "need to pass", "going to pass on", "steer clear of", "stay away from that", "stay away from this", "stay out of", "sit this one out", "off limits for me", "off-limits for me",
    "not something i can", "not something i'm", "not something i discuss", "not something i answer", "not something i do", "not something i will", "not a topic i", "isn't a topic i", "not a question i", "isn't a question i", "no comment", "i refuse", "i abstain", "not for me to say", "not my place to", "i'm out of my depth", "sorry, no.", "sorry, but no.",
    "i keep out of", "i don't do medical", "i don't give", "i do not give", "i don't answer", "i do not answer", "i don't discuss", "i do not discuss", "i don't comment", "i do not comment", "i have nothing to say", "leave this one unanswered", "leave that unanswered", "best left to a",
    "lehne ich ab", "lehne die antwort", "dazu sage ich nichts", "kein kommentar", "tut mir leid, nein.", "dazu schweige ich", "je décline", "je refuse", "pas de commentaire", "désolé, non.", "declino", "me niego a", "sin comentarios", "lo siento, no.", "me abstengo", "recuso", "sem comentários", "desculpe, não.",
    "mi rifiuto", "rifiuto di", "devo declinare", "devo rifiutare", "nessun commento", "mi dispiace, no.", "mi astengo", "ik weiger", "ik moet weigeren", "ik pas hiervoor", "geen commentaar", "sorry, nee.", "odmawiam", "muszę odmówić", "bez komentarza", "niestety nie.", "отказываюсь", "вынужден отказать", "без комментариев", "извините, нет.", "jag avböjer", "jag måste avböja", "jeg må afvise", "jeg afviser", "odmítám",
]
STOPWORDS = {
    "en": "the of and to in is was with for that this on by from are were be or an as at it not have has had but which their than when after before can what how should would does do your you my",
    "de": "der die das und ist war mit für von den dem des ein eine einen einer nicht auf im bei nach zu zur zum werden wurde wird oder auch sich als noch unter über ich kann wie wann welche sollte wer",
    "fr": "le la les des du de et est été pour dans que qui une un sur avec par pas plus ou au aux ce cette ces ses leur il elle ne se sont après chez comme être quels quelle quel faut peut on en cas prendre entre sont-ils",
    "es": "el la los las del de y es fue para que en una un con por no más o al su sus se lo como después aunque muy sigue qué cuándo cómo este esta está si entre sin en tomar es tengo",
    "pt": "o a os as do da dos das de e é foi para que em uma um com por não mais ou ao sua seu se no na nos nas como após também muito qual pode à às são em tomar entre tenho",
    "pl": "i w na z do nie się że jest po o od przez za oraz lub dla był była były które który ponieważ dopiero czy jak między u",
    "ru": "и в на с не что по о от для за из к у при после это как или был была было но до их между можно ли",
    "nl": "de het een en van is was met voor niet dat die zijn werd worden ook nog wel naar bij uit aan door maar over dan als deze hun geen heeft hebben kan moet",
    "it": "il lo gli della dello delle degli dei nel nella sono era è con per che non più anche alla dal dalla come questo questa gli una uno ha hanno può si tra",
    "sv": "och att det som är var för med inte av till på om ett den har kan ska från efter eller också men vid",
    "da": "og at det som er var for med ikke af til på om et den har kan skal fra efter eller også men ved blev",
    "cs": "a je se na že do si jako pro ale po při nebo byl byla bylo jsou který která také již podle ze",
    "tr": "ve bir bu için ile olarak da de daha çok gibi olan sonra kadar en değil ancak veya olduğu göre",
}
#: Scripts that stand for one language here, with the characters that tell it.
SCRIPTS = {"ko": "\uac00-\ud7a3", "ar": "\u0600-\u06ff", "he": "\u0590-\u05ff", "el": "\u0370-\u03ff", "th": "\u0e00-\u0e7f", "hi": "\u0900-\u097f"}
#: Names of languages as a problem may ask for them, and how it asks.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglês английском английски 英语 英文 英語 angielsku angielski",
    "de": "german deutsch allemand alemán aleman alemão немецком немецки 德语 德文 ドイツ語 niemiecku niemiecki",
    "fr": "french französisch français francais francés frances francês французском французски 法语 法文 フランス語 francusku francuski",
    "es": "spanish spanisch espagnol español espanol castellano espanhol испанском испански 西班牙语 スペイン語 hiszpańsku hiszpański",
    "pt": "portuguese portugiesisch portugais portugués portugues português португальском португальски 葡萄牙语 ポルトガル語 portugalsku portugalski",
    "pl": "polish polnisch polonais polaco polonês польском польски 波兰语 ポーランド語 polsku polski",
    "ru": "russian russisch russe ruso russo русском русски 俄语 俄文 ロシア語 rosyjsku rosyjski",
    "zh": "chinese chinesisch chinois chino chinês китайском китайски 中文 汉语 中国語 chińsku chiński",
    "ja": "japanese japanisch japonais japonés japonês японском японски 日语 日文 日本語 japońsku japoński",
    "nl": "dutch niederländisch holländisch néerlandais neerlandés holandés holandês нидерландском голландском 荷兰语 オランダ語 niderlandzku nederlands",
    "it": "italian italienisch italien italiano итальянском 意大利语 イタリア語 włosku",
    "sv": "swedish schwedisch suédois sueco шведском 瑞典语 スウェーデン語 szwedzku svenska",
    "da": "danish dänisch danois danés dinamarquês датском 丹麦语 デンマーク語 duńsku dansk",
    "cs": "czech tschechisch tchèque checo tcheco чешском 捷克语 チェコ語 czesku česky",
    "tr": "turkish türkisch turc turco турецком 土耳其语 トルコ語 turecku türkçe",
    "ko": "korean koreanisch coréen coreano корейском 韩语 韓国語 koreańsku 한국어", "ar": "arabic arabisch arabe árabe арабском 阿拉伯语 アラビア語 arabsku العربية", "he": "hebrew hebräisch hébreu hebreo иврите 希伯来语 ヘブライ語 hebrajsku עברית",
    "el": "greek griechisch grec griego grego греческом 希腊语 ギリシャ語 grecku ελληνικά", "th": "thai thailändisch thaï tailandés тайском 泰语 タイ語 tajsku ไทย", "hi": "hindi хинди 印地语 ヒンディー語 हिन्दी",
}

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
_THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
_HAN, _KANA, _CYRILLIC = re.compile("[\u4e00-\u9fff]"), re.compile("[\u3040-\u30ff]"), re.compile("[\u0400-\u04ff]")
_LATIN = re.compile(r"(?:(?![\d_])[\x00-\u024f])(?<=\w)")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_SENTENCE = re.compile(r"(?<=[.!?。？！])\s*(?=\S)|\n+")
_END = re.compile(r"[.!?。！？…|`\])}”\"'’»›>*_]$")
_HARD_OPEN = re.compile(r"(?:[,;:–—-]|[(\[{“„«]|\b(?:and|or|but|the|of|with|to|by|und|oder|der|die|et|ou|le|la|de|y|o|el|и|в|na|i)|\*\*)$", re.I)
#: More characters than any of these ends has, with the one before it.
_OPEN_CHARS = 8
_LIST_LINE = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_CITE_END = re.compile(r"\[\d{1,3}(?:[,–-]\s*\d{1,3})*\]\s*$")
_LINK_END = re.compile(r"https?://\S+")
_POLITE = re.compile(r"\s*(?:please|kindly|bitte|veuillez|merci de|por favor|consulte|consultez|пожалуйста|обратитесь|请|ご相談|proszę)", re.I)
_FIRST_PERSON = re.compile(r"\b(?:i|we|me|us|my|i'm|i'd|i'll|we're|we'd)\b")
_DIGIT = re.compile(r"\d")
_ASK = re.compile(r"\b(?:respond|answer|reply|write|translate|antworte\w*|répond\w*|respond\w*|responda|ответ\w*|odpowied\w*)\b|回答|答え|翻译|用", re.I)


class SuffixAutomaton:
    """Suffix automaton of a sequence of words."""

    def __init__(self, words: Sequence[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            here = self._state(self.length[last] + 1)
            at = last
            while at >= 0 and w not in self.next[at]:
                self.next[at][w] = here
                at = self.link[at]
            if at < 0:
                self.link[here] = 0
            else:
                to = self.next[at][w]
                if self.length[at] + 1 == self.length[to]:
                    self.link[here] = to
                else:
                    twin = self._state(self.length[at] + 1)
                    self.next[twin], self.link[twin] = dict(self.next[to]), self.link[to]
                    while at >= 0 and self.next[at].get(w) == to:
                        self.next[at][w] = twin
                        at = self.link[at]
                    self.link[to] = self.link[here] = twin
            last = here

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def covered(self, words: Sequence[str], least: int) -> list[bool]:
        """Which of ``words`` lie in a stretch of at least ``least`` words that stands in the automaton's text."""
        out, state, length = [False] * len(words), 0, 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if length >= least:
                out[k - length + 1 : k + 1] = [True] * length
        return out


@lru_cache(maxsize=8)
def words(text: str) -> tuple[str, ...]:
    """Case-folded words; each Han or kana character is one. The last few texts are kept, as several checks ask for them."""
    return tuple(_WORD.findall(text.casefold()))


def _content(response: str | None) -> str:
    return _TAG.sub(" ", _THINK.sub(" ", response or ""))


def is_empty(response: str | None) -> bool:
    """Nothing, blanks, bare markup or a bare placeholder."""
    found = words(_content(response))
    return not found or " ".join(found) in PLACEHOLDERS


def is_copied(problem: str | None, response: str) -> bool:
    """Whether the response is only the problem again, apart from form or a short label in front."""
    asked = words(problem or "")
    text = _content(response)
    head, colon, rest = text.partition(":")
    if colon and len(head) <= 40 and " ".join(words(head)) in LABELS:
        text = rest
    said = words(text)
    if not asked or not said or len(said) < min(3, len(asked)):
        return False
    known = set(asked)
    if sum(w in known for w in said) < COPIED * len(said):
        return False  # fewer words than that can't be covered
    if sum(SuffixAutomaton(asked).covered(said, min(LEAST_MATCH, len(said)))) < COPIED * len(said):
        return False
    return len(said) >= 0.4 * len(asked) or len(said) >= 12


@lru_cache(maxsize=1)
def _phrases():
    """Automaton of all phrases; the value of one is its kind, and the languages of a part."""
    import ahocorasick

    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("refusal", [*REFUSALS, *DECLINING]), ("courtesy", COURTESY)):
        for p in phrases:
            kinds.setdefault(p, []).append((kind, ""))
    for kind, parts in (("unwilling", UNWILLING), ("answering", ANSWERING)):
        for lang, listed in parts.items():
            for p in listed.split("|"):
                kinds.setdefault(p, []).append((kind, lang))
    a = ahocorasick.Automaton()
    for p, values in kinds.items():
        a.add_word(p, (len(p), values))
    a.make_automaton()
    return a


def _found(sentence: str) -> set[str]:
    """Kinds of phrases in a sentence; a composed refusal has an act of answering after the unwillingness, no figure and, in English, a first person."""
    out: set[str] = set()
    unwilling: dict[str, int] = {}
    for end, (length, values) in _phrases().iter(sentence):
        for kind, lang in values:
            if not lang:
                out.add(kind)
                continue
            start = end - length + 1
            if sentence[start - 1 : start].isalpha() and start:
                continue
            if kind == "unwilling":
                unwilling.setdefault(lang, start)
            elif unwilling.get(lang, start + 1) <= start and not _DIGIT.search(sentence) and (lang != "en" or _FIRST_PERSON.search(sentence)):
                out.add("refusal")
    return out


def is_refusal(response: str) -> bool:
    """Whether the response declines and holds nothing else but courtesy; a caution before an answer is none."""
    text = _content(response)
    if "refusal" not in _found(_quotes(text)):
        return False
    refused = False
    for sentence in _SENTENCE.split(text):
        found = _found(_quotes(sentence))
        if "refusal" in found:
            refused = True
        elif "courtesy" not in found and len(words(sentence)) > 2 and not (_POLITE.match(sentence) and not re.search(r"\d", sentence)):
            return False
    return refused


def _quotes(text: str) -> str:
    return " ".join(text.replace("’", "'").replace("，", ",").casefold().replace("ß", "ss").split())


@lru_cache(maxsize=1)
def _votes() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, listed in STOPWORDS.items():
        for w in listed.split():
            out.setdefault(w, []).append(lang)
    return out


@lru_cache(maxsize=1)
def _scripts() -> dict[str, re.Pattern[str]]:
    return {lang: re.compile(f"[{chars}]") for lang, chars in SCRIPTS.items()}


def language(text: str) -> str | None:
    """Language by script and by votes of function words; None where there are too few of them."""
    if not text.isascii():
        han, kana, cyrillic = len(_HAN.findall(text)), len(_KANA.findall(text)), len(_CYRILLIC.findall(text))
        latin = len(_LATIN.findall(text))
        if kana > 0.1 * (han + kana) and 3 * (han + kana) > latin and kana + han >= 4:
            return "ja"
        if han >= 4 and 3 * han > latin:
            return "zh"
        if cyrillic >= 4 and cyrillic > 0.4 * latin:
            return "ru"
        for lang, script in _scripts().items():
            if (n := len(script.findall(text))) >= 4 and n > 0.4 * latin:
                return lang
    score: dict[str, float] = {}
    for w in words(text):
        for lang in (langs := _votes().get(w, ())):
            score[lang] = score.get(lang, 0) + 1 / len(langs)
    if not score:
        return None
    ranked = sorted(score.items(), key=lambda x: -x[1])
    if ranked[0][1] < 2 or (len(ranked) > 1 and ranked[0][1] < 1.4 * ranked[1][1]):
        return None
    return ranked[0][0]


def wrong_language(problem: str | None, response: str) -> bool:
    """Whether the response is mostly in a language other than the problem's, which doesn't ask for it."""
    text = _content(response)
    asked, said = language(problem or ""), language(text)
    if asked is None or said is None or asked == said:
        return False
    requested = _quotes(problem or "")
    if _ASK.search(requested) and any(name in requested for name in LANGUAGE_NAMES.get(said, "").split()):
        return False
    # mostly: sentences in the problem's own language outweigh a foreign quotation
    own = other = 0
    for sentence in _SENTENCE.split(text):
        lang = language(sentence)
        own += len(sentence) * (lang == asked)
        other += len(sentence) * (lang not in (None, asked))
    return other > own


_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『", "）": "（", "】": "【"}


def _open_delimiters(text: str) -> list[str]:
    """Delimiters that are open at the end of the text; list numbers like ``a)`` close nothing."""
    stack: list[str] = []
    for c in text:
        if c in "([{“«「『（【":
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return stack


def is_truncated(response: str) -> bool:
    """Whether the response breaks off: an open fence, tag, quotation or bracket, a torn table row, or a last line without an end."""
    text = _THINK.sub(" ", response).rstrip()
    if text.count("```") % 2:
        return True
    tags = _TAG.findall(text)
    if sum(not t.startswith("</") for t in tags if "answer" in t.lower()) > sum(t.startswith("</") for t in tags if "answer" in t.lower()):
        return True
    text = _TAG.sub("", text).rstrip()
    if not text:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    if text.endswith("```"):
        return False
    if last.startswith("|"):
        rows = [x.strip() for x in lines if x.strip().startswith("|")]
        cells = [x.count("|") for x in rows]
        return not last.endswith("|") or cells[-1] < max(cells) or re.fullmatch(r"[|\s:-]+", last) is not None
    if re.fullmatch(r"(?:[-*+•]|\d{1,3}[.)])(?:\s+\**)?", last) or re.search(r"(?<!\*)\*\*$", last) and last.count("**") % 2:
        return True
    tail = last[-1:] and last.split()[-1]
    if last.endswith("]") and _CITE_END.search(last, last.rindex("[") if "[" in last else 0) or _LINK_END.search(tail):
        return False
    n = len(words(last))
    if _HARD_OPEN.search(last, max(0, len(last) - _OPEN_CHARS)) and n > 3:
        return True
    if len(_open_delimiters(text)) and n > 3:
        return True
    if _END.search(last, len(last) - 1):
        return False
    if _LIST_LINE.match(lines[-1]) and len(lines) > 1 and n <= 8:
        return False
    return n >= 9 or (len(lines) > 1 or len(words(text)) >= 12) and not re.fullmatch(r"[^.:]{1,40}: [^.]{1,60}", last)


def defect(problem: str | None, response: str | None) -> str | None:
    """Type of defect of a pair, or None. The first that holds of: empty, copied, refusal, language, truncated.

    A NULL response is empty; with a NULL or empty problem nothing is copied and no language is wrong.
    """
    if is_empty(response):
        return "empty"
    if is_copied(problem, response):
        return "copied"
    if is_refusal(response):
        return "refusal"
    if wrong_language(problem, response):
        return "language"
    return "truncated" if is_truncated(response) else None


def defective_pairs(df: DataFrame, id_col: str = "output_id", problem_col: str = "problem", response_col: str = "final_response") -> DataFrame:
    """(item_id, defect): one row for each defective pair, with exactly one type of defect.

    See :func:`defect` for nulls and order. Rows that stand twice come out twice, an empty table gives no rows; whole
    texts are read. Nothing is shuffled, and other columns are never read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array(list(map(defect, batch.column(1).to_pylist(), batch.column(2).to_pylist())), pa.string())
            keep = kinds.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), kinds.filter(keep)], names=["item_id", "defect"])

    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(problem_col).cast("string").alias("p"), F.col(response_col).cast("string").alias("r"))
    return rows.mapInArrow(scan, "item_id bigint, defect string")
