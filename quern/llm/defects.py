"""Broken prompt and response pairs.

Ordered rules look at each pair on its own: emptiness, copied questions, refusal phrases of several
languages, unclosed delimiters and abrupt endings, and the language of the answer against the one
that the question asks for. `pair_defects` gives every rule that fires, in that order; the first one
is the pair's defect. Nothing is shuffled but defective rows: a pair is judged where it is read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

EMPTY, REFUSAL, COPY, TRUNCATED, LANGUAGE = "empty", "refusal", "copy", "truncated", "language"

# --- emptiness ---------------------------------------------------------------------------------

# Words that stand for a missing answer.
PLACEHOLDERS = {
    "n/a", "na", "nan", "none", "null", "nil", "todo", "tbd", "tba", "fixme", "xxx", "undefined", "missing", "empty", "blank", "placeholder", "no answer", "no response", "no reply", "no output",
    "answer missing", "missing answer", "response missing", "missing response", "not available", "not applicable", "to do", "to be done", "to be added", "to be filled in", "to be written", "answer here",
    "your answer here", "insert answer here", "answer goes here", "answer pending", "pending", "empty response", "empty answer", "answer", "response", "text here", "lorem ipsum",
    "keine antwort", "antwort fehlt", "keine angabe", "k. a.", "k.a.", "entfällt", "fehlt", "leer", "pas de réponse", "réponse manquante", "aucune réponse", "sans réponse", "néant", "vide", "à compléter", "à faire",
    "sin respuesta", "respuesta pendiente", "falta la respuesta", "respuesta vacía", "ninguna", "vacío", "por hacer", "pendiente", "нет ответа", "ответ отсутствует", "без ответа", "нет данных", "н/д", "пусто", "нет",
}
_MOST_WORDS = max(len(p.split()) for p in PLACEHOLDERS)
_MARKS = set("-_.,;:|/\\#*~^`'\"·•…—–−?!¿¡")
#: Marks that can be the answer to a question for a sign.
_SIGNS = set(",;|:-/.#")
_BRACKETS = "[](){}<>«»\"'“”„`*_ \t\n.!…:-"
#: Questions that may well be answered by a bare sign or word.
_ASKS_SIGN = re.compile(r"\b(delimiter|separator|sign|character|symbol|literal|punctuation|quote|trennzeichen|zeichen|séparateur|caractère|signe|separador|carácter|signo|разделител\w+|символ\w*|знак\w*)\b", re.I)
_ASKS_LITERAL = re.compile(r"\bliteral\b|\bjson\s+value\b", re.I)
_ASKS_COLLECTION = re.compile(r"\bempty (?:list|object|array|string|dict\w*)\b", re.I)


_BREAKS = {9: None, 10: None, 13: None}


def visible(text: str | None) -> str:
    """The text without what cannot be seen, trimmed."""
    if not text:
        return ""
    if text.isascii() and text.isprintable():
        return text.strip()
    # a text without control and format characters, line breaks aside, needs no look at each character
    if not text.translate(_BREAKS).isprintable():
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Zl", "Zp") or c in "\t\n\r")
    return text.strip()


def is_empty(question: str, answer: str) -> bool:
    """No answer at all or a mere placeholder. `answer` is trimmed."""
    if not answer:
        return True
    if all(c in _MARKS or c.isspace() for c in answer):
        # "..." and "_" say nothing; "-" or "|" may be the sign that was asked for
        return not (_ASKS_SIGN.search(question) and answer in _SIGNS)
    if re.fullmatch(r"[\[\](){}<>\s\"'“”«»]+", answer):
        return not _ASKS_COLLECTION.search(question)
    words = answer.strip(_BRACKETS).replace("_", " ").split(None, _MOST_WORDS)
    if len(words) > _MOST_WORDS:
        return False  # more words than any placeholder has
    bare = " ".join(words).casefold()
    if bare not in PLACEHOLDERS:
        return False
    # the literal itself is an answer where a literal is asked for, but only as it is spelled
    return not (_ASKS_LITERAL.search(question) and answer.strip("`'\" .") == "null")


# --- refusal -----------------------------------------------------------------------------------

# Openings and cores of refusals, by language. A core speaks of the one who answers
# and of the request itself; that some user or file "cannot" do something is no refusal.
_EN_CANNOT = r"(?:i|we)\s+(?:can(?:'t|not|\s+not)|am\s+(?:unable|not\s+able|not\s+allowed|not\s+permitted|not\s+in\s+a\s+position)\s+to|are\s+(?:unable|not\s+able)\s+to|(?:will|would|could|may|must|should)\s+not|won't|wouldn't|(?:do\s+not|don't)\s+feel\s+comfortable|(?:must|have\s+to|need\s+to)\s+(?:refuse|decline|pass)|(?:decline|refuse)\s+to|(?:'d|would)\s+rather\s+not|prefer\s+not\s+to)"
_EN_ACT = r"(?:help|assist|answer|answering|respond|responding|reply|fulfil|fulfill|comply|complete|provide|give|giving|be\s+giving|support|engage|take\s+part|discuss|talk|share|offer|process|handle|do|carry\s+out|be\s+of\s+(?:help|assistance)|participate|continue|address|satisfy)"
_EN_CORE = [
    rf"{_EN_CANNOT}(?:\s+\w+){{0,2}}\s+{_EN_ACT}\b",
    r"\bi(?:'m|\s+am)\s+(?:unable|not\s+able|not\s+allowed|not\s+permitted)\b",
    r"\bi(?:\s+(?:must|have\s+to|need\s+to|am\s+going\s+to|will))\s+(?:respectfully\s+|politely\s+)?(?:refuse|decline|pass)\b",
    r"\b(?:this|that|it)\s+is\s+(?:something|a\s+request|a\s+question)\s+(?:that\s+)?i\s+(?:must|have\s+to|need\s+to)\s+(?:decline|refuse|pass)",
    r"\bpass\s+on\s+(?:this|that)\s+(?:request|question|one)\b",
    r"\bi(?:'d|\s+would)\s+rather\s+not\b",
    r"\bi\s+(?:do\s+not|don't)\s+feel\s+comfortable\b",
    r"\bi\s+prefer\s+not\s+to\b",
    r"\bno\s+answer\s+can\s+be\s+(?:offered|given|provided)\b",
    r"\bnot\s+be\s+(?:right|appropriate|proper|responsible)\s+for\s+me\s+to\b",
    r"\bfalls\s+outside\s+(?:of\s+)?what\s+i\b",
    r"\b(?:goes\s+)?against\s+my\s+(?:guidelines|rules|policy|policies|principles)\b",
    r"\brequest\s+(?:is\s+|was\s+|has\s+been\s+)?(?:declined|denied|refused|rejected)\b",
    r"\bi\s+won't\s+be\s+\w+ing\b",
    r"\bas\s+an?\s+(?:ai|language\s+model|assistant|ai\s+language\s+model|ai\s+model)\b",
    r"\bi\s+(?:must|have\s+to)\s+refuse\b",
    r"\bi\s+refuse\s+to\b",
    r"\bi\s+decline\b",
    r"\bi(?:'m|\s+am)\s+(?:sorry|afraid),?\s+(?:but\s+)?(?:i|that|this|no)\b",
    r"\bi\s+(?:don't|do\s+not)\s+(?:discuss|provide|answer|offer|share|write|produce|create|help|assist|engage|respond|comment|talk\s+about|give\s+(?:out|advice|opinions|such))\b",
    r"(?:\b(?:is|are)(?:n't|\s+not)|'s\s+not)\s+(?:an?\s+(?:\w+\s+)?(?:topic|subject|matter|question|request|thing)|something|anything)\s+(?:that\s+|which\s+)?i(?:'m|'ll|'d)?\s+(?:\w+\s+){0,3}?(?:discuss|write|answer|address|provide|share|do|help|talk|comment|cover|say|touch|handle)\b",
    r"\b(?:answering|responding|replying|helping|complying|writing|doing|saying|providing)\b[^.!?]{0,40}\bwould\s+(?:break|violate|breach|contradict|go\s+against|be\s+against|conflict\s+with|(?:require|force)\s+me\s+to)\b",
    r"\b(?:breaks?|violates?|would\s+(?:break|violate))\s+my\s+\w+",
]
_GERMAN = [
    r"\b(?:kann|darf|werde|möchte|will)\s+ich\b[^.!?]{0,40}\b(?:nicht|keine?n?)\b[^.!?]{0,40}\b(?:helfen|beantworten|antworten|geben|weiterhelfen|erfüllen|äußern|unterstützen|dienen|nachkommen|entsprechen|bearbeiten|ausführen)",
    r"\bich\s+(?:kann|darf|werde|möchte|will|bin)\b[^.!?]{0,50}\b(?:nicht|keine?n?|außerstande)\b[^.!?]{0,40}\b(?:helfen|beantworten|antworten|geben|weiterhelfen|erfüllen|äußern|unterstützen|dienen|nachkommen|entsprechen|bearbeiten|ausführen|lage|befugt|berechtigt)",
    r"\b(?:ich|muss|möchte)\b[^.!?]{0,50}\b(?:ablehnen|verweigern|passen)\b|\blehne\s+ich\b[^.!?]{0,30}\bab\b|\bich\s+lehne\b[^.!?]{0,40}\bab\b",
    r"\b(?:dabei|damit|hierbei|dazu)\s+kann\s+ich\b[^.!?]{0,20}\bnicht\b",
    r"\bals\s+(?:ki|sprachmodell|ki-modell|künstliche\s+intelligenz)\b",
    r"\banfrage\s+(?:wurde\s+)?abgelehnt\b|\bverstößt\s+gegen\s+meine\b|\bnicht\s+befugt\b|\bsteht\s+mir\s+nicht\s+zu\b",
    r"\b(?:darüber|davon|hierüber|dazu|solche\s+\w+)\s+(?:spreche|rede|schreibe|gebe|erteile|äußere|sage)\s+ich\b[^.!?]{0,20}\b(?:nicht|nichts)\b|\bgegen\s+meine\s+(?:regeln|vorgaben|richtlinien|grundsätze)\b",
]
_FRENCH = [
    r"\bje\s+(?:n'aborde|ne\s+(?:discute|fournis|traite|donne|commente|parle))\s+pas\b|\b(?:contre|enfreindrait|violerait)\s+(?:à\s+)?mes\s+(?:règles|consignes|principes)\b",
    r"\bje\s+(?:ne\s+(?:peux|puis|saurais|suis|souhaite|veux|vais)|n'ai|me\s+vois|refuse|décline|préfère\s+ne|regrette)\b[^.!?]{0,60}\b(?:pas|répondre|aider|demande|droit|mesure|décliner|refuser|donner|en\s+mesure|autorisée?|suite)",
    r"\bje\s+(?:dois|suis\s+obligée?\s+de|suis\s+contrainte?\s+de)\s+(?:\w+\s+)?(?:décliner|refuser)\b",
    r"\bil\s+m'est\s+impossible\b|\bil\s+ne\s+m'est\s+pas\s+possible\b|\bm'est\s+pas\s+permis\b",
    r"\ben\s+tant\s+qu(?:e\s+modèle|'ia|'intelligence|'assistant|e\s+modèle\s+de\s+langage)\b|\bdemande\s+(?:refusée|rejetée|déclinée)\b|\bcontraire\s+à\s+mes\b",
]
_SPANISH = [
    r"\bno\s+(?:puedo|podré|podría|voy\s+a|debo|me\s+es\s+posible|estoy\s+(?:en\s+condiciones|autorizad[oa])|quiero|deseo|tengo\s+permitido|me\s+está\s+permitido|me\s+siento)\b[^.!?]{0,50}\b(?:ayudar\w*|responder\w*|contestar\w*|atender\w*|dar\w*|cumplir\w*|ofrecer\w*|proporcionar\w*|colaborar|participar|petición|solicitud|pregunta|eso|esto|ello|cómod[oa])",
    r"\b(?:debo|tengo\s+que|he\s+de|me\s+veo\s+obligad[oa]\s+a)\s+(?:rechazar|declinar|negarme|denegar)\b|\b(?:rechazo|declino)\s+(?:esta|esa|la)\b|\bme\s+niego\b",
    r"\bcomo\s+(?:modelo\s+de\s+lenguaje|ia|inteligencia\s+artificial)\b|\b(?:solicitud|petición)\s+(?:rechazada|denegada)\b|\bva\s+en\s+contra\s+de\s+mis\b",
    r"\bno\s+(?:hablo\s+de|trato|proporciono|ofrezco|comento|discuto|doy)\s+(?:ese|este|esos|estos|esa|esta|ese\s+tipo|es[oa]|tal\w*)\b|\b(?:contra|infringiría|incumpliría|violaría)\s+(?:de\s+)?mis\s+(?:normas|reglas|principios)\b",
]
_RUSSIAN = [
    r"\bя\s+не\s+(?:обсуждаю|предоставляю|даю|комментирую|отвечаю|пишу)\b|\bнаруш\w+\s+мои\b",
    r"\bя\s+(?:не\s+(?:могу|вправе|буду|смогу|имею\s+права|готова?|в\s+состоянии|должен|уполномочен\w*)|вынужден\w*|отказываюсь|предпоч\w+\s+не|откажусь)",
    r"\b(?:вынужден\w*|приходится|придётся|придется|должен|должна)\s+(?:\w+\s+)?(?:отказа\w+|отклон\w+)|\bне\s+могу\s+(?:с\s+этим\s+)?(?:помочь|ответить|выполнить|дать|помогать|отвечать)|\bне\s+вправе\b|\bне\s+имею\s+права\b",
    r"\b(?:запрос|просьба)\s+отклон\w+|\bкак\s+(?:языковая\s+модель|искусственный\s+интеллект)\b|\bпротиворечит\s+моим\b",
]
# Words of which one at least is in every phrase of a language's cores; a text without any is not searched for them.
_GATES = {
    "en": (_EN_CORE, "i we my me request pass offered given provided ai model assistant break breaks violate violates breach contradict against conflict"),
    "de": (_GERMAN, "ich muss möchte mir meine anfrage verstößt befugt sprachmodell ki intelligenz modell"),
    "fr": (_FRENCH, "je m mes tant demande contraire contre"),
    "es": (_SPANISH, "puedo podré podría voy debo me estoy quiero deseo tengo he rechazo declino niego como solicitud petición contra hablo trato proporciono ofrezco comento discuto doy mis"),
    "ru": (_RUSSIAN, "я не запрос просьба как противоречит мои моим вынужден вынуждена вынуждено вынуждены приходится придётся придется должен должна"),
}
_SEARCHES = [(frozenset(words.split()), re.compile("|".join(f"(?:{p})" for p in cores), re.I)) for cores, words in _GATES.values()]
_WORD = re.compile(r"[^\W\d_]+")


def _declining(text: str) -> bool:
    """Some phrase of refusal is in the text."""
    words = set(_WORD.findall(text.casefold()))
    return any(not gate.isdisjoint(words) and search.search(text) is not None for gate, search in _SEARCHES)


_SORRY = re.compile(
    r"^(?:\W*)(?:(?:i'?m|i\s+am)\s+(?:very\s+|so\s+|really\s+)?(?:sorry|afraid)|sorry|my\s+apologies|(?:i|we)\s+apologi[sz]e|unfortunately|i\s+regret|regrettably|apologies|having\s+(?:read|considered|reviewed)\b|thanks?\s+(?:you\s+)?for|thank\s+you\s+for|leider|es\s+tut\s+mir\s+leid|tut\s+mir\s+leid|entschuldig|bedaure|ich\s+bedau|verzeih|je\s+suis\s+désolé|désolé|malheureusement|je\s+regrette|toutes\s+mes\s+excuses|mes\s+excuses|pardon|lo\s+siento|lo\s+lamento|lamento|lamentablemente|por\s+desgracia|desafortunadamente|perdón|disculp|mis\s+disculpas|извините|простите|прошу\s+прощения|к\s+сожалению|сожалею|мне\s+жаль)",
    re.I,
)
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|```.*?```|`[^`]*`", re.S)
#: Requests whose answer may itself be a refusal or quote one.
_ASKS_REFUSAL = re.compile(r"\b(turns?\s+down|turning\s+down|declin(?:e|es|ing)|refus(?:e|es|al|ing)|polite\s+note|apolog\w+|absage\w*|ablehn\w+|höflich\w*|rechaz(?:a|ar|o)|откажи|отказ\w*)\b", re.I)
#: Such a request asks for words to be put down; one that only speaks of a refusal ("why does it refuse") does not.
_ASKS_WORDS = re.compile(r"\b(write|draft|compose|formulate|phrase|word|reword|rewrite|rephrase|translate|quote|repeat|say|schreib\w*|verfass\w*|formulier\w*|übersetz\w*|sag\w*|écri\w+|rédig\w+|formul\w+|tradui\w+|escrib\w+|redact\w+|traduc\w+|напиш\w*|состав\w*|сформулир\w*|перевед\w*)\b|\bpolite\s+note\b", re.I)
#: Courtesies around a refusal: sentences that neither answer nor decline (fixed values, by their first words).
_COURTESY = re.compile(
    r"^\W*(?:i\s+(?:understand|see|hope|appreciate)|thanks?\b|thank\s+you|feel\s+free|please|is\s+there\s+anything|let\s+me\s+know|can\s+i|may\s+i|perhaps|maybe|no\b\W*$|bitte|danke|ich\s+(?:verstehe|hoffe)|kann\s+ich\s+sonst|fragen\s+sie|wenden\s+sie|merci|veuillez|n'hésitez|je\s+(?:comprends|vous\s+invite)|puis-je|gracias|por\s+favor|no\s+dude|entiendo|comprendo|¿?puedo\s+ayudar|consulte|пожалуйста|спасибо|обратитесь|понимаю|надеюсь|могу\s+ли)",
    re.I,
)
#: Least shares of sentences that decline: of an answer that opens with it, and of any other.
_OPENING_SHARE, _ANY_SHARE = 1 / 5, 1 / 2


def is_refusal(question: str, answer: str) -> bool:
    """The answer declines to answer. What it quotes, and what was asked for as a refusal, does not count."""
    if _ASKS_REFUSAL.search(question) and _ASKS_WORDS.search(question):
        return False
    said = _QUOTED.sub(" ", answer.replace("’", "'")).strip()
    if not _declining(said):
        return False
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", said) if s]
    declines = [s for s in sentences if _declining(s)]
    told = [s for s in sentences if s in declines or not _COURTESY.search(s)] or sentences
    # what runs over a break between sentences counts as one that declines
    share = max(1, len(declines)) / len(told)
    opens = _SORRY.search(said) or _declining(told[0])
    return share >= (_OPENING_SHARE if opens else _ANY_SHARE)


# --- copy --------------------------------------------------------------------------------------

_ASKS_COPY = re.compile(r"\b(repeat|correct\s+the\s+spelling|copy|echo|quote|lower\s*case|upper\s*case|without\s+any\s+change|verbatim|proofread|wiederhol\w+|korrigier\w+|répèt\w+|répét\w+|corrig\w+|repit\w+|corrij\w+|повтори\w*|исправь\w*)\b", re.I)
#: The question itself is what shall be given back.
_ASKS_ITSELF = re.compile(r"\b(?:repeat|echo|copy|quote)\s+(?:back\s+)?(?:this|my|the)\s+(?:very\s+)?(?:question|prompt|request|instruction|message|sentence|line)\b(?![^\n]*:)", re.I)
_EDGES = re.compile(r"^\W+|\W+$")


def _does_copy(question: str, answer: str) -> bool:
    """The question asks for a text back and the answer gives that: the request itself, or a word of it, is left out."""
    asked, said = (Counter(" ".join(m.casefold().split()) for m in _ASKS_COPY.findall(t)) for t in (question, answer))
    return any(said[w] < n for w, n in asked.items()) or _ASKS_ITSELF.search(question) is not None


def _plain(text: str) -> list[str]:
    """Words between white space, without marks around them; a path or a hyphened name is one word."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    words = (w if w[0].isalnum() and w[-1].isalnum() else _EDGES.sub("", w) for w in text.casefold().split())
    return [w for w in words if w]


def _without(words: list[str], part: list[str]) -> list[str]:
    """`words` without `part` at its start or end."""
    n = len(part)
    if n and words[:n] == part:
        return words[n:]
    if n and words[-n:] == part:
        return words[:-n]
    return words


def is_copy(question: str, answer: str, context: str = "") -> bool:
    """The answer only gives back the question, with or without its context, perhaps slightly altered (quoted, re-spaced, repeated, a word added, dropped or exchanged)."""
    if _does_copy(question, answer):
        return False
    q, a = _plain(question), _plain(answer)
    if not q or not a:
        return False
    if context:
        a = _without(a, _plain(context)) or a
    if len(q) < 3:
        return len("".join(q)) >= 8 and "".join(a) == "".join(q)
    if _gives_back(q, a):
        return True
    # something said before, but then only the question again
    last = answer.rstrip().rpartition("\n")
    return bool(last[0]) and _gives_back(q, _plain(last[2]))


def _gives_back(q: list[str], a: list[str]) -> bool:
    if not a:
        return False
    if len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
        return True  # once or several times over
    if len(a) > 1.5 * len(q) + 6 or len(a) < 0.6 * len(q):
        return False
    # shared words bound what any alignment can match
    shared = sum((Counter(q) & Counter(a)).values())
    if 2 * shared < _ALIKE * (len(q) + len(a)):
        return False
    return 2 * _aligned(q, a) >= _ALIKE * (len(q) + len(a))


#: Share of words that an altered copy has in common with the question, in order.
_ALIKE = 0.8


def _aligned(q: list[str], a: list[str]) -> int:
    """Words that both hold in the same order (longest common subsequence), exact at any length.

    One bit a word of `q` in whole numbers: adding carries a match on to the next free place, so a word
    of `a` costs a few additions instead of one comparison a word of `q`. Memory stays within what the
    words of _BLOCK places take: blocks follow each other, with the carries of each word of `a` between them.
    """
    n, m = len(q), len(a)
    start = 0
    while start < n and start < m and q[start] == a[start]:
        start += 1
    end = 0
    while end < n - start and end < m - start and q[n - 1 - end] == a[m - 1 - end]:
        end += 1
    q, a = q[start : n - end], a[start : m - end]
    both = set(q) & set(a)
    q, a = [w for w in q if w in both], [w for w in a if w in both]
    found, carries = start + end, bytearray(len(a))
    for at in range(0, len(q), _BLOCK):
        block = q[at : at + _BLOCK]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(block):
            places.setdefault(w, []).append(i)
        masks = {w: _bits(ps) for w, ps in places.items()}
        width = len(block)
        full = (1 << width) - 1
        free = full
        for j, w in enumerate(a):
            hit = free & masks.get(w, 0)
            carry = carries[j]
            if hit or carry:
                total = free + hit + carry
                carries[j] = total >> width
                free = (total | (free - hit)) & full
        found += width - free.bit_count()
    return found


#: Words of the question that are aligned in one block; bounds memory, not the result.
_BLOCK = 1 << 14


def _bits(places: list[int]) -> int:
    """The number with these bits set, `places` ascending."""
    if len(places) == 1:
        return 1 << places[0]
    out = bytearray(places[-1] // 8 + 1)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(out, "little")


# --- truncation --------------------------------------------------------------------------------

_CUT = re.compile(r"(?:…|\.\.\.)\s*(?:[\[(<{]?\s*(?:max(?:imum)?\s*(?:length|tokens?|len)|cut(?:\s*off)?|truncated|continued|length|token\s*limit|gekürzt|abgeschnitten|tronqué|coupé|cortado|truncado|обрезано|limit\w*|more|snip)\s*[\])>}]?)\s*$|[\[(<{]\s*(?:max(?:imum)?\s*(?:length|tokens?)|cut(?:\s*off)?|truncated|token\s*limit|output\s+truncated|snip)[^\])>}]{0,20}[\])>}]\s*$", re.I)
#: A list number without its item, or an abbreviation that announces something.
_DANGLING = re.compile(r"\n\s*(?:\d+[.)]|[-*•])\s*\Z|(?:^|\s)(?:e\.\s?g|i\.\s?e|z\.\s?b|d\.\s?h|p\.\s?ej|p\.\s?ex|par\s+ex|c\.-à-d|por\s+ej|т\.\s?е|т\.\s?к|напр|vgl|cf|viz|bzw)\.\Z", re.I)
_ENDED = set(".!?。！？…»”\")]}`'*:;؟।>")
_LIST = re.compile(r"(?:^|\n)\s*(?:[-*•+]|\d+[.)])\s+\S[^\n]*\Z")
_CODE = re.compile(r"^\s*(?:[$>]\s|[\w.]+\s*=|for\s+\w+\s+in\b|print\b|import\s+\w|select\b.*\bfrom\b|[a-z][\w-]*(?:\s+-{1,2}\w[\w-]*|\s+[\w.@{}-]*[/.=_-][\w./@{}=-]*)+(?:\s*[|&>]\s*\S.*)?$)", re.I)
#: Words that cannot end a sentence, by language (fixed values).
_OPEN_WORDS = set(
    """the a an of to and or but in on at for with from by that which because is are was were be as if when than whereas so its this these those not into between about only
    der die das des dem den ein eine einer einen eines und oder aber weil dass ob für mit von zu zum zur im am auf aus bei nach nicht ist sind wird werden wurde als wenn damit
    le la les un une des du de et ou mais parce que qui dont pour avec sans sur dans en au aux est sont a ont ne pas si quand afin
    el los las unos unas del y o pero porque que para con sin por en al es son ha han no si cuando aunque
    и или но а что как для с со в во на по из от до при не если когда чтобы потому который которая которые это о об к""".split()
)


def _unclosed(text: str) -> bool:
    """Some delimiter is opened and never closed."""
    if text.count("```") % 2:
        return True
    # code may hold lone quotes of its own; what counts there is its fence
    outside = re.sub(r"```.*?```", " ", text, flags=re.S)
    if outside.count("`") % 2:
        return True
    depth: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    quoted = re.sub(r"\"[^\"\n]*\"", '""', outside)
    lone = quoted.replace('""', "")
    if lone.count('"') % 2:
        return True
    for c in _BRACKET.findall(_INTERVAL.sub(" ", lone)):
        if c in "([{":
            depth.append(c)
        elif depth and depth[-1] == pairs[c]:
            depth.pop()
    if depth:
        return True
    if "«" in outside and outside.count("«") > outside.count("»"):
        return True
    return _open_quotes(outside)


_BRACKET = re.compile(r"[()\[\]{}]")
#: A half-open interval: two bounds between brackets of two kinds.
_INTERVAL = re.compile(r"[\[(]\s*[^\[\](){},;\n]{1,40}\s*[,;]\s*[^\[\](){},;\n]{1,40}\s*[\])]")


def _open_quotes(text: str) -> bool:
    """Some curly quote is opened and never closed. “ closes what „ opened and opens otherwise; ” closes either, and alone it closes nothing."""
    if "“" not in text and "„" not in text:
        return False
    depth: list[str] = []
    for c in re.findall("[“”„]", text):
        if c == "„":
            depth.append(c)
        elif c == "“":
            if depth and depth[-1] == "„":
                depth.pop()
            else:
                depth.append(c)
        elif depth:
            depth.pop()
    return bool(depth)


# Numbers as they announce a list.
_NUMBERS = {
    w: n
    for n, ws in enumerate(("two zwei deux dos два две", "three drei trois tres три", "four vier quatre cuatro четыре", "five fünf cinq cinco пять", "six sechs six seis шесть", "seven sieben sept siete семь", "eight acht huit ocho восемь", "nine neun neuf nueve девять", "ten zehn dix diez десять"), 2)
    for w in ws.split()
}
_ANNOUNCED = re.compile(rf"(?<![\w.])(\d{{1,2}}|{'|'.join(_NUMBERS)})\s+[^\W\d][^.!?:\n]{{0,40}}:\s*\n(?=\s*(?:[-*•+]|\d+[.)])\s)", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-*•+]|\d+[.)])[ \t]+\S", re.M)


def _short_list(text: str) -> bool:
    """A list that ends the text has fewer items than the line before it announces."""
    if ":" not in text or "\n" not in text:
        return False
    m = None
    for m in _ANNOUNCED.finditer(text):
        pass
    if m is None:
        return False
    lines = [x for x in text[m.end() :].split("\n") if x.strip()]
    items = sum(_ITEM.match(x) is not None for x in lines)
    n = _NUMBERS.get(m.group(1).lower()) or int(m.group(1))
    return items == len(lines) and items < n


def is_truncated(question: str, answer: str) -> bool:
    """The answer breaks off: an unclosed delimiter, a mark of cutting, or prose without an end."""
    text = answer.rstrip()
    if _CUT.search(text) or _unclosed(text) or _DANGLING.search(text) or _short_list(text):
        return True
    last = text[-1]
    if last in ",;:—–-" and any(c.isalpha() for c in text) and not _ASKS_SIGN.search(question):
        return True
    if text.endswith(("...", "…")):
        # a progress message may end in dots; prose that fades out is cut
        return len(text.split()) > 4
    if last in _ENDED:
        return False
    words = text.split()
    if words and words[-1].strip("\"'*_").casefold() in _OPEN_WORDS and len(words) > 2:
        return True
    if len(words) <= 4 or _LIST.search(text):
        return False
    if _JAPANESE.search(text):
        return True
    tail = text.rsplit("\n", 1)[-1]
    if _CODE.search(tail) and not re.search(r"[.!?]\s", tail):
        return False
    if re.fullmatch(r"[^.!?;:]{1,30}(?:(?:\s[/|]\s|,\s)[^.!?;:,/|]{1,30})+", text) and max(len(x.split()) for x in re.split(r"\s[/|]\s|,\s", text)) <= 2:
        return False  # a bare list of short items
    # five or six words may be a short reply if they end in a number; more need an end
    return not (len(words) <= 6 and words[-1][-1:].isdigit())


# --- language ----------------------------------------------------------------------------------

# Frequent small words that tell the languages of one script apart.
SMALL_WORDS = {
    "en": "a at all any each every more no one out such their them these those very where us were while your two about after again get gets give the of and to is are was were in that it for with as on be by this which from or an not have has you they we he she its when only may than into so then if but who how what why can do does there their my your after before while first also been will would should".split(),
    "de": "in an so will der die das und ist sind nicht ein eine einer einem einen des dem den mit von zu für auf im am wird werden wurde wurden sich als auch wenn oder aber weil dass wie was warum welche wer ich sie es noch nach bei aus über durch zum zur hat haben kann muss nur damit daraus wieder bis vor dieser diese dieses keine bedeutet welches welchen wann wo wofür wozu mein meine ihr ihre ihren sein seine mehr sehr alle beim zwei darf gibt gehören".split(),
    "fr": "le la les des du et est sont une un dans que qui pour avec sur pas ne au aux ce cette ces il elle ils elles je vous nous leur leurs son sa ses ont été être par plus ou mais parce quand comment pourquoi quelle quel quels afin se en dont sauf si avant après alors toutes tous chaque quels quelles quoi où donc mes mon ma une vers hors faut peut deux même très sous".split(),
    "es": "el los las una un del y es son en que para con por no se al lo su sus como más pero porque cuando qué cómo cuál este esta estos estas ha han fue fueron hay muy sin sobre entre ya también desde hasta solo puede pueden debe salvo la antes después todas todos cada según qué mi mis tu tus un uno dos dónde cuándo quién debo pasa entre e muy".split(),
}
_SPEAKS: dict[str, tuple[str, ...]] = {}
for _lang, _words in SMALL_WORDS.items():
    for _w in set(_words):
        _SPEAKS[_w] = (*_SPEAKS.get(_w, ()), _lang)
#: Letters that only some of these languages use.
_LETTERS = {"de": "äöüß", "fr": "àâçèêëîïôùûœ", "es": "ñ¿¡áíóú"}
# Names of the languages as questions use them.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischen anglais anglaise inglés ingles inglesa английский английском английски",
    "de": "german deutsch deutsche deutschen allemand allemande alemán alemana немецкий немецком немецки",
    "fr": "french französisch französische français française francés francesa французский французском французски",
    "es": "spanish spanisch spanische espagnol espagnole español española испанский испанском испански castellano",
    "ru": "russian russisch russische russe ruso rusa русский русском русски",
    "ja": "japanese japanisch japonais japonaise japonés japonesa японский японском японски",
}
_NAMED = {w: k for k, ws in LANGUAGE_NAMES.items() for w in ws.split()}
_JAPANESE = re.compile("[぀-ヿ一-鿿]")
_CYRILLIC, _LETTER = re.compile("[Ѐ-ӿ]"), re.compile(r"[^\W\d_]")
_NOISE = re.compile(r"```.*?```|`[^`]*`|https?://\S+|\S*[/\\]\S*|\b\w+(?:[-_.]\w+)+\b|\b\w*\d\w*\b", re.S)


def language(text: str) -> tuple[str | None, float]:
    """(language, margin): by script first, then by small words and special letters; None where nothing tells."""
    plain = _NOISE.sub(" ", text)
    if not plain.isascii():
        n = len(_LETTER.findall(plain))
        if len(_JAPANESE.findall(plain)) > 0.3 * n > 0:
            return "ja", 9.0
        if len(_CYRILLIC.findall(plain)) > 0.5 * n > 0:
            return "ru", 9.0
    low = plain.casefold()
    words = _WORD.findall(low)
    if not words:
        return None, 0.0
    score = dict.fromkeys(SMALL_WORDS, 0.0)
    for w in words:
        for k in _SPEAKS.get(w, ()):
            score[k] += 1.0
    if not low.isascii():
        for k, chars in _LETTERS.items():
            score[k] += min(3.0, 0.5 * sum(low.count(c) for c in chars))
    # letters that English never has speak against it, as long as they are no rarity
    best = sorted(score, key=lambda k: -score[k])
    margin = score[best[0]] - score[best[1]]
    return (best[0], margin) if score[best[0]] > 0 else (None, 0.0)


def wanted_language(question: str) -> str | None:
    """The language that the question asks for: one it names, or else its own. None where several are named or nothing tells."""
    named = {_NAMED[w] for w in _WORD.findall(question.casefold()) if w in _NAMED}
    if len(named) == 1:
        return named.pop()
    if named:
        return None
    got, margin = language(_QUOTED.sub(" ", question))
    return got if margin > 0 else None


def is_other_language(question: str, answer: str) -> bool:
    """The answer is a text in another language than the question asks for."""
    said = _QUOTED.sub(" ", answer)
    if len(_WORD.findall(_NOISE.sub(" ", said))) < 4 and _JAPANESE.search(said) is None:
        return False
    got, margin = language(said)
    want = wanted_language(question)
    if got is None or want is None or got == want:
        return False
    return margin >= 2.0


def judge(question: str | None, answer: str | None, context: str | None = None) -> list[str]:
    """Every defect of a pair, first the one that counts; a null question reads as empty, an empty answer has no other defect."""
    q, a = visible(question), visible(answer)
    if is_empty(q, a):
        return [EMPTY]
    fired = ((COPY, is_copy(q, a, visible(context))), (REFUSAL, is_refusal(q, a)), (TRUNCATED, is_truncated(q, a)), (LANGUAGE, is_other_language(q, a)))
    return [name for name, hit in fired if hit]


def pair_defects(pairs: DataFrame, key: str = "pair_id", question: str = "question", answer: str = "answer", context: str = "context") -> DataFrame:
    """`key` and `defects` (every triggered type, the deciding one first) of the defective pairs.

    A pair delivered twice in full counts once. A null answer is empty; a null question is an empty
    question (nothing is a copy of it, and it asks for no language); a null context is none. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(q, a, c) for q, a, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            keep = [i for i, g in enumerate(got) if g]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i] for i in keep], pa.list_(pa.string()))], [key, "defects"])

    # judged first, made distinct after: only the few defective rows are shuffled, without their texts
    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, question, answer, context).mapInArrow(run, f"`{key}` {kind}, defects array<string>").distinct()
