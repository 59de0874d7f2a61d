"""Broken prompt and response pairs: ordered rules that name every defect.

Rules, in the order in which a single defect is chosen; every one that holds is told
1. ``empty``: nothing is left once wrappers, labels and placeholders are off;
2. ``copied_question``: what is left is the question, once or several times;
3. ``refusal``: a sentence declines, by phrases of several languages;
4. ``other_language``: the answer's letters are of another script than the
   question's, or, within the Latin script, its function words are those of another
   language; where function words do not tell, character trigram profiles do, which
   are fitted on all questions of the table itself (``fit_profiles``);
5. ``truncated``: an open code fence, bracket, quotation or backtick, a list shorter
   than announced, a trailing conjunction or comma, or prose without an end.

Defined results
* a null answer is empty, and so is one without content, of which no other rule can
  tell anything; a null or empty question is compared with nothing, so only the
  rules on the answer alone can hold;
* a text whose language neither words nor profiles tell has none and no such defect;
* repeated rows give the same result each; extra columns are not touched; an empty
  table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")

_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,60}>")
_LABEL = re.compile(
    r"^(?:answer|a|q|question|note|assistant|you asked|response|reply|output|antwort|frage|réponse|question posée|respuesta|pregunta|回答|答|答案|问题|問題|質問|注)\s*[:：]\s*",
    re.I,
)
_PLACEHOLDER = frozenset(("n/a", "na", "null", "nil", "nan", "undefined", "tbd", "todo", "empty", "none given", "no answer", "unknown", "xxx"))
_WRAP = " \t\r\n*_>#`\"'“”‘’«»„()[]{}<>|~-–—•.…:：。、,;!?！？"


def core(text: str) -> str:
    """A text without invisible characters, tags, leading labels and enclosing marks."""
    s = _TAG.sub(" ", _INVISIBLE.sub("", text))
    while True:
        t = s.strip(" \t\r\n*_>#`\"'“”‘’«»„|~")
        t = _LABEL.sub("", t)
        if t == s:
            return t
        s = t


def is_empty(answer: str | None) -> bool:
    """Whether an answer is null, blank, a mere wrapper or a placeholder."""
    if answer is None:
        return True
    bare = core(answer).strip(_WRAP)
    if not any(c.isalnum() for c in bare):
        return True
    return bare.lower() in _PLACEHOLDER


def _letters(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def is_copy(question: str | None, answer: str) -> bool:
    """Whether an answer holds nothing but its question."""
    if not question:
        return False
    q, a = _letters(core(question)), _letters(core(answer))
    if not q or not a:
        return False
    rest = a.replace(q, "")
    return rest != a and (not rest or rest in ("youasked", "question", "q", "yourquestion", "theuserasked", "yourquestionwas"))


# Phrases by which an answer is declined
_REFUSAL = re.compile(
    "|".join((
        r"\b(?:can(?:no|')t|can not|cannot|could not|couldn't|am (?:unable|not able) to|won't|will not|must decline to|may not) (?:\w+ ){0,2}?(?:help|assist|answer|provide|give (?:any |you )?(?:details|advice|information)|share|discuss|comment|say (?:anything|more)|comply|disclose)\b(?! two| both)",
        r"\bmust decline\b", r"\b(?:i'd|i would) rather not\b", r"\boutside (?:of )?what i (?:may|can|am allowed)", r"\bnot be appropriate for me\b",
        r"\bno answer can be (?:provided|given)\b", r"\bnothing i am able to\b", r"\bnothing about .{1,60} was found in my (?:context|data)", r"\bmy instructions (?:keep|prevent|forbid)",
        r"\b(?:do not|don't) have (?:enough|sufficient|any) (?:information|context|data)\b", r"\bnot (?:allowed|permitted|authorized) to (?:answer|share|discuss|disclose)",
        r"\bkann ich (?:diese|ihre|deine|die|dazu|dir|ihnen|dabei|nicht)[^.]{0,40}nicht (?:beantworten|helfen|weiterhelfen)|\bkann ich nicht (?:beantworten|helfen)|\bich kann (?:diese|ihre|deine|dazu|dir|ihnen|dabei)[^.]{0,40}nicht|\bdarf ich (?:dazu|hierzu|darüber)?\s*kein|\bkeine auskunft\b|\bnicht in der lage,? (?:diese|ihnen|dir)",
        r"\bje ne (?:peux|puis) pas (?:vous |t')?(?:répondre|aider|donner|fournir)|\bje ne suis pas en mesure\b|\bil m'est impossible de (?:répondre|vous)|\bje dois décliner",
        r"\bno puedo (?:responder|ayudar|contestar|dar|proporcionar)|\bno me es posible\b|\bno estoy en condiciones|\bdebo declinar",
        r"無法回答|无法(?:回答|提供|帮助)|不能(?:提供|回答|透露)(?!两)|不便(?:回答|透露)|拒绝回答",
        r"お答えできません|お手伝いできません|回答できません|お答えすることはできません|ご提供できません|お役に立てません",
    )),
    re.I,
)

# The most usual function words of languages in the Latin script
FUNCTION_WORDS = {
    "en": "the of and to in is are was were be been has have had it its this that these those with for from by on at as not no or but which what who how why when where while because does do did can will would after before than then there they you we",
    "de": "der die das den dem des ein eine einen einem einer und oder aber ist sind war waren wird werden wurde hat haben hatte nicht kein keine von vom zu zum zur mit bei beim für auf aus nach über unter durch wie was wer warum wann wo welche welcher welches daher nur noch auch als dass sich im am es er sie wir ich",
    "fr": "le la les un une des du de et ou mais est sont était a ont avait ne pas que qui quoi dont où comment pourquoi quand quel quelle quels quelles dans sur sous par pour avec sans ce cette ces il elle ils elles nous vous je au aux plus donc après avant surtout deux",
    "es": "el la los las un una unos unas y o pero es son era está están ha han había no que quien cómo por qué cuándo dónde cuál cuáles en sobre bajo para con sin este esta estos estas del al se lo su sus más después antes sólo solo dos eso",
    "it": "il lo la i gli le un uno una e o ma è sono era ha hanno aveva non che chi come perché quando dove quale quali in su sotto per con senza questo questa questi queste del della dei degli delle al alla nel nella da dal si più dopo prima solo viene",
    "pt": "o a os as um uma uns umas e ou mas é são era está tem têm tinha não que quem como por quê quando onde qual quais em no na nos nas sobre para com sem este esta isto do da dos das ao à se mais depois antes só dois pelo pela",
    "nl": "de het een en of maar is zijn was waren wordt worden heeft hebben had niet geen van naar met bij voor op uit na over onder door hoe wat wie waarom wanneer waar welke dit dat deze die er ook als dan alleen slechts te om aan",
    "sv": "den det en ett och eller men är var har hade inte ingen av till med vid för på ut efter över under genom hur vad vem varför när där vilken detta dessa som också än bara att om från",
    "pl": "i lub ale jest są był była były ma mają nie żaden z do na w we od przez dla po nad pod jak co kto dlaczego kiedy gdzie który która które to ten ta te się oraz tylko także",
}
_VOTES: dict[str, list[tuple[str, int]]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _VOTES.setdefault(_w, []).append((_lang, 1))
# a word that only one of them has says twice as much
_VOTES = {w: [(langs[0][0], 2)] if len(langs) == 1 else langs for w, langs in _VOTES.items()}
# Letters that few of these languages have
LETTERS = {"de": "äöüß", "es": "ñ¿¡áíóú", "fr": "çàâèêëîïôûœù", "pt": "ãõç", "sv": "åäö", "pl": "ąćęłńśźż", "it": "àèìòù"}
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CODE = re.compile(r"`[^`\n]*`|(?<![A-Za-z0-9_])[A-Za-z0-9]*[_0-9][A-Za-z0-9_]*")
_PROSE = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-鿿]")
SCRIPTS = ("Latin", "Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Telugu", "Thai", "Lao", "Khmer", "Myanmar", "Georgian", "Armenian", "Ethiopic")
_SCRIPT = regex.compile("|".join(rf"(?P<{s}>\p{{Script={s}}}+)" for s in SCRIPTS))
# letters of one of these count as so many Latin ones: a word takes fewer of them
_DENSE = {"Han": 3, "Hiragana": 2, "Katakana": 2, "Hangul": 2}


def script(text: str) -> tuple[str | None, int]:
    """The script of most of a text's letters outside code, and how many; Japanese is Han with kana."""
    counts: Counter = Counter()
    for m in _SCRIPT.finditer(text):
        counts[m.lastgroup] += len(m.group())
    kana = counts.pop("Hiragana", 0) + counts.pop("Katakana", 0)
    if kana:
        counts["Japanese"] = kana + counts.pop("Han", 0)
    if not counts:
        return None, 0
    best = max(counts, key=lambda s: (counts[s] * _DENSE.get(s, 2 if s == "Japanese" else 1), s))
    return best, counts[best]


def votes(plain: str) -> dict[str, int]:
    """How much the function words and letters of a text speak for each language of the Latin script."""
    out = dict.fromkeys(FUNCTION_WORDS, 0)
    words = _PROSE.findall(plain.lower())
    for w in words:
        for lang, weight in _VOTES.get(w, ()):
            out[lang] += weight
    accented = [w for w in words if not w.isascii()]
    for lang, letters in LETTERS.items():
        out[lang] += sum(any(c in letters for c in w) for w in accented)
    if "¿" in plain or "¡" in plain:
        out["es"] += 3
    return out


def prose(text: str) -> str:
    """A text without code, fences and identifiers."""
    return _CODE.sub(" ", _FENCE.sub(" ", text)) if "`" in text or "_" in text or any(map(str.isdigit, text)) else text


# The smoothing of profiles, in trigrams, and the number of questions that it is weighed against; all are counted
SMOOTHING, SCALE = 20_000, 20_000
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿąćęłńśźżßœ"
_NO_LETTERS = re.compile(f"[^ {_LETTERS}]+")


def _trigrams(plain: str) -> list[str]:
    folded = f" {_NO_LETTERS.sub('', ' '.join(_PROSE.findall(plain.lower())))} "
    return [folded[i : i + 3] for i in range(len(folded) - 2)]


def told(plain: str) -> str | None:
    """The language of the Latin script that function words tell clearly enough to learn from, if any."""
    v = votes(plain)
    second, first = sorted(v.values())[-2:]
    return max(v, key=v.get) if first >= 4 and first >= 2 * second and script(plain)[0] == "Latin" else None


class Profiles:
    """Character trigrams of languages, with how likely each is; at most the cube of the alphabet a language.

    ``counts`` has how often each occurs in all of so many ``questions``.  The counts of larger
    tables are weighed as if of ``SCALE`` questions: else what an unseen trigram costs would grow with
    the table, until one in a name outweighed a sentence.  A rare language keeps its counts up to the weight of the smoothing.
    """

    def __init__(self, counts: dict[str, dict[str, int]], questions: int):
        self.model = {}
        for lang, c in counts.items():
            total = sum(c.values())
            if total >= 2_000:
                weight = min(1.0, max(SCALE / questions, SMOOTHING / total))
                mass = total * weight + SMOOTHING
                self.model[lang] = ({g: math.log((n * weight + 0.5) / mass) for g, n in c.items()}, math.log(0.5 / mass))

    def language(self, plain: str) -> tuple[str | None, float]:
        """The language most like a text, and by how much a trigram it leads the next."""
        grams = _trigrams(plain)
        if len(grams) < 12 or len(self.model) < 2:
            return None, 0.0
        scores = sorted(((sum(known.get(g, other) for g in grams) / len(grams), lang) for lang, (known, other) in self.model.items()), reverse=True)
        return scores[0][1], scores[0][0] - scores[1][0]


def fit_profiles(pairs: DataFrame) -> Profiles:
    """Profiles of the languages of all questions, each distinct one once: counted where they lie, only the sums come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {"": Counter()}  # how many questions are read stands under no language
        for batch in batches:
            counts[""][""] += batch.num_rows
            for question in batch.column("question").to_pylist():
                plain = prose(question)
                lang = told(plain)
                if lang:
                    counts.setdefault(lang, Counter()).update(_trigrams(plain))
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    questions = pairs.select("question").where("question is not null").distinct()
    sums = questions.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in sums.collect():
        counts.setdefault(lang, {})[gram] = n
    read = counts.pop("", {"": 0})[""]
    return Profiles(counts, read)


def is_foreign(question: str | None, answer: str, profiles: Profiles | None = None) -> bool:
    """Whether an answer's language is known, well supported and not the question's."""
    if not question:
        return False
    body = answer[len(question) :] if answer.startswith(question) else answer
    asked_plain, plain = prose(question), prose(body)
    (asked, asked_n), (got, n) = script(asked_plain), script(plain)
    if asked is None or got is None:
        return False
    if got != asked:
        if {got, asked} == {"Han", "Japanese"}:
            # Japanese may be written without kana for a few words, Chinese never has any
            return n >= 4 if got == "Han" else True
        return n >= (12 if got == "Latin" else 2) and asked_n >= 2
    if got != "Latin":
        return False
    a, b = votes(asked_plain), votes(plain)
    own, other = max(a, key=a.get), max(b, key=b.get)
    if a[own] >= 2 and other != own and b[other] >= 3 and b[other] >= b[own] + 2 and b[other] > a[other]:
        return True
    if profiles is None or a[own] >= 2 and b[own] > 0:
        return False
    # too few function words: the profiles have to tell, clearly so where the words say nothing at all
    asked_as, asked_lead = (own, 1.0) if a[own] >= 2 else profiles.language(asked_plain)
    got_as, lead = profiles.language(plain)
    if asked_as is None or got_as in (None, asked_as) or asked_lead < 0.5:
        return False
    return lead >= (0.1 if got_as == other and b[other] >= 2 else 0.8)


_TERMINAL = re.compile(r"[.!?。！？…؟।][\"'”’»)\]*_`]*\Z")
_ANNOUNCED = re.compile(r"(\d+)\s*(?:[^\W\d_]{1,14}|个[^\W\d_]{1,6})?[^\W\d_、，,.:：。\n]{0,12}\s*[:：]\s*([^:：\n。]*)\Z")
_SEPARATOR = re.compile(r"\s*(?:[,，、;；]|\s(?:and|und|et|y|e|o|or|oder|ou)\s)\s*")
_OPEN_END = re.compile(r"(?:[,，、;；:：(\[{–-]|\b(?:and|or|und|oder|et|ou|y|o|the|a|of|to|by|with|der|die|das|von|mit|le|la|les|de|du|el|los|las))\Z", re.I)
_ITEM = re.compile(r"[\w./\[\]:<>*-]+\Z")
_SHORT = frozenset(("yes", "no", "ja", "nein", "oui", "non", "sí", "si", "never", "none", "true", "false", "是", "否", "不是", "はい", "いいえ"))


_DIRECTIVE = re.compile(r"`(?=(?:define|undef|ifdef|ifndef|elsif|else|endif|include|timescale)\b)")
_LISTED = re.compile(r"(?m)^\s*[([]?\w{1,3}\)\s|[:;8]-?[()]")


def is_open(text: str) -> bool:
    """Whether a bracket, quotation mark or inline backtick outside fences is never closed."""
    plain = _DIRECTIVE.sub("", _FENCE.sub(" ", text))
    if plain.count("`") % 2:
        return True
    plain = re.sub(r"`[^`]*`", " ", plain)
    if plain.count('"') % 2 and not re.search(r"\d\"", plain):
        return True
    if plain.count("«") > plain.count("»") and "»" not in plain or re.search(r"[“„][^”“]*\Z", plain) and not re.search(r"„[^“”]*[“”][^“”„]*\Z", plain):
        return True
    # half-open intervals close with the other kind, so any closing bracket ends the last open one
    depth = 0
    for c in _LISTED.sub(" ", plain):
        depth = depth + 1 if c in "([{（［【「『" else max(0, depth - 1) if c in ")]}）］】」』" else depth
    return depth > 0


def is_truncated(question: str | None, answer: str) -> bool:
    """Whether an answer stops before its end."""
    if answer.count("```") % 2 or is_open(answer):
        return True
    text = _INVISIBLE.sub("", answer).strip()
    if question and text.startswith(question.strip()):
        text = text[len(question.strip()) :].strip() or text
    if text.endswith("```"):
        return False
    bare = text.strip("*_>`\"'“”‘’«» \t\r\n")
    if not bare:
        return False
    closed = bool(_TERMINAL.search(text))
    last = re.split(r"(?<=[.!?。！？])\s+|\n+", bare)[-1]
    listed = _ANNOUNCED.search(last.rstrip(".。 "))
    if listed:
        items = [x for x in _SEPARATOR.split(listed.group(2).strip()) if x]
        return len(items) < int(listed.group(1)) or (not closed and bool(_OPEN_END.search(bare)))
    if closed:
        return False
    if _OPEN_END.search(bare):
        return True
    cjk = bool(_HAN.search(last) or _KANA.search(last))
    if bare.lower() in _SHORT:
        return False
    if last != bare:  # sentences before it, and it has no end
        return True
    if cjk:
        return not all(_ITEM.match(x) for x in _SEPARATOR.split(last) if not (_HAN.search(x) or _KANA.search(x))) or len(last) > 6
    words = last.split()
    items = [x for x in _SEPARATOR.split(last) if x]
    if all(_ITEM.match(x) for x in items):
        return False  # a bare list or a single entry
    return len(words) > 6 or bare[0].isupper()


def defects(question: str | None, answer: str | None, profiles: Profiles | None = None) -> list[str]:
    """Every defect of a pair, in the order of ``DEFECTS``."""
    if is_empty(answer):
        return ["empty"]
    out = ["copied_question"] if is_copy(question, answer) else []
    if _REFUSAL.search(answer.replace("’", "'")):
        out.append("refusal")
    if is_foreign(question, answer, profiles):
        out.append("other_language")
    if is_truncated(question, answer):
        out.append("truncated")
    return out


def flag_pairs(pairs: DataFrame, fit: bool = True) -> DataFrame:
    """(pair_id, defects array<string>) of each row of ``pairs(pair_id bigint, question, answer)``; no defect gives an empty array."""
    profiles = fit_profiles(pairs) if fit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defects(q, a, profiles) for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(found, pa.list_(pa.string()))], names=["pair_id", "defects"])

    return pairs.select("pair_id", "question", "answer").mapInArrow(run, "pair_id bigint, defects array<string>")


def first_defects(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect) of the defective pairs: the first defect of each, repeated rows once."""
    return flag_pairs(pairs).where(F.size("defects") > 0).select("pair_id", F.get("defects", F.lit(0)).alias("defect")).distinct()
