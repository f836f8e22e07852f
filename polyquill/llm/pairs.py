"""Broken prompt and response pairs (problem 3).

Noisy labelling functions vote on every pair, several for each defect: yes, no
or abstain. Their votes are combined by a label model: for each defect, how
often a function votes so on broken and on sound pairs, and how common the
defect is, come from expectation maximisation over the counts of all vote
patterns. A pair gets each defect whose posterior exceeds that defect's cutoff,
so it may have several.

Some functions ask what the collection itself says: which letter groups and
words each language is written with, and which first words begin texts that end
with a stop. These statistics are exact counts over all rows; those kept have at
least a fixed share of their total (so there are at most as many as the share
goes into one, whatever the size of the collection), and letter groups of
alphabets, which are bounded by the alphabets.

Defined results: a null response is empty; null prompts and questions leave the
copy functions without a source (they abstain); a null or unknown language is
never `other_language`; a row delivered twice gives each defect once.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquill.llm.lookalikes import INVISIBLE, _double_class, script
from polyquill.session import ensure_checkpoint_dir

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
#: Posteriors above which a defect stands, validated on labelled pairs in 13
#: languages that share no sentence with any table (tests/llm/test_pairs.py).
CUTOFFS = {"empty": 0.5, "truncated": 0.5, "refusal": 0.9, "copy": 0.5, "other_language": 0.5}
YES, NO, ABSTAIN = 1, 2, 0

#: Least share of a language's words, and of all first words, that is kept.
WORD_SHARE, LEAD_SHARE = 1e-4, 1e-5
#: First words seen less often say nothing.
LEAST_LEADS = 5
#: Distinct responses a task of the statistics holds before it reads them.
TEXTS_HELD = 50_000

# --- text helpers ----------------------------------------------------------

_DROP = {ord(c): None for c in INVISIBLE}
_TO_LATIN = {ord(x): by["LATIN"] for x, by in _double_class().items() if "LATIN" in by and script(x) == "CYRILLIC"}
_GREEK_TO_LATIN = {ord(x): by["LATIN"] for x, by in _double_class().items() if "LATIN" in by and script(x) == "GREEK"}
_ODD = re.compile(f"[{INVISIBLE}]")
_CYRILLIC = re.compile("[\u0400-\u052f]")
_MIXED = re.compile("[a-zA-Z][Ͱ-Ͽ]|[Ͱ-Ͽ][a-zA-Z]")
_GREEK_WORD = re.compile("[Ͱ-Ͽa-zA-Z]+")


def _unmix(m: re.Match) -> str:
    word = m.group()
    latin = sum(c < "ɐ" for c in word)
    if 2 * latin >= len(word):
        return word.translate(_GREEK_TO_LATIN)
    doubles = _double_class()
    return "".join(doubles[c].get("GREEK", c) if c < "ɐ" and c in doubles else c for c in word)


def plain(text: str) -> str:
    """Text without odd encoding: compatibility forms, invisible characters and
    letters of other scripts that only look right."""
    if text.isascii():
        return text
    if _ODD.search(text):
        text = text.translate(_DROP)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if _CYRILLIC.search(text):
        text = text.translate(_TO_LATIN)
    if _MIXED.search(text):
        text = _GREEK_WORD.sub(_unmix, text)
    return text


_FENCE = re.compile(r"^\s*```[a-z]*\s*|\s{0,4}```\s*$")
#: White space and marks around an answer. All stripping is by characters: a
#: pattern anchored at the end would try every blank of a long run.
_WRAP = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\"'“”«»„*_`"
#: Words that label a question or an answer, in the collection's languages.
LABELS = frozenset(
    "answer question response q a response prompt respuesta pregunta jawaban pertanyaan jawab waleran patarosan amsa tambaya cavab sual απάντηση ερώτηση الجواب السؤال الإجابة پاسخ پرسش سوال 답변 질문 답 回答 答案 问题 答 问 উত্তৰ প্ৰশ্ন መልስ ጥያቄ".split()
)
_LABEL = re.compile(r"^[\s*_]*([^\s:：]{1,20})\s*[:：][*_]*\s*")


def drop_label(line: str) -> str:
    m = _LABEL.match(line)
    return line[m.end() :] if m and m.group(1).strip("*_").lower() in LABELS else line


_STRINGS = re.compile(r'"((?:[^"\\]|\\.)*)(?:"|$)(\s*:)?')


def _scalars(value: object) -> Iterator[str]:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif v is not None:
            yield str(v)


class Answer:
    """One response taken apart."""

    __slots__ = ("body", "json_ok", "json_like", "parts", "raw")

    def __init__(self, response: str) -> None:
        self.raw = text = plain(response).strip()
        fenced = text.startswith("```")
        body = _FENCE.sub("", text) if fenced else text
        body = drop_label(body).strip()
        self.json_like = body[:1] in "{["[: 2 if body else 0] and bool(re.match(r"[{\[]\s*[\"{\[\]}]|[{\[]$", body))
        self.json_ok = False
        self.parts = [body]
        if self.json_like:
            try:
                value = json.loads(body)
                self.json_ok = True
                self.parts = list(_scalars(value))
            except (ValueError, RecursionError):
                # The values as far as they came; strings before a colon are keys.
                self.parts = [_unescape(m.group(1).replace('\\"', '"')) for m in _STRINGS.finditer(body) if not m.group(2)] or [body]
        self.body = "\n".join(plain(p) for p in self.parts)


def _unescape(text: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)) if not 0xD800 <= int(m.group(1), 16) < 0xE000 else "", text)


_KEEP = re.compile(r"[^\W_]", re.UNICODE)
_NON_WORD = re.compile(r"[\W_]+")


def squash(text: str) -> str:
    """Letters and digits in lower case, nothing else."""
    return _NON_WORD.sub("", plain(text).casefold())


# --- what the collection says ----------------------------------------------

_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ASIDE = re.compile(r"[\(\[（][^()\[\]（）]*[\)\]）]?")
_STOP = ".!?。।።፧؟？！…"
#: A semicolon after Greek letters is a question mark.
_GREEK_QUESTION = re.compile("[\u0370-\u03ff\u1f00-\u1fff][\"'»”)]?;$")
#: Closing marks that may follow a stop, as may emoji.
_CLOSING = frozenset("\"'“”«»*_`)]）}")


def cut_tail(text: str) -> str:
    """Text without blanks, closing marks and emoji at its end."""
    end = len(text)
    while end and ((c := text[end - 1]) in _CLOSING or c.isspace() or "\u2190" <= c <= "\u2bff" or c in "\ufe0f\u200d" or "\U0001f000" <= c <= "\U0001faff"):
        end -= 1
    return text[:end]


def cut_aside(text: str) -> str:
    """Text without a short aside in brackets at its end; emoji and marks may
    follow the aside."""
    bare = text.rstrip()
    while bare and bare[-1] not in ")]）" and (tail := cut_tail(bare[-1])) != bare[-1:]:
        bare = bare[:-1].rstrip()
    if bare[-1:] and bare[-1] in ")]）":
        at = max(bare.rfind(c, max(0, len(bare) - 14)) for c in "([（")
        if at >= 0:
            return bare[:at].rstrip()
    return text


def words_of(text: str) -> list[str]:
    """Words in lower case, without asides in brackets."""
    if "(" in text or "[" in text or "（" in text:
        text = _ASIDE.sub(" ", text)
    return _WORDS.findall(text.lower())


def grams(word: str) -> Iterator[str]:
    padded = f"^{word}$"
    return (padded[i : i + 3] for i in range(len(padded) - 2))


def lead(text: str) -> str:
    """How a text begins: its first two words, or four characters without blanks."""
    head = text[:80].strip(_WRAP).lower().split()
    if not head:
        return ""
    return " ".join(head[:2]) if len(head) > 1 and not "㐀" <= head[0][0] <= "鿿" else head[0][:4]


def ends_with_stop(text: str) -> bool:
    """Whether text ends with a stop; emoji, closing marks and a short aside may follow."""
    for end in (cut_tail(text), cut_tail(cut_aside(text))):
        if end[-1:] and (end[-1] in _STOP or _GREEK_QUESTION.search(end[-3:])):
            return True
    return False


_STAT_ARROW = pa.schema([("kind", pa.string()), ("language", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("stops", pa.int64())])


def statistics(responses: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(kind, language, key, n, stops) over all rows: `word` and `gram` counts of
    the languages that share a script, `total` of their words, and `lead` counts
    of first words with how often the text ends with a stop."""
    known = frozenset(x for x in languages if x not in _SCRIPT_OF or list(_SCRIPT_OF.values()).count(_SCRIPT_OF[x]) > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        heads, stopped = Counter(), Counter()

        def take(held: Counter) -> None:
            for (language, text), n in held.items():
                text = Answer(text).body if text[:1] in "{[`" else plain(text)
                if language in known:
                    own = counts[language]
                    for w in words_of(text):
                        own[w] += n
                head = lead(drop_label(text))
                heads[head] += n
                if ends_with_stop(text):
                    stopped[head] += n

        held: Counter = Counter()  # equal responses are read once
        for batch in batches:
            held.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if len(held) > TEXTS_HELD:
                take(held)
                held = Counter()
        take(held)
        rows: list[tuple] = [("lead", "", h, n, stopped[h]) for h, n in heads.items()]
        for language, words in counts.items():
            parts: Counter = Counter()
            for w, n in words.items():
                if _SCRIPT_LETTERS[_SCRIPT_OF.get(language, "LATIN")].fullmatch(w):
                    for g in grams(w):
                        parts[g] += n
            rows += [("word", language, w, n, 0) for w, n in words.items()]
            rows += [("gram", language, g, n, 0) for g, n in parts.items()]
            rows.append(("total", language, "", words.total(), 0))
        rows.append(("total", "", "", heads.total(), 0))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STAT_ARROW.types, strict=True)], schema=_STAT_ARROW)

    each = responses.where("response is not null").select("language", "response").mapInArrow(run, "kind string, language string, key string, n bigint, stops bigint")
    return each.groupBy("kind", "language", "key").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"))


def kept_statistics(stats: DataFrame) -> DataFrame:
    """Of the statistics those that are asked for: totals, letter groups, words
    and first words with their share of the total. `stats` is read twice."""
    totals = F.broadcast(stats.where("kind = 'total'").select(F.col("language").alias("_l"), F.col("n").alias("_n")))  # a row a language
    share = F.when(F.col("kind") == "word", WORD_SHARE).when(F.col("kind") == "lead", LEAD_SHARE).otherwise(0.0)
    kept = (F.col("n") >= share * F.col("_n")) & ((F.col("kind") != "lead") | (F.col("n") >= LEAST_LEADS))
    return stats.join(totals, F.col("language") == F.col("_l")).where(kept).select("kind", "language", "key", "n", "stops")


class Collection:
    """The statistics as the labelling functions ask for them."""

    CACHE = 100_000

    def __init__(self, stats: Iterable[tuple[str, str, str, int, int]], languages: tuple[str, ...]) -> None:
        held: dict[tuple[str, str], dict[str, int]] = defaultdict(dict)
        #: Share of the texts beginning so that end with a stop.
        self.leads: dict[str, float] = {}
        for kind, language, key, n, stops in stats:
            if kind == "lead":
                self.leads[key] = stops / n
            else:
                held[kind, language][key] = n
        self.languages = sorted(languages)
        self.words = [held["word", x] for x in self.languages]
        self.grams = [held["gram", x] for x in self.languages]
        self.word_total = [held["total", x].get("", 0) for x in self.languages]
        self.gram_total = [sum(c.values()) for c in self.grams]
        self.groups: dict[str, list[int]] = defaultdict(list)
        for i, x in enumerate(self.languages):
            self.groups[_SCRIPT_OF.get(x, "LATIN")].append(i)
        self._scores: dict[tuple[str, str], tuple[tuple[float, ...], tuple[float, ...]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scores": {}}

    def score(self, word: str, group: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """Log likelihoods of a word in each language of a script: from the counts
        of the word itself (none where no language has it), and from those of its
        letter groups, as their mean."""
        held = self._scores.get((word, group))
        if held is None:
            members = self.groups[group]
            seen = any(word in self.words[i] for i in members)
            own = tuple(math.log((self.words[i].get(word, 0) + 0.5) / (self.word_total[i] + 1)) for i in members) if seen else ()
            gs = list(grams(word))
            parts = tuple(sum(math.log((self.grams[i].get(g, 0) + 0.5) / (self.gram_total[i] + 5000)) for g in gs) / max(1, len(gs)) for i in members)
            held = own, parts
            if len(self._scores) >= self.CACHE:
                self._scores.clear()
            self._scores[word, group] = held
        return held

    def margins(self, words: list[str], language: str) -> tuple[float | None, float | None]:
        """Log odds of the best other language of the same script against
        `language`, by whole words and by letter groups; None without any."""
        group = _SCRIPT_OF.get(language, "LATIN")
        members = self.groups[group]
        if len(members) < 2:
            return None, None
        score = self.score
        parts = [score(w, group) for w in words]
        at = members.index(self.languages.index(language))
        out: list[float | None] = []
        for own in ([p[0] for p in parts if p[0]], [p[1] for p in parts]):
            sums = [sum(x) for x in zip(*own, strict=True)]
            out.append(max(x for i, x in enumerate(sums) if i != at) - sums[at] if sums else None)
        return out[0], out[1]

    def begins_a_sentence(self, text: str) -> float | None:
        """Share of the texts beginning so that end with a stop; None of rare ones."""
        return self.leads.get(lead(text))


# --- labelling functions ---------------------------------------------------

#: Words that stand for a missing value.
MISSING = frozenset(
    ["none", "null", "nil", "nan", "na", "n/a", "n.a.", "n.a", "n\\a", "undefined", "missing", "empty", "blank", "unknown value", "no answer", "no response", "not available", "not applicable", "no data",
     "ninguno", "ninguna", "sin respuesta", "tidak ada", "teu aya", "babu", "yoxdur", "κανένα", "καμία απάντηση", "لا يوجد", "لا شيء", "هیچ", "ندارد", "없음", "无", "無", "নাই", "የለም"]
)

# Words of refusals by language, each family apart from the others
# as (inability, lack, apology, object, self). Inability says that the speaker
# cannot, may not, does not want to or does not know; a lack is a refusal only
# with an object of answering; self is the speaker as a program.
REFUSAL_WORDS = {
    "en": (
        r"\b(?:i|we|me|my|it|this|that|there|one)\b[^.!?\n]{0,30}?(?:\bcan(?:no|'|’)?t\b|\bcan ?not\b|\bcould(?: not|n['’]t)\b|\bwon['’]t\b|\bwill not\b|\bwould(?: not|n['’]t)\b|\b(?:am|'m|’m|are|is)(?: not|n['’]t)\b|\bnot (?:able|allowed|permitted|sure|going)\b|\b(?:do|does|did)(?: not|n['’]t)\b|\bunable\b|\bunsure\b|\bno way\b)[^.!?\n]{0,40}?\b(?:know|sure|say|tell|help|assist|answer|respond|reply|comment|discuss|share|provide|give|offer|speak|talk|able|allowed|permitted|comfortable|position|possible|familiar|aware|certain|authori[sz]ed|willing|appropriate|recommend|determine|confirm|verify|access|address|address|respond|address|express|going)\b|^\W*(?:can(?:no|'|’)?t|cannot|could(?: not|n['’]t)|unable|won['’]t|not (?:able|allowed|sure)|don['’]t|do not)\b.{0,20}\b(?:know|say|tell|help|answer|assist|comment|discuss|share|provide|speak)|\b(?:decline|refuse|refrain|rather not|prefer not|must pass|will pass|beyond (?:my|what i)|outside (?:my|the scope|of what)|no comment|no idea|no clue|who knows|hard for me to say|not something i can|falls outside)\b",
        r"\b(?:have|has|had|have|got|is|are|possess|there['’]s)(?: no| not|n['’]t| neither| little)\b|\black(?:s|ing)?\b|\bnot enough\b|\binsufficient\b|\bwithout (?:more|any|further)\b|\b(?:do|does)(?: not|n['’]t) (?:have|hold|possess)\b|\bno\b",
        r"\bsorry\b|\bapolog|\bafraid\b|\bunfortunately\b|\bregret\b|\bforgive\b|\bpardon\b",
        r"\b(?:answer|question|questions|information|info|help|assist|opinion|opinions|topic|request|comment|respond|reply|discuss|advice|data|knowledge|details|context|subject|view|views|matter|that|this)\b",
        r"\b(?:as an? (?:ai|artificial|language|automated|assistant)|language model|i(?:['’]m| am) (?:an? )?(?:ai|bot|program|machine|assistant)|my training|my guidelines|my programming)\b",
    ),
    "es": (
        r"\bno (?:lo |le |te |les |la )?(?:puedo|podemos|podría|sé|sabría|sabemos|soy capaz|conozco|me es posible|es posible|me corresponde|deseo|voy a|debo|se me permite|me permiten|me está permitido|estoy (?:segur|autorizad|en condiciones|capacitad))|prefiero no|me niego|desconozco|ignoro|me abstengo|me es imposible|me resulta imposible|ni idea",
        r"\bno (?:tengo|tenemos|dispongo|cuento con|poseo|hay)|carezco|sin (?:más )?(?:información|datos)|falta",
        r"lo siento|perdón|perdon[ae]|disculp|lament|desafortunadamente|me temo|por desgracia",
        r"respuesta|pregunta|informaci|opini|\btema|datos|ayud|respond|contest|coment|hablar|decir|conocimiento|\bidea|detalles",
        r"modelo de lenguaje|inteligencia artificial|\bcomo ia\b|mi programación",
    ),
    "id": (
        r"\b(?:tidak|belum|tak|nggak) (?:dapat|bisa|mampu|boleh|tahu|mengetahui|ingin|berwenang|yakin|mengerti|diizinkan|berhak|akan)|kurang (?:tahu|yakin)|\benggan|menolak|keberatan|\bentah|di luar (?:kemampuan|wewenang)",
        r"\b(?:tidak|belum|tak) (?:punya|memiliki|mempunyai|ada|cukup)|kekurangan",
        r"\bmaaf|sayangnya|menyesal",
        r"jawab|pertanyaan|informasi|pendapat|topik|\bdata|bantu|bahas|komentar|pengetahuan|hal (?:ini|itu|tersebut)|bicara",
        r"model bahasa|kecerdasan buatan|sebagai ai\b|asisten virtual",
    ),
    "su": (
        r"\b(?:teu|henteu|can|acan|moal) (?:tiasa|bisa|terang|apal|uninga|nyaho|kénging|meunang|yakin|hayang|hoyong|wani)|nolak|\balim\b",
        r"\b(?:teu|henteu|acan) (?:gaduh|boga|aya|cekap)",
        r"hapunten|\bpunten|hampura|nyuhunkeun maaf",
        r"waler|jawab|patarosan|pananya|informasi|katerangan|pamanggih|topik|bahas|bantos|\bdata|pangaweruh|nyarios",
        r"mod[ée]l basa|kacerdasan jieunan",
    ),
    "ha": (
        r"\bba (?:zan|na|mu|za mu) |\bba zan|\bban (?:san|sani|iya)|\bba a (?:yarda|ba ni)|na ƙi|ba (?:zai|shi) yiwu|ba mu san",
        r"\bba (?:ni|mu) da|\bbabu|\bban da\b",
        r"haƙuri|gafara|afuwa|nadama",
        r"amsa|tambaya|bayani|ra'ayi|\bbatu|magana|taimak|ilimi|masaniya|izini",
        r"samfurin harshe|na'ura mai|fasahar",
    ),
    "az": (
        r"bilm(?:ir|ər)(?:əm|ik)|bil(?:mə|mi)dim|(?:verə|edə|deyə|aça|danışa|söyləyə|ola) bilm|bacarm|istəm(?:ir|əz)|imtina|mümkün deyil|əmin deyil|icazə verilm|xəbərim yox",
        r"yoxdur|çatmır|kifayət (?:etmir|deyil)",
        r"bağışla|\büzr|təəssüf",
        r"cavab|\bsual|məlumat|fik[ir]|mövzu|kömək|danış|şərh|icazə|bilgi",
        r"dil model|süni intellekt",
    ),
    "el": (
        r"\bδεν (?:μπορώ|μπορούμε|ξέρω|ξέρουμε|γνωρίζω|είμαι (?:σε θέση|σίγουρ|βέβαι|εξουσιοδοτημέν)|είναι δυνατ|μου επιτρέπεται|επιτρέπεται|θέλω|θα (?:ήθελα|μπορούσα)|δύναμαι)|αδυνατώ|αρνούμαι|αγνοώ|προτιμώ να μην",
        r"\bδεν (?:έχω|έχουμε|διαθέτω|υπάρχ)|χωρίς (?:περισσότερ|αρκετ)|στερούμαι",
        r"λυπάμαι|λυπούμαι|συγγνώμη|συγνώμη|δυστυχώς|συγχωρ",
        r"απαντ|απάντ|ερώτη|ερωτή|πληροφορ|γνώμη|άποψη|θέμα|βοηθ|σχολι|μιλή|στοιχεία|γνώσ",
        r"γλωσσικό μοντέλο|τεχνητή νοημοσύνη",
    ),
    "ar": (
        r"لا (?:أستطيع|استطيع|يمكنني|يمكن|أعرف|اعرف|أعلم|اعلم|أدري|ادري|أقدر|أود|أرغب|يسمح|يحق|يجوز)|لست (?:قادر|متأكد|واثق|مخول|مستعد)|(?:ليس|ليست) (?:بإمكان|بوسع|باستطاعت)|لم أتمكن|أرفض|أجهل|يتعذر|يصعب علي|غير (?:قادر|مسموح|مخول|متأكد)",
        r"(?:ليس|ليست) (?:لدي|عندي|هناك)|لا (?:توجد|يوجد|أملك|املك|تتوفر|يتوفر)|تنقصني|دون معلومات",
        r"عذر|آسف|اسف|أعتذر|للأسف|يؤسفني|سامح",
        r"إجاب|اجاب|جواب|أجيب|سؤال|معلوم|رأي|موضوع|مساعد|تعليق|حديث|بيانات|معرفة|التحدث|أمر",
        r"نموذج(?:ا)? ?(?:ل)?(?:غوي|لغوي)|ذكاء اصطناعي|الذكاء الاصطناعي",
    ),
    "fa": (
        r"نمی[ \u200c]?(?:توان|دان|خواه|شناس)|(?:مجاز|مطمئن|قادر|ممکن|مقدور) نیست|اجازه ندار|امکان[ \u200c]?پذیر نیست|معذور|خودداری|بی[ \u200c]?خبر",
        r"ندار(?:م|یم)|نیست|کافی نیست",
        r"متاسف|متأسف|ببخش|\bعذر|پوزش|شرمنده",
        r"پاسخ|جواب|پرسش|سوال|سؤال|اطلاع|\bنظر|موضوع|کمک|صحبت|داده|دانش|اجازه",
        r"مدل زبان|هوش مصنوعی",
    ),
    "ko": (
        r"(?:답|대답|말|도와|드릴|할|설명|제공|알|언급|논의|이야기)[^.\n]{0,8}수 (?:가 )?없|모르(?:겠|니)|모릅니다|몰라|(?:답|말씀|설명|대답|판단)[^.\n]{0,10}(?:어렵|곤란|못|않겠|불가)|거절|삼가|사양|자신이 없|허용되지",
        r"없습니다|없어요|없네요|부족|않습니다",
        r"죄송|미안|유감|안타깝|양해",
        r"답|질문|정보|의견|주제|도움|도와|말씀|알려|자료|지식|설명|언급",
        r"언어 모델|인공지능",
    ),
    "zh": (
        r"无法|不能|不便|不知道|不清楚|不了解|不确定|不晓得|没法|不予|拒绝|难以|不愿|不可以|不方便|无可奉告|恕不|恕我|不好说|不懂|帮不",
        r"没有|缺乏|不足|无相关",
        r"抱歉|对不起|遗憾|不好意思|原谅|见谅",
        r"回答|答案|问题|信息|意见|看法|主题|话题|帮助|帮到|评论|资料|相关|提供|讨论|谈论|这方面|回应|答复",
        r"语言模型|人工智能",
    ),
    "as": (
        r"নোৱাৰ|নাজান|অক্ষম|অপাৰগ|নিবিচাৰ|অনুমতি নাই|সম্ভৱ নহয়|নকওঁ",
        r"নাই|নহয়|অভাৱ",
        r"দুঃখিত|ক্ষমা|মাফ",
        r"উত্তৰ|প্ৰশ্ন|তথ্য|\bমত|বিষয়|সহায়|জ্ঞান|মন্তব্য|জনা",
        r"ভাষা মডেল|কৃত্ৰিম বুদ্ধি",
    ),
    "am": (
        r"አልችልም|አላውቅ|አልተፈቀደ|አይፈቀድ|አይቻል|አልፈልግም|እምቢ|አልቻልኩ|እርግጠኛ አይደለሁም|ያዳግተኛል",
        r"የለኝም|የለም|አይደለ",
        r"ይቅርታ|አዝናለሁ|ያሳዝናል",
        r"መልስ|ጥያቄ|መረጃ|አስተያየት|ርዕስ|እርዳ|መናገር|እውቀት|ለመመለስ|ልረዳ",
        r"የቋንቋ ሞዴል|ሰው ሠራሽ|አርቴፊሻል",
    ),
}
# Without any of these strings (in blanks) no pattern of a language
# written in Latin letters can match; found by one automaton.
LATIN_SIGNS = (
    " no | not |n't|n’t|cannot| cant |can not|unable|unsure|decline|refus|refrain|rather|prefer| pass|beyond|outside|clue|who knows|hard for me|lack|insufficient|without|neither|little|sorry|apolog|afraid|unfortunately|regret|forgive|pardon|language model| ai |training|guidelines|programming|assistant|program |machine| bot "
    "|prefiero|me niego|desconozco|ignoro|abstengo|imposible|ni idea|carezco| sin |falta|siento|perdón|perdon|disculp|lament|desafortunad|me temo|desgracia|modelo de|inteligencia"
    "|tidak|belum| tak |nggak|kurang|enggan|menolak|keberatan|entah|di luar|maaf|sayangnya|menyesal|model bahasa|kecerdasan|asisten"
    "| teu |henteu| can | acan |moal |nolak|alim|punten|hampura|nyuhunkeun|model basa|modél basa"
    "| ba | ban |babu|na ƙi|haƙuri|gafara|afuwa|nadama|samfurin|na'ura|fasahar"
    "|bilm|bacarm|istəm|imtina|mümkün deyil|əmin deyil|icazə|xəbərim|yoxdur|çatmır|kifayət|bağışla|üzr|təəssüf|dil model|süni"
)


@cache
def _latin_signs() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for sign in LATIN_SIGNS.split("|"):
        machine.add_word(sign, 1)
    machine.make_automaton()
    return machine


_NOT_LETTERS = re.compile(r"[^\w'’]+")


@cache
def _refusal_patterns() -> dict[str, list[tuple[re.Pattern, ...]]]:
    """Patterns by the script they are written in: a refusal may come in another
    language than asked."""
    out: dict[str, list[tuple[re.Pattern, ...]]] = defaultdict(list)
    scripts = {"el": "GREEK", "ar": "ARABIC", "fa": "ARABIC", "ko": "HANGUL", "zh": "CJK", "as": "BENGALI", "am": "ETHIOPIC"}
    for code, families in REFUSAL_WORDS.items():
        out[scripts.get(code, "LATIN")].append(tuple(re.compile(f) for f in families))
    return out


_SCRIPT_BLOCKS = {"GREEK": re.compile("[\u0370-\u03ff]{3}"), "ARABIC": re.compile("[\u0600-\u06ff]{3}"), "HANGUL": re.compile("[\uac00-\ud7af]{2}"), "CJK": re.compile("[\u4e00-\u9fff]{2}"), "BENGALI": re.compile("[\u0980-\u09ff]{2}"), "ETHIOPIC": re.compile("[\u1200-\u137f]{2}"), "LATIN": re.compile("[a-z]{2}")}
_SENTENCE = re.compile(r"[^.!?।።؟？！…。\n]+")


def refusal_signs(low: str) -> tuple[bool, bool, bool, bool, bool]:
    """Which families of refusal words a lower-case text has: inability, its
    object in the same sentence, lack with an object, apology, self."""
    signs = [False] * 5
    patterns = _refusal_patterns()
    for name, block in _SCRIPT_BLOCKS.items():
        if not block.search(low):
            continue
        if name == "LATIN" and next(_latin_signs().iter(f" {_NOT_LETTERS.sub(' ', low)} "), None) is None:
            continue
        for inability, lack, apology, obj, self_ in patterns[name]:
            can = inability.search(low)
            if can or lack.search(low):
                for m in _SENTENCE.finditer(low):
                    sentence = m.group()
                    about = obj.search(sentence) is not None
                    if can and inability.search(sentence):
                        signs[0] = True
                        signs[1] = signs[1] or about
                    if about and lack.search(sentence):
                        signs[2] = True
            signs[3] = signs[3] or apology.search(low) is not None
            signs[4] = signs[4] or self_.search(low) is not None
    return tuple(signs)  # type: ignore[return-value]


_BEYOND_LATIN = re.compile("[\u0370-\U000e0000]")
#: An answer follows all the same, or the inability is another's.
_ANSWERS_ALL_THE_SAME = re.compile(r"(?:any(?:one|body|thing)|nobody|nothing|no one) (?:who|better|else than|that)|better than|who would (?:refuse|say no)|short (?:reply|answer)\s*[:：]|can(?:no|'|’)?t (?:live|do|imagine|start|afford|eat|sleep|go)|(?:but|however|still),? (?:i would say|most people|my guess|it is|usually|many)|\b(?:so|i think|probably|perhaps) (?:it is|the answer)")
_LIST_END = re.compile(r"(?:^|\n)[^\S\n]*(?:\d{1,3}[.)]|[-*•])\s*$")
_LIST_LINE = re.compile(r"^[^\S\n]*(?:\d{1,3}[.)]|[-*•])\s+", re.MULTILINE)
_SENTENCE_BREAK = re.compile(r"[.!?。।።؟？！…][\"”»'’)]*\s+(?=\S)|[。！？](?=\S)")
_COMMA = re.compile("[,،、，፣]")
_COMMA_END = re.compile(r"[,،、，;፣]\s*$")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "“": "”", "«": "»"}
_OPENING = re.compile("[" + re.escape("".join(_PAIRS)) + "]")
_QUESTION_MARK = re.compile("[?？؟;;]")
_SCRIPT_OF = {"Korean": "HANGUL", "Chinese": "CJK", "Amharic": "ETHIOPIC", "Assamese": "BENGALI", "Greek": "GREEK", "Arabic": "ARABIC", "Persian": "ARABIC"}

#: Letters of the scripts that several languages share: their groups are counted.
_SCRIPT_LETTERS = {"LATIN": re.compile("[a-z\u00df-\u024f\u0259\u02bc'’-]+"), "ARABIC": re.compile("[\u0620-\u06ff]+")}

#: Labelling functions by defect, in the order of their votes.
FUNCTIONS = {
    "empty": ("blank", "only_marks", "empty_structure", "missing_word", "has_words"),
    "truncated": ("open_pair", "broken_json", "open_list", "comma_end", "open_sentence", "opens_like_sentence", "long_without_stop", "finished"),
    "refusal": ("inability", "inability_about_answering", "lack_of_answer", "apology", "as_a_program", "brief", "answers_all_the_same"),
    "copy": ("is_question", "is_prompt", "nothing_else"),
    "other_language": ("other_script", "other_words", "other_letters"),
}


def _unclosed(text: str) -> bool:
    """Whether a bracket or double quote is opened and not closed."""
    if text.count('"') % 2 or text.count("```") % 2 or text.count("**") % 2:
        return True
    if not _OPENING.search(text):
        return False
    stack: list[str] = []
    for ch in text:
        if ch in _PAIRS:
            stack.append(_PAIRS[ch])
        elif stack and ch == stack[-1]:
            stack.pop()
    return bool(stack)


class Labeller:
    """Votes of all labelling functions on a pair."""

    CACHE = 50_000

    def __init__(self, collection: Collection) -> None:
        self.collection = collection
        self._held: dict[tuple, tuple] = {}
        self._asked: dict[tuple, tuple[str, list[str]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_held": {}, "_asked": {}}

    def votes(self, language: str | None, question: str | None, prompt: str | None, response: str | None) -> tuple[tuple[int, ...], ...]:
        """Votes by defect, in the order of DEFECTS. What depends on the
        response alone is kept for the next equal response."""
        key = (language, response)
        own = self._held.get(key)
        if own is None:
            own = self._own(language, response)
            if len(self._held) >= self.CACHE:
                self._held.clear()
            self._held[key] = own
        empty, truncated, refusal, other, copied = own
        copy = self._copy(question, prompt, copied)
        if copy[0] == YES or copy[1] == YES:
            # A whole question may end as it likes: functions that ask how a text
            # ends have nothing to say, and what it began is finished.
            ends = {"open_sentence": ABSTAIN, "opens_like_sentence": ABSTAIN, "long_without_stop": ABSTAIN, "comma_end": ABSTAIN, "finished": NO}
            truncated = tuple(ends.get(f, v) for f, v in zip(FUNCTIONS["truncated"], truncated, strict=True))
        return empty, truncated, refusal, copy, other

    def _own(self, language: str | None, response: str | None) -> tuple:
        if response is None or not plain(response).strip():
            return (YES, YES, ABSTAIN, ABSTAIN, YES), (NO,) * 8, (NO, NO, NO, NO, NO, ABSTAIN, ABSTAIN), (NO, ABSTAIN, ABSTAIN), None
        answer = Answer(response)
        low = answer.body.lower()
        letters = _KEEP.search(answer.body) is not None
        bare = drop_label(low).strip(_WRAP).strip(" .!。।።")
        nothing = bare in MISSING
        empty = (
            ABSTAIN if nothing or not letters else NO, ABSTAIN if nothing else NO if letters else YES,
            YES if not letters and (answer.json_ok or answer.raw.startswith("```")) else ABSTAIN,
            YES if nothing else ABSTAIN, NO if letters and not nothing else YES,
        )
        if not letters or nothing:
            return empty, (NO,) * 8, (NO, NO, NO, NO, NO, ABSTAIN, ABSTAIN), (NO, ABSTAIN, ABSTAIN), None
        said = "\n".join([drop_label(x) for x in answer.body.split("\n")])
        ends = _WORDS.findall(said)
        copied = (said, ends[0].lower(), ends[-1].lower()) if ends and len(said) >= 6 else None
        return empty, self._truncated(answer), self._refusal(low), self._other(said, language), copied

    def _truncated(self, answer: Answer) -> tuple[int, ...]:
        raw = answer.raw
        open_pair = _unclosed(raw)
        broken = answer.json_like and not answer.json_ok
        tail = raw.rsplit("\n", 1)[-1]
        listed = _LIST_END.search(raw) is not None and len(raw) > 3
        text = answer.body if answer.json_like else raw
        last = drop_label(_LIST_LINE.sub("", text.rsplit("\n", 1)[-1])).strip()
        stop = ends_with_stop(last)
        ended = (stop or not last) and not listed
        comma = not ended and _COMMA_END.search(cut_tail(tail)) is not None and not _QUESTION_MARK.search(tail[-1:].replace(";", "") or "x")
        pieces = _SENTENCE_BREAK.split(last)
        fragment = pieces[-1]
        core = _ASIDE.sub(" ", fragment)
        opens = not ended and len(pieces) > 1 and _KEEP.search(core) is not None and len(pieces[-2]) > 3
        share = None if ended else self.collection.begins_a_sentence(drop_label(core))
        n = len(core.split())
        long = not ended and n >= 7 and max(len(x.split()) for x in _COMMA.split(core)) >= 7
        return (
            YES if open_pair else ABSTAIN, YES if broken else ABSTAIN, YES if listed else ABSTAIN, YES if comma and not listed else ABSTAIN,
            YES if opens else NO if ended else ABSTAIN,
            ABSTAIN if share is None else YES if share > 0.5 else ABSTAIN if open_pair or broken or listed or comma else NO,
            YES if long else ABSTAIN,
            NO if ended and not (open_pair or broken or listed) else NO if not opens and n <= 3 and not (open_pair or broken or listed or comma) and (share or 0) <= 0.5 else ABSTAIN,
        )

    @staticmethod
    def _refusal(low: str) -> tuple[int, ...]:
        can, about, lack, apology, program = refusal_signs(low)
        if not (can or lack or apology or program):
            return NO, NO, NO, NO, NO, ABSTAIN, ABSTAIN
        said = low.count("\n") < 3 and len(low) < 200
        same = _ANSWERS_ALL_THE_SAME.search(low) is not None
        can, about, lack = (x and not same for x in (can, about, lack))
        return YES if can else NO, YES if about else NO, YES if lack else NO, YES if apology else NO, YES if program else NO, YES if (can or lack) and said else ABSTAIN, NO if same else ABSTAIN

    def _other(self, said: str, language: str | None) -> tuple[int, ...]:
        if language not in self.collection.languages:
            return ABSTAIN, ABSTAIN, ABSTAIN
        words = words_of(said)
        if not words:
            return NO, ABSTAIN, ABSTAIN
        main = "LATIN"
        if _BEYOND_LATIN.search(said):
            scripts: dict[str, int] = {}
            for w in words:
                of = script(w[0])
                scripts[of] = scripts.get(of, 0) + len(w)
            main = max(scripts, key=scripts.__getitem__)
        if main != _SCRIPT_OF.get(language, "LATIN"):
            return YES, ABSTAIN, ABSTAIN
        by_words, by_letters = self.collection.margins(words, language)
        vote = lambda m, cut: ABSTAIN if m is None else YES if m > cut else NO if m < -0.5 else ABSTAIN
        return NO, vote(by_words, 2.0), vote(by_letters, 1.0)

    def _sources(self, question: str | None, prompt: str | None) -> tuple[str, list[str]]:
        """The whole prompt and the forms of its question, squashed; kept for
        the next pair with the same."""
        key = (question, prompt)
        held = self._asked.get(key)
        if held is None:
            lines = [drop_label(plain(x)) for x in (prompt or "").split("\n")]
            asked = {squash(question)} if question else set()
            for line in lines:
                cut = [m.end() for m in _QUESTION_MARK.finditer(line)]
                if cut:
                    asked.add(squash(line[: cut[-1]]))
            held = squash("\n".join(lines)), sorted((q for q in asked if len(q) >= 6), key=len, reverse=True)
            if len(self._asked) >= self.CACHE:
                self._asked.clear()
            self._asked[key] = held
        return held

    def _copy(self, question: str | None, prompt: str | None, copied: tuple[str, str, str] | None) -> tuple[int, ...]:
        if not prompt and not question:
            return ABSTAIN, ABSTAIN, ABSTAIN
        # Far shorter than the question is no copy; the country's name may shorten it.
        if copied is None or (question and len(copied[0]) < 0.4 * len(question)):
            return NO, NO, NO
        # A copy has the words of its source: told first by its ends, cheaply.
        said, first, last = copied
        source = plain(f"{question or ''}\n{prompt or ''}").lower()
        if first not in source or last not in source:
            return NO, NO, NO
        whole, asked = self._sources(question, prompt)
        said = squash(said)
        rest = said.replace(whole, "") if whole else said
        left = rest
        for q in asked:
            left = left.replace(q, "")
        gone = left == "" or left in LABELS
        return YES if left != rest and gone else NO, YES if rest != said and gone else NO, YES if gone else NO


# --- label model -----------------------------------------------------------


class LabelModel:
    """Binary label model of one defect: votes are taken as independent given
    the label; fitted by expectation maximisation on pattern counts."""

    def __init__(self, functions: int, rounds: int = 60) -> None:
        self.functions, self.rounds = functions, rounds
        self.prior = 0.05
        #: table[y][f][vote]
        self.table = [[[0.0] * 3 for _ in range(functions)] for _ in range(2)]

    def fit(self, patterns: dict[tuple[int, ...], int]) -> LabelModel:
        # Begins from the majority of those that vote; a tie counts as sound.
        soft = {v: 0.95 if v.count(YES) > v.count(NO) else 0.5 if v.count(YES) == v.count(NO) > 0 else 0.02 for v in patterns}
        total = sum(patterns.values())
        for _ in range(self.rounds):
            mass = sum(n * soft[v] for v, n in patterns.items())
            self.prior = min(max((mass + 0.5) / (total + 10.0), 1e-6), 0.5)
            for y in (0, 1):
                for f in range(self.functions):
                    counts = [0.1, 0.1, 0.1]
                    for v, n in patterns.items():
                        counts[v[f]] += n * (soft[v] if y else 1 - soft[v])
                    s = sum(counts)
                    self.table[y][f] = [c / s for c in counts]
            new = {v: self.posterior(v) for v in patterns}
            if max((abs(new[v] - soft[v]) for v in new), default=0.0) < 1e-6:
                break
            soft = new
        return self

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for f, v in enumerate(votes):
            if v != ABSTAIN:  # silence says nothing: a defect has several forms, each seen by few functions
                ratio = math.log(self.table[1][f][v]) - math.log(self.table[0][f][v])
                # A yes never speaks against the defect, a no never for it.
                odds += max(0.0, ratio) if v == YES else min(0.0, ratio)
        return 1 / (1 + math.exp(min(700.0, -odds)))


@cache
def _code(votes: tuple[int, ...]) -> int:
    """Vote pattern as a number; the patterns are few."""
    return sum(v * 3**i for i, v in enumerate(votes))


def _decode(code: int, n: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 for i in range(n))


def label(responses: DataFrame, labeller: Labeller) -> DataFrame:
    """(resp_id, one vote code per defect) of every row."""
    shared = responses.sparkSession.sparkContext.broadcast(labeller)
    arrow = pa.schema([("resp_id", pa.int64()), *((d, pa.int32()) for d in DEFECTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = shared.value.votes
        for batch in batches:
            rows = [[_code(v) for v in votes(*x)] for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(DEFECTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in cols)], schema=arrow)

    source = responses.select(F.col("resp_id").cast("bigint"), *(F.col(c).cast("string") for c in ("language", "question", "prompt", "response")))
    return source.mapInArrow(run, "resp_id bigint, " + ", ".join(f"{d} int" for d in DEFECTS))


def defects(responses: DataFrame, languages: tuple[str, ...], cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(resp_id, defect): every defect whose posterior exceeds its cutoff."""
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    spark = responses.sparkSession
    ensure_checkpoint_dir(spark)
    stats = kept_statistics(statistics(responses, languages).checkpoint())
    labeller = Labeller(Collection(((r.kind, r.language, r.key, r.n, r.stops) for r in stats.toLocalIterator()), languages))
    votes = label(responses, labeller).checkpoint()  # labelled once, read twice
    # Distinct patterns are few: at most 3^8 for a defect, whatever the rows.
    patterns: dict[str, dict[tuple[int, ...], int]] = {d: {} for d in DEFECTS}
    stacked = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS))).alias("v")
    for r in votes.select(stacked).groupBy("v.defect", "v.code").count().collect():
        patterns[r["defect"]][_decode(r["code"], len(FUNCTIONS[r["defect"]]))] = r["count"]
    hits = []
    for d in DEFECTS:
        model = LabelModel(len(FUNCTIONS[d])).fit(patterns[d])
        codes = [_code(v) for v in patterns[d] if model.posterior(v) > cutoffs[d]]
        hits.append(F.when(F.col(d).isin(codes), F.lit(d)) if codes else F.lit(None).cast("string"))
    found = votes.select("resp_id", F.explode(F.array_compact(F.array(*hits))).alias("defect"))
    return found.distinct()
