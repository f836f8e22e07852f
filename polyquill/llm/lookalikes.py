"""One consistent form for text that looks the same (problem 2).

Look-alike relations between strings - a code point and its compatibility or
decomposed form, a letter and its double in another script, a special blank and
the plain one, an invisible character and nothing - are closed transitively by
union-find into classes. How often each member of a class occurs is counted
over the whole collection, by language (the empty string once beside every
character), and the most frequent member becomes the class's representative for
that language; of a letter with doubles in other scripts the most frequent one
in the script of its word. A text is rewritten greedily, leftmost-longest, by
multi-pattern automata of all members that are no representative: one of the
language, and within words of mixed scripts one of the word's script.

Left as they are: zero-width joiners inside emoji, non-joiners after letters
of Persian text and around Indic viramas, direction marks in right-to-left
text, full-width punctuation and the wide blank in Chinese and Japanese text,
symbols that look different from plain text (superscripts, fractions, styled
alphabets), whole words in another script, and JSON escapes, which are ASCII.

Arabic and Persian share letters that differ only in their code points, so the
language of such a text is told by the frequencies of its letter pairs in the
collection's Arabic and Persian rows, not by the row's label alone.

Defined results: null and empty texts stay; a text of invisible characters or
special blanks alone becomes empty or plain blanks, which is a case; an unknown
or null language counts as `other`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-alikes that Unicode's own decompositions do not give.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u061c\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\u034f"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Cyrillic and Greek doubles of Latin letters.
LETTER_DOUBLES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оο", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "ə": "ә", "ı": "ι", "ó": "ό", "ö": "ӧ", "ü": "ӱ", "ï": "ϊ", "í": "ί", "ç": "ҫ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "Ə": "Ә", "é": "ё", "Ö": "Ӧ",
}
#: Letters of the Arabic script that look the same, for both languages or Persian only.
ARABIC_DOUBLES = {"ی": "ي", "ک": "ك", "ه": "ہە"}
PERSIAN_DOUBLES = {"ی": "ى"}
#: Languages that share a script but not the code points of some letters.
SIBLINGS = ("Arabic", "Persian")
#: Of these, those whose spelling has the zero-width non-joiner.
NON_JOINING = ("Persian",)

#: Compatibility mappings that keep the look, apart from width.
SAME_LOOK = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")
OTHER = "other"


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(b)] = self.find(a)

    def classes(self) -> list[list[str]]:
        held = defaultdict(list)
        for x in self.parent:
            held[self.find(x)].append(x)
        return list(held.values())


def unicode_pairs() -> Iterator[tuple[str, str]]:
    """Pairs that follow from Unicode's decompositions."""
    for code in (*range(0xA0, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000)):
        ch = chr(code)
        mapping = unicodedata.decomposition(ch)
        if not mapping:
            continue
        kind = mapping.split()[0]
        radical = 0x2E80 <= code < 0x2FE0
        ligature = 0xFB00 <= code <= 0xFB17
        if kind in SAME_LOOK or (kind == "<compat>" and (radical or ligature)) or (kind == "<compat>" and 0x3131 <= code <= 0x318E):
            yield unicodedata.normalize("NFKC", ch), ch
        elif not kind.startswith("<"):
            normal = unicodedata.normalize("NFC", ch)
            if unicodedata.combining(ch) == 0 and not unicodedata.category(ch).startswith("P"):
                if normal != ch:
                    yield normal, ch
                full = unicodedata.normalize("NFD", ch)
                if full != normal:
                    yield normal, full
    for syllable in range(0xAC00, 0xD7A4):
        yield chr(syllable), unicodedata.normalize("NFD", chr(syllable))


@cache
def script(ch: str) -> str:
    """First word of a letter's Unicode name, which is its script; '' of others."""
    if not ch.isalpha():
        return ""
    return "LATIN" if ch < "ɐ" else unicodedata.name(ch, "?").split()[0]


def relation(language: str) -> UnionFind:
    """All classes that hold for a language, but doubles of letters across
    scripts, which hold by word."""
    sets = UnionFind()
    for a, b in unicode_pairs():
        sets.union(a, b)
    doubles = [ARABIC_DOUBLES] if language in (*SIBLINGS, OTHER) else []
    for table in [*doubles, *([PERSIAN_DOUBLES] if language == "Persian" else [])]:
        for a, others in table.items():
            for b in others:
                sets.union(a, b)
    for b in BLANKS:
        sets.union(" ", b)
    for b in INVISIBLE:
        sets.union("", b)
    return sets


@cache
def _members() -> frozenset[str]:
    return frozenset(x for language in (*SIBLINGS, OTHER) for c in relation(language).classes() for x in c) | frozenset(_double_class())


@cache
def _double_class() -> dict[str, dict[str, str]]:
    """Letter -> {script: letter that looks the same}."""
    sets = UnionFind()
    for a, others in LETTER_DOUBLES.items():
        for b in others:
            sets.union(a, b)
    out: dict[str, dict[str, str]] = {}
    for c in sets.classes():
        by: dict[str, str] = {}
        for x in sorted(c):
            by.setdefault(script(x), x)
        for x in c:
            out[x] = by
    return out


# --- statistics ------------------------------------------------------------

_ARABIC = re.compile("[\u0620-\u06ff\ufb50-\ufdff\ufe70-\ufefc]")
_FOLD = {ord(b): a for table in (ARABIC_DOUBLES, PERSIAN_DOUBLES) for a, bs in table.items() for b in bs} | {ord(c): None for c in INVISIBLE}


@cache
def _sequences() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for x in _members():
        if len(x) > 1:
            machine.add_word(x, x)
    machine.make_automaton()
    return machine


def fold_arabic(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_FOLD)


def count_members(texts: list[str]) -> Counter:
    """Occurrences of single characters and of members of several code points."""
    whole = "\n".join(texts)
    counts: Counter = Counter(whole)
    counts.update(x for _, x in _sequences().iter(whole))
    counts[""] = len(whole)  # nothing stands beside every character
    return counts


def count_pairs(texts: list[str]) -> Counter:
    """Letter pairs of Arabic-script text, look-alikes folded."""
    pairs: Counter = Counter()
    for text in texts:
        if _ARABIC.search(text):
            folded = f" {fold_arabic(text)} "
            pairs.update(a + b for a, b in zip(folded, folded[1:], strict=False) if _ARABIC.match(a) or _ARABIC.match(b))
    return pairs


_STAT_ARROW = pa.schema([("language", pa.string()), ("kind", pa.string()), ("member", pa.string()), ("n", pa.int64())])


def statistics(texts: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(language, kind, member, n) over all of `texts` (language, text): kind
    `char` for members, `script` for letters by script, `pair` for letter pairs
    of sibling languages. One task sends each of its distinct members once."""
    known = frozenset(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, Counter] = defaultdict(Counter)
        pairs: dict[str, Counter] = defaultdict(Counter)
        scripts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            by: dict[str, list[str]] = defaultdict(list)
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[language if language in known else OTHER].append(text)
            for language, own in by.items():
                chars[language].update(count_members(own))
                if language in SIBLINGS:
                    pairs[language].update(count_pairs(own))
        for language, c in chars.items():
            for m, n in c.items():
                if len(m) == 1 and (of := script(m)):
                    scripts[language][of] += n
        held = (("char", chars), ("script", scripts), ("pair", pairs))
        rows = [(lang, kind, m, n) for kind, by in held for lang, c in by.items() for m, n in c.items() if kind != "char" or m in _members()]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STAT_ARROW.types, strict=True)], schema=_STAT_ARROW)

    each = texts.where("text is not null").select("language", "text").mapInArrow(run, "language string, kind string, member string, n bigint")
    return each.groupBy("language", "kind", "member").agg(F.sum("n").alias("n"))


# --- rewriting -------------------------------------------------------------

_NOTHING = frozenset(INVISIBLE)
_DOUBLE_SCRIPTS = re.compile("[\u0400-\u052f\u0561-\u0587\u0261]|[A-Za-z\u00c0-\u02af][\u0370-\u03ff]|[\u0370-\u03ff][A-Za-z\u00c0-\u02af]")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_EMOJI = re.compile("[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff]")
#: Punctuation and blank of wide type, which Chinese and Japanese text has of its own.
_WIDE_MARKS = frozenset(chr(c) for c in range(0xFF01, 0xFFEF) if not chr(c).isalnum()) | {"\u3000"}
_VIRAMA = frozenset("\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d")
_RTL_MARKS = frozenset("\u200e\u200f\u061c")


def belongs(text: str, i: int, joins: bool) -> bool:
    """Whether the invisible character at i is part of the spelling of a language
    or of an emoji. joins: the text is in a language that writes non-joiners
    after Arabic letters, also where the text breaks off behind one."""
    ch, before, after = text[i], text[i - 1 : i], text[i + 1 : i + 2]
    return bool(
        (ch == "\u200d" and _EMOJI.match(before) and _EMOJI.match(after))
        or (joins and ch == "\u200c" and _ARABIC.match(before) and (not after or _ARABIC.match(after)))
        or (ch in "\u200c\u200d" and before in _VIRAMA)
        or (ch in _RTL_MARKS and _ARABIC.search(text))
    )


class Rewriter:
    """Built once from the collection's statistics; small whatever the data:
    its size is bounded by the look-alike relations, not by the rows."""

    #: Log odds that a row's own language label adds between sibling languages.
    LABEL = 2.0
    #: A script is one of the collection's if it has this share of all letters.
    LIVE = 0.005

    def __init__(self, stats: Iterable[tuple[str, str, str, int]]) -> None:
        held: dict[str, dict[str, Counter]] = {k: defaultdict(Counter) for k in ("char", "script", "pair")}
        for language, kind, member, n in stats:
            held[kind][language][member] += n
        self.chars = dict(held["char"])
        self.total: Counter = sum(self.chars.values(), Counter())
        self.main_script = {language: c.most_common(1)[0][0] for language, c in held["script"].items() if c}
        letters: Counter = sum(held["script"].values(), Counter())
        #: Scripts the collection is written in; letters of others only stand in.
        self.live = {s for s, n in letters.items() if n >= self.LIVE * letters.total()} or {"LATIN"}
        pairs = held["pair"]
        self.odds = self._odds(pairs)
        self._machines: dict[str, ahocorasick.Automaton] = {}
        self._double_machines: dict[str, ahocorasick.Automaton] = {}

    def _odds(self, pairs: dict[str, Counter]) -> dict[str, float]:
        a, b = (Counter(pairs.get(s, {})) for s in SIBLINGS)
        kinds = set(a) | set(b)
        na, nb = a.total() + 0.5 * len(kinds), b.total() + 0.5 * len(kinds)
        return {p: math.log((a[p] + 0.5) / na) - math.log((b[p] + 0.5) / nb) for p in kinds} if a and b else {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machines": {}, "_double_machines": {}}

    def representative(self, members: list[str], language: str) -> str:
        """The most frequent member in a language's rows, else in all, else the
        composed, plain one."""
        own = self.chars.get(language, {})
        plain = unicodedata.normalize("NFKC", min(members, key=lambda m: (len(m), m)))
        return max(members, key=lambda m: (own.get(m, 0), self.total.get(m, 0), m == plain, -len(m), m))

    def machine(self, language: str) -> ahocorasick.Automaton:
        held = self._machines.get(language)
        if held is None:
            held = ahocorasick.Automaton()
            for members in relation(language).classes():
                best = self.representative(members, language)
                for m in members:
                    if m and m != best:
                        held.add_word(m, (len(m), best))
            held.make_automaton()
            self._machines[language] = held
        return held

    def doubles(self, to: str) -> ahocorasick.Automaton:
        """Letters of other scripts that have a double in script `to`, with its
        most frequent member there."""
        held = self._double_machines.get(to)
        if held is None:
            held = ahocorasick.Automaton()
            classes: dict[int, list[str]] = defaultdict(list)
            for x, by in _double_class().items():
                classes[id(by)].append(x)
            for members in classes.values():
                own = [x for x in members if script(x) == to]
                if own:
                    best = max(own, key=lambda x: (self.total.get(x, 0), -ord(x)))
                    for x in members:
                        if script(x) != to:
                            held.add_word(x, (1, best))
            held.make_automaton()
            self._double_machines[to] = held
        return held

    def sibling(self, text: str, label: str) -> str:
        """Which of the sibling languages an Arabic-script text is in."""
        folded = f" {fold_arabic(text)} "
        odds = self.LABEL * ((label == SIBLINGS[0]) - (label == SIBLINGS[1]))
        odds += sum(self.odds.get(a + b, 0.0) for a, b in zip(folded, folded[1:], strict=False))
        return SIBLINGS[odds < 0]

    def _word(self, m: re.Match, label: str) -> str:
        word = m.group()
        if word.isascii():
            return word
        doubles = _double_class()
        votes: Counter = Counter()
        foreign = False
        for ch in word:
            s = script(ch)
            if s in self.live:
                votes[s] += 1 if ch in doubles else 3
            elif s and ch not in doubles:
                foreign = True
        if not votes:
            if foreign:  # a word of a script that no language here is written in
                return word
            to = self.main_script.get(label, "LATIN")
            if any(to not in doubles[ch] for ch in word if ch in doubles):
                to = "LATIN"
        else:
            to = max(votes, key=lambda s: (votes[s], s == self.main_script.get(label)))
        return _replace(self.doubles(to), word) if len(self.doubles(to)) else word

    def rewrite(self, text: str, label: str) -> str:
        """`text` in its consistent form; itself if nothing changes."""
        if text.isascii():
            return text
        language = self.sibling(text, label) if _ARABIC.search(text) else label
        joins, new = language in NON_JOINING, text
        wide = _HAN.search(text) is not None
        if (label in SIBLINGS and not _ARABIC.search(text)) or (self.main_script.get(label) == "CJK" and not wide and language == label):
            language = OTHER  # the text is in another script than its label says

        def stays(i: int, n: int, best: str) -> bool:
            ch = new[i]
            if ch in _NOTHING:
                return belongs(new, i, joins)
            return n == 1 and not best.isalnum() and (best in _WIDE_MARKS or (wide and ch in _WIDE_MARKS))

        # Again, as a rewritten letter or a dropped character may complete a sequence.
        for _ in range(3):
            before, new = new, _replace(self.machine(language), new, stays)
            if new == before:
                break
        if _DOUBLE_SCRIPTS.search(new):
            new = _WORD.sub(lambda m: self._word(m, label), new)
        return new


def _replace(machine: ahocorasick.Automaton, text: str, stays: Callable[[int, int, str], bool] | None = None) -> str:
    """All matches replaced, leftmost-longest, but for those that stay."""
    out, start = [], 0
    for end, (n, best) in machine.iter_long(text):
        i = end + 1 - n
        if stays is None or not stays(i, n, best):
            out += (text[start:i], best)
            start = end + 1
    return "".join(out) + text[start:] if start else text


_OUT = "origin string, rec_id bigint, grp int, item int, text string, form string"
_OUT_ARROW = pa.schema([("origin", pa.string()), ("rec_id", pa.int64()), ("grp", pa.int32()), ("item", pa.int32()), ("text", pa.string()), ("form", pa.string())])


def rewrite(texts: DataFrame, rewriter: Rewriter, changed_only: bool = False) -> DataFrame:
    """`texts` (origin, rec_id, grp, item, language, text) with the consistent
    `form`. Pure ASCII never leaves the JVM where only changes are asked for."""
    shared = texts.sparkSession.sparkContext.broadcast(rewriter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = shared.value.rewrite
        for batch in batches:
            forms = [None if t is None else form(t, lang or OTHER) for lang, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(forms, pa.string())], schema=_OUT_ARROW)

    source = texts.select("origin", F.col("rec_id").cast("bigint"), F.col("grp").cast("int"), F.col("item").cast("int"), "language", "text")
    if changed_only:
        return source.where(F.col("text").rlike(r"[^\x00-\x7F]")).mapInArrow(run, _OUT).where("form <> text")
    return source.mapInArrow(run, _OUT)


def answer_texts(annotations: DataFrame, countries: DataFrame) -> DataFrame:
    """Every answer of every row with its positions and its country's language."""
    languages = F.broadcast(countries.select(F.col("country").alias("_c"), "language"))  # 16 rows, fixed
    groups = annotations.select("ann_id", "country", F.posexplode("annotations").alias("grp", "_g"))
    answers = groups.select("ann_id", "country", "grp", F.posexplode("_g.answers").alias("item", "text"))
    return answers.join(languages, F.col("country") == F.col("_c"), "left").select(F.lit("answers").alias("origin"), F.col("ann_id").alias("rec_id"), "grp", "item", "language", "text")


def response_texts(responses: DataFrame) -> DataFrame:
    return responses.select(F.lit("response").alias("origin"), F.col("resp_id").alias("rec_id"), F.lit(-1).alias("grp"), F.lit(-1).alias("item"), "language", F.col("response").alias("text"))


def learn(texts: DataFrame, languages: tuple[str, ...]) -> Rewriter:
    """The rewriter of a collection. What reaches the driver is one row for each
    language and member that occurs: bounded by the relations."""
    return Rewriter((r.language, r.kind, r.member, r.n) for r in statistics(texts, languages).toLocalIterator())
