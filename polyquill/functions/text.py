"""Text functions as Column expressions; all stay in the JVM.

Nulls give nulls. White space is that of Unicode; tests of types compare whole
strings and use decimal digits of any script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space inside a character class, for Java and RE2 alike.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters as text: trimming by characters is linear, a pattern
#: anchored at the end tries every blank of a long run.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_time(text: Column) -> Column:
    """Two digits, a colon, two digits; the range is not tested."""
    return text.rlike(r"^\p{Nd}{2}:\p{Nd}{2}$")


def is_date(text: Column) -> Column:
    """One or two digits, a slash, one or two digits."""
    return text.rlike(r"^\p{Nd}{1,2}/\p{Nd}{1,2}$")


def number(text: Column) -> Column:
    """The number a text is, else null; Java's type suffixes are no numbers."""
    bare = strip(text)
    return F.when(~bare.rlike("[0-9.][dDfF]$"), bare.try_cast("double"))


def is_number(text: Column) -> Column:
    return F.coalesce(number(text).isNotNull(), F.lit(False)) & text.isNotNull()


def fits_question(answer: Column, question: Column) -> Column:
    """Whether an answer has the format its question asks for: HH:MM before
    MM/DD before Arabic numerals; any other question takes any answer."""
    return F.when(question.contains("HH:MM"), is_time(answer)).when(question.contains("MM/DD"), is_date(answer)).when(question.contains("Arabic"), is_number(answer)).otherwise(F.lit(True))


def half_width(text: Column) -> Column:
    """Full-width colon, comma and stop as ASCII ones."""
    return F.translate(text, "：、，。", ":,,.")


def drop_label(text: Column, prompt: Column) -> Column:
    """Lower-cased text without the prompt and without a leading `word:` that
    the prompt contains; all places of that label go."""
    low = F.lower(half_width(F.replace(text, prompt, F.lit(""))))
    label = F.regexp_extract(low, r"^([\p{L}\p{N}_]+:)\s", 1)
    known = (label != "") & F.lower(half_width(prompt)).contains(F.replace(label, F.lit(":"), F.lit("")))
    return strip(F.when(known, F.replace(low, label, F.lit(""))).otherwise(low))


def normal_response(response: Column, prompt: Column) -> Column:
    """A response as it is matched: without label, outer stops and case."""
    return F.btrim(drop_label(response, prompt), F.lit("."))


def tokens(text: Column) -> Column:
    """Words in lower case; marks separate words, empty parts are dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", " "), f"[{SPACE}]+"), lambda w: w != "")


def words(text: Column) -> Column:
    """Parts between slashes and white space, as they are."""
    return F.filter(F.split(text, f"[/{SPACE}]+"), lambda w: w != "")


def no_common_word(a: Column, b: Column) -> Column:
    """Whether two answers differ: numbers by value, texts if neither contains
    the other and they share no word."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), (x != y) | F.isnan(x) | F.isnan(y)).otherwise(~(a.contains(b) | b.contains(a)) & ~F.arrays_overlap(words(a), words(b)))


def matches(answer: Column, response: Column, words: tuple[Column, Column] | None = None) -> Column:
    """Whether a normalised response gives an answer: it contains it, with
    hyphens and blanks exchangeable, or has all its words: those of `words`
    (answer's, response's) if given, else plain tokens. Blank answers match
    nothing."""
    low = F.lower(strip(answer))
    inside = response.contains(low) | response.contains(F.replace(low, F.lit("-"), F.lit(" "))) | response.contains(F.replace(low, F.lit(" "), F.lit("-")))
    parts = tokens(answer)
    own, given = words or (parts, tokens(response))
    every = F.size(F.array_except(own, given)) == 0
    return (F.size(parts) > 0) & (inside | (every if words is None else (F.size(own) > 0) & every))


def json_object(text: Column) -> Column:
    """The first flat JSON object in a text as map, else null: line breaks,
    fences and a comma before the brace are taken out first."""
    body = F.regexp_extract(F.replace(text, F.lit("\n"), F.lit("")), r"\{[^}]+\}", 0)
    for old in ("```json", "`"):
        body = F.replace(body, F.lit(old), F.lit(""))
    body = F.replace(body, F.lit(",}"), F.lit("}"))
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), F.from_json(body, "map<string,string>"))


def json_list(text: Column) -> Column:
    """The widest JSON list of objects in a text as array of maps, else null."""
    body = F.regexp_extract(F.replace(text, F.lit("\n"), F.lit("")), r"\[\s*\{.+\}\s*\]", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), F.from_json(body, "array<map<string,string>>"))


def nested_json(text: Column) -> Column:
    """The widest JSON object in a text, nested ones included, as text; null if
    there is none that parses. Fences are taken out first."""
    body = text
    for old, new in (("\n", ""), ("```json", ""), ("`", ""), (",}", "}")):
        body = F.replace(body, F.lit(old), F.lit(new))
    body = F.regexp_extract(body, r"\{.+\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def first_capital(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([A-Z])", 1), F.lit(""))


def key_of_value(options: Column, value: Column) -> Column:
    """The first key whose value equals `value`."""
    return F.get(F.map_keys(options), (F.array_position(F.map_values(options), value) - 1).cast("int"))


#: A text whose first braces hold one key with one text, nothing escaped in them:
#: the key, and the text where the key is that of the answer.
_PLAIN = r'[^"\\{}`\x00-\x1f\x7f]'
_ONE_KEY = rf'^[^{{]*+\{{ *"({_PLAIN}+)" *: *"{_PLAIN}*" *,?\}}'
_ONE_CHOICE = rf'^[^{{]*+\{{ *"answer_choice" *: *"({_PLAIN}+)" *,?\}}'


def choice_letter(full_res: Column, prompt: Column, options: Column) -> Column:
    """The letter a multiple-choice response picks. From a JSON object with
    `answer_choice`: its first capital if the prompt lists it, else the option
    with that text; otherwise the first capital anywhere. Failing all, the
    response itself. A JSON null reads as the word None, so as N."""
    parsed = json_object(full_res)
    has = F.coalesce(F.map_contains_key(parsed, F.lit("answer_choice")), F.lit(False))
    raw = F.coalesce(F.try_element_at(parsed, F.lit("answer_choice")), F.lit("None"))
    letter = first_capital(raw)
    by_text = F.coalesce(key_of_value(options, raw), full_res)
    picked = F.when(letter.isNotNull() & prompt.contains(F.concat(letter, F.lit("."))), letter).otherwise(by_text)
    return F.when(has, picked).when(parsed.isNotNull(), full_res).otherwise(F.coalesce(first_capital(full_res), full_res))


def with_choice_letter(answered: DataFrame, name: str = "final_ans") -> DataFrame:
    """`answered` (full_res, prompt, choices) with its choice_letter. The usual
    forms, texts without a brace and objects of one key with a plain text, are
    read step by step, each pattern once a row; any other goes to the parser."""
    full, brace = F.col("full_res"), F.col("full_res").contains("{")
    rows = answered.withColumn("_plain", F.when(brace, F.regexp_extract(full, _ONE_CHOICE, 1)).otherwise(""))
    rows = rows.withColumn("_first", F.regexp_extract(F.when(brace, F.col("_plain")).otherwise(full), "[A-Z]", 0))
    first = F.col("_first")
    anywhere = F.when(first != "", first).otherwise(full)
    listed = F.when((first != "") & F.col("prompt").contains(F.concat(first, F.lit("."))), first).otherwise(F.coalesce(key_of_value(F.col("choices"), F.col("_plain")), full))
    letter = F.when(~brace, anywhere).when(F.col("_plain") != "", listed).when(full.rlike(_ONE_KEY) & ~full.contains('"answer_choice"'), full).otherwise(choice_letter(full, F.col("prompt"), F.col("choices")))
    return rows.withColumn(name, letter).drop("_plain", "_first")


def between(text: Column, start: str, end: str) -> Column:
    """What lies between two markers; to the end if the second is missing."""
    return F.substring_index(F.when(text.contains(start), F.regexp_replace(text, f"(?s)^.*?{_quote(start)}", "")), end, 1)


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def flag(text: Column) -> Column:
    """yes/no words and letters and 1/0 as boolean; null for anything else."""
    low = F.lower(strip(text))
    return F.when(low.isin("yes", "true", "t", "y", "1"), F.lit(True)).when(low.isin("no", "false", "f", "n", "0"), F.lit(False))


def valid_history(history: Column) -> Column:
    """Whether every turn has a non-empty role and content."""
    return F.forall(history, lambda t: (F.coalesce(t["role"], F.lit("")) != "") & (F.coalesce(t["content"], F.lit("")) != ""))
