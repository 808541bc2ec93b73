"""Stems, lemmas, number words and dates in words. The row functions are plain Python, applied by Arrow UDFs."""

from __future__ import annotations

import datetime as dt
import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "january february march april may june july august september october november december".split()
#: The format of dates and times that are put in words.
DATE = re.compile(r"\b(\d{4})/(\d{2})/(\d{2})(?:\s+AT\s+\d{1,2}:\d{2}\s+(?:AM|PM))?\b", re.IGNORECASE)


def _hundreds(n: int) -> str:
    out = []
    if n >= 100:
        out.append(f"{ONES[n // 100]} hundred")
        n %= 100
        if n:
            out.append("and")
    if n >= 20:
        out.append(TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else ""))
    elif n:
        out.append(ONES[n])
    return " ".join(out)


def cardinal(n: int) -> str:
    """Words of a number, with `and` before the last part below a hundred and commas between larger parts."""
    if n == 0:
        return ONES[0]
    groups, scale = [], 0
    rest = n
    while rest:
        groups.append(rest % 1000)
        rest //= 1000
    if len(groups) > len(SCALES) + 1:
        return str(n)
    parts = []
    for scale in range(len(groups) - 1, 0, -1):
        if groups[scale]:
            parts.append(f"{_hundreds(groups[scale])} {SCALES[scale - 1]}")
    last = groups[0]
    head = ", ".join(parts)
    if not last:
        return head
    if not head:
        return _hundreds(last)
    return f"{head} and {_hundreds(last)}" if last < 100 else f"{head}, {_hundreds(last)}"


def ordinal(n: int) -> str:
    head, sep, last = re.match(r"(.*?)([- ]?)([a-z]+)$", cardinal(n)).groups()
    last = ORDINALS.get(last) or (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")
    return head + sep + last


def date_in_words(text: str) -> str:
    def put(m: re.Match) -> str:
        try:
            day = dt.date(int(m[1]), int(m[2]), int(m[3]))
        except ValueError:
            return m[0]
        return f"{MONTHS[day.month - 1]} {ordinal(day.day)} {cardinal(day.year)}"

    return DATE.sub(put, text)


@F.pandas_udf(T.StringType())
def _dates(s: pd.Series) -> pd.Series:
    return s.map(date_in_words, na_action="ignore")


def verbalise_dates(c: Column) -> Column:
    """yyyy/mm/dd, a time after it dropped, in words; dates that don't exist stay. Only rows with a date reach Python."""
    return F.when(c.rlike(r"\d{4}/\d{2}/\d{2}"), _dates(F.when(c.rlike(r"\d{4}/\d{2}/\d{2}"), c))).otherwise(c)


@F.pandas_udf(T.StringType())
def _numbers(s: pd.Series) -> pd.Series:
    def put(x: str) -> str:
        try:
            return cardinal(int(x))
        except ValueError:  # digits that are no decimal number, such as superscripts
            return x

    return s.map(put, na_action="ignore")


def number_words(c: Column) -> Column:
    """Tokens of digits in words (with blanks); others as they are."""
    digits = c.rlike(r"^\p{Nd}+$")
    return F.when(digits, _numbers(F.when(digits, c))).otherwise(c)


# -- Porter's suffix stripping (1980), written as tables of rules for its steps


def _shape(stem: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(stem):
        out += "v" if x in "aeiou" or x == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str, extended: bool = True) -> bool:
    shape = _shape(word)
    return shape[-3:] == "cvc" and word[-1] not in "wxy" or extended and shape == "vc"


STEP2 = [tuple(x.split(":")) for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()]
STEP3 = [tuple(x.split(":")) for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: What the extended variant has besides, and the words it stems by list.
STEP2_MORE = [("bli", "ble"), ("fulli", "ful"), ("logi", "log")]
STEMS = dict(x.split(":") for x in "sky:sky skies:sky dying:die lying:lie tying:tie news:news inning:inning innings:inning outing:outing outings:outing canning:canning cannings:canning howe:howe proceed:proceed exceed:exceed succeed:succeed".split())


def _step2(w: str, extended: bool) -> str:
    rules = [r for r in STEP2 if r[0] != "abli"] + STEP2_MORE if extended else STEP2
    end, to = max(((a, b) for a, b in rules if w.endswith(a)), key=lambda x: len(x[0]), default=("", ""))
    if not end:
        return w
    good = _measure(w[:-3] if end == "logi" else w[: -len(end)]) > 0
    made = w[: -len(end)] + to if good else w
    return _step2(made, extended) if good and extended and end == "alli" else made


@functools.lru_cache(maxsize=200_000)
def porter_stem(word: str, extended: bool = True) -> str:
    """The stem of a lower-case word; extended: with the list of STEMS, short words in -ies and -ied, y after consonants only,
    and three more endings, else by the rules of 1980 alone."""
    if extended and word in STEMS:
        return STEMS[word]
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w, again = word, False
    if extended and w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        end = next((x for x in ("ed", "ing") if w.endswith(x)), "")
        if end and "v" in _shape(w[: -len(end)]):
            w, again = w[: -len(end)], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w, extended):
            w += "e"
    if w.endswith("y") and (len(w) > 2 and _shape(w[:-1])[-1] == "c" if extended else "v" in _shape(w[:-1])):
        w = w[:-1] + "i"
    w = _step2(w, extended)
    end, to = max(((a, b) for a, b in STEP3 if w.endswith(a)), key=lambda x: len(x[0]), default=("", ""))
    if end and _measure(w[: -len(end)]) > 0:
        w = w[: -len(end)] + to
    end = max((a for a in STEP4 if w.endswith(a)), key=len, default="")
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1], extended):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def porter(s: pd.Series) -> pd.Series:
    return s.map(porter_stem, na_action="ignore")


#: Endings that come off a noun, and what is put in their place.
DETACH = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


#: Nouns whose plural no rule gives.
IRREGULAR = tuple(
    tuple(x.split(":"))
    for x in (
        "children:child feet:foot geese:goose teeth:tooth mice:mouse lice:louse dormice:dormouse oxen:ox brethren:brother pence:penny dice:die "
        "kine:cow cacti:cactus fungi:fungus nuclei:nucleus radii:radius stimuli:stimulus alumni:alumnus foci:focus loci:locus syllabi:syllabus "
        "analyses:analysis axes:axis bases:basis crises:crisis diagnoses:diagnosis hypotheses:hypothesis oases:oasis parentheses:parenthesis theses:thesis "
        "criteria:criterion phenomena:phenomenon data:datum bacteria:bacterium media:medium strata:stratum indices:index matrices:matrix vertices:vertex appendices:appendix larvae:larva antennae:antenna"
    ).split()
)


def lemmas(vocabulary: DataFrame, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(token, lemma): the base form of an exception, else the shortest one by the detachment rules that is itself a word.

    lexicon (form): the words that count; by default the vocabulary itself, since no dictionary is at hand. exceptions
    (token, base): irregular forms, which need not be in the lexicon; by default those of IRREGULAR.
    """
    known = (vocabulary.select(F.col("token").alias("form")) if lexicon is None else lexicon.select("form")).distinct()
    rules = F.array(*(F.struct(F.lit(a).alias("end"), F.lit(b).alias("to")) for a, b in DETACH))
    tried = vocabulary.select("token", F.explode(rules).alias("r")).where("token like concat('%', r.end) and length(token) >= length(r.end)")
    tried = tried.where("not (token like '%ss' and r.end = 's')").select("token", F.expr("concat(substring(token, 1, length(token) - length(r.end)), r.to)").alias("form"))
    best = tried.join(known, "form").groupBy("token").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("x"))
    if exceptions is None:
        exceptions = vocabulary.sparkSession.createDataFrame(list(IRREGULAR), "token string, base string")
    irregular = exceptions.groupBy("token").agg(F.min("base").alias("base"))
    return vocabulary.join(best, "token", "left").join(irregular, "token", "left").select("token", F.coalesce("base", "x.form", "token").alias("lemma"))
