"""Text normalisation as column expressions, in the order in which the steps must run (built-in functions only)."""

from __future__ import annotations

import string
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English stop words; those with an apostrophe can't come out of the tokenizer.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn "
    "hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

#: Letters that fold to more than one, or that have no decomposition.
FOLD_WORDS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
_PLAIN = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}
#: Cyrillic and Greek letters and punctuation with one ASCII character each, and those with several.
_PLAIN |= dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziiklmnoprstufye", strict=True)) | dict(zip("αβγδεζηικλμνοπρσςτυω", "abgdezeiklmnoprsstuo", strict=True))
_PLAIN |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "×": "x"}
FOLD_MORE = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ъ": "'", "ь": "'", "θ": "th", "ξ": "x", "φ": "ph", "χ": "kh", "ψ": "ps"}
FOLD_MORE |= {k.upper(): v[0].upper() + v[1:] for k, v in FOLD_MORE.items()} | {"—": "--", "…": "...", "„": ",,"}
_PLAIN |= {k.upper(): v.upper() for k, v in _PLAIN.items() if k.isalpha() and k.upper() != k and len(k.upper()) == 1 and k not in "ıς"}


def _fold_pairs() -> tuple[str, str, dict[str, str]]:
    """(from, to): characters of any script whose compatibility decomposition is one ASCII character and marks, or a letter
    that folds to one; and those (ligatures, numerals, signs) that decompose to a few."""
    a, b, more = "", "", dict(FOLD_MORE)
    for cp in (*range(0xA0, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(cp)
        if c in FOLD_WORDS or c in more:
            continue
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        to = _PLAIN.get(c) or "".join(_PLAIN.get(x, x) for x in base)
        if to.isascii() and to.strip() and to != c:
            if len(to) == 1:
                a, b = a + c, b + to
            elif (0x2150 < cp < 0x2190 or 0xFB00 <= cp < 0xFB07) and to.isalpha():  # numerals, ligatures
                more[c] = to
    return a, b, more


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _fold_pairs()
#: Ranges that hold all of FOLD_SEVERAL; a few ranges are looked for much faster than single characters.
SEVERAL = "[\u0370-\u04FF\u2014-\u218F\uFB00-\uFB06]"
NOT_ASCII = r"[^\x00-\x7F]"
#: Tags, tokens and the punctuation taken off their ends.
TAG = r"<[^>]+>"
TOKEN = r"(?:https?://\S+)|(?:[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*)"
PUNCTUATION = string.punctuation
EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


@dataclass(frozen=True)
class TextConfig:
    """Options of the normaliser. Lemmas win over stems if both are on."""

    fold: bool = True
    stem: bool = False
    lemma: bool = False
    dates: bool = False
    numbers: bool = False
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    least: int = 2
    #: Base forms (form) that lemmas may have; without it the words of the corpus count.
    lexicon: DataFrame | None = field(default=None, compare=False, repr=False)


def guard(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_newlines(c: Column) -> Column:
    """A newline, and a backslash with an n, become a blank."""
    return F.replace(F.replace(c, F.lit("\\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def ascii_fold(c: Column, raw: Column | None = None) -> Column:
    """Characters one for one by a table; those with several letters for one only where raw (the text that c was made of,
    by default c) has any, as each of them is a pass over the text."""
    folded, raw = c, c if raw is None else raw
    for a, b in FOLD_WORDS.items():
        folded = F.replace(folded, F.lit(a), F.lit(b))
    folded = F.translate(folded, FOLD_FROM, FOLD_TO)
    spelled = folded
    for a, b in FOLD_SEVERAL.items():
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    return F.when(raw.rlike(SEVERAL), spelled).when(raw.rlike(NOT_ASCII), folded).otherwise(c)


def raw_tokens(c: Column) -> Column:
    """Lower-case tokens: URLs, words with inner hyphens; ASCII punctuation is taken off both ends."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda x: F.btrim(x, F.lit(PUNCTUATION)))


def kept_tokens(c: Column, stop_words=tuple(STOP_WORDS), least: int = 2) -> Column:
    """Without short tokens and stop words. The list is a literal set: looked up by hash, not by a join."""
    listed = list(stop_words)
    return F.filter(c, lambda x: (F.length(x) >= least) & (~x.isin(listed) if listed else F.lit(True)))


def prepared(c: Column, config: TextConfig = TextConfig()) -> Column:
    """The text just before it is cut into tokens."""
    from kiln.functions.words import verbalise_dates

    raw, c = guard(c), strip_tags(fold_newlines(guard(c)))
    if config.dates:
        c = verbalise_dates(c)
    return ascii_fold(c, raw) if config.fold else c


def tokens(c: Column, config: TextConfig = TextConfig()) -> Column:
    """Tokens as far as built-in functions go; stems, lemmas and number words are put on by `vocabulary_map`."""
    return kept_tokens(raw_tokens(prepared(c, config)), config.stop_words, config.least)


def joined_text(*parts: Column) -> Column:
    """The non-empty ones of parts (title, content and text, say), with blanks between."""
    return F.concat_ws(" ", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def document_id(id_: Column, second: Column, order: Column) -> Column:
    """id, else url (or doc_id), else doc_ and the position; null and empty count as missing, and so does the number 0."""
    missing = lambda c: F.when(c.cast("string").isin("", "0") | c.isNull(), None).otherwise(c.cast("string"))
    return F.coalesce(missing(id_), F.nullif(second.cast("string"), F.lit("")), F.concat(F.lit("doc_"), order.cast("string")))


def vocabulary_map(tokenised: DataFrame, config: TextConfig, lexicon: DataFrame | None = None) -> DataFrame:
    """tokenised (..., tokens) with lemmas or stems and number words put on.

    Each distinct token is mapped once, by an Arrow UDF over the vocabulary, and joined back to (row, position). The
    other columns travel along, so rows are numbered in one evaluation only. lexicon (form): the base forms of lemmas.
    """
    from kiln.functions import words

    if not (config.stem or config.lemma or config.numbers):
        return tokenised
    keyed = tokenised.withColumn("__row", F.monotonically_increasing_id())
    others = [c for c in tokenised.columns if c != "tokens"]
    each = keyed.select("__row", *others, F.posexplode_outer("tokens").alias("pos", "token"))
    vocabulary = tokenised.select(F.explode("tokens").alias("token")).distinct()
    if config.lemma:
        vocabulary = words.lemmas(vocabulary, lexicon).select("token", F.col("lemma").alias("form"))
    elif config.stem:
        vocabulary = vocabulary.select("token", words.porter(F.col("token")).alias("form"))
    else:
        vocabulary = vocabulary.select("token", F.col("token").alias("form"))
    form = F.split(words.number_words(F.col("form")), " ") if config.numbers else F.array("form")
    mapped = each.join(vocabulary.select("token", form.alias("forms")), "token", "left")
    placed = F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "forms")))
    return mapped.groupBy("__row", *others).agg(F.flatten(F.transform(F.array_sort(placed), lambda x: x["forms"])).alias("tokens")).select(*tokenised.columns)
