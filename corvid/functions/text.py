"""Text cleaning as column expressions, in a fixed order of optional steps."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Articles, prepositions and conjunctions of Portuguese, the default stop words.
STOPWORDS = frozenset("a e o as os um uma uns umas de da do das dos em na no nas nos por para com ao à às pelo pela pelos pelas que se não".split())
_MARKED, _PLAIN = "áàãâéèêíìîóòõôúùûçÁÀÃÂÉÈÊÍÌÎÓÒÕÔÚÙÛÇ", "aaaaeeeiiioooouuucAAAAEEEIIIOOOOUUUC"


def normalize_whitespace(text: Column) -> Column:
    """Without white space at the ends, every run inside is one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def remove_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{P}\p{S}]", "")


def remove_diacritics(text: Column) -> Column:
    """Accented letters of the table, and combining marks; other letters stay."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), "[\\u0300-\\u036F]", "")


def replace_numbers(text: Column, by: str = "[NUMBER]") -> Column:
    return F.regexp_replace(text, "[0-9]+", by)


def remove_stopwords(text: Column, words: Iterable[str] = STOPWORDS) -> Column:
    """Words are parts between white space; those in the list, in any case, go."""
    stop = F.array(*(F.lit(w) for w in sorted(words)))
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: ~F.array_contains(stop, F.lower(w))), " ")


def truncate(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


@dataclass(frozen=True)
class Cleaning:
    """Which steps run; the first two by default."""

    whitespace: bool = True
    html: bool = True
    lower: bool = False
    punctuation: bool = False
    diacritics: bool = False
    numbers: bool = False
    stopwords: bool = False
    max_length: int | None = None
    #: keep line ends, so that paragraphs can still be found afterwards
    preserve_newlines: bool = False
    stopword_list: frozenset[str] = STOPWORDS


def clean(text: Column, steps: Cleaning = Cleaning()) -> Column:
    """The chosen steps in the order white space, tags, case, punctuation, accents, numbers, stop words, length."""
    if steps.whitespace:
        text = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[ \t\f\x0b]+", " ") if steps.preserve_newlines else normalize_whitespace(text)
    if steps.html:
        text = remove_html(text)
    if steps.lower:
        text = F.lower(text)
    if steps.punctuation:
        text = remove_punctuation(text)
    if steps.diacritics:
        text = remove_diacritics(text)
    if steps.numbers:
        text = replace_numbers(text)
    if steps.stopwords:
        text = remove_stopwords(text, steps.stopword_list)
    if steps.max_length is not None:
        text = truncate(text, steps.max_length)
    return text
