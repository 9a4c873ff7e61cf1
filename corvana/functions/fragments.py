"""Texts in fragments: what is spoken for years, decades, ranges of years and money, and pieces of bounded length."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvana.functions import kernels
from corvana.functions.texts import CURRENCIES, PHRASE_END, SENTENCE_END, short_language_code

# Words before which four digits are a year, before which they are a decade, and words that scale an amount.
YEAR_CUES = (
    "in", "the", "a", "to", "of", "since", "from", "between", "by", "until", "around", "before", "after", "his", "her", "year", "years", "during", "copyright", "©", "early", "mid", "late",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "winter", "spring", "summer", "fall", "autumn",
)
DECADE_CUES = ("the", "in", "early", "mid", "late", "a")
SCALES = ("million", "billion", "trillion")

SIGNS = "".join(CURRENCIES)
#: Amounts with a sign before or behind or with a decimal part, then words, white space and single signs.
SPOKEN_WORD = rf"([{SIGNS}][0-9]+(?:[.,][0-9]+)*|[0-9]+(?:[.,][0-9]+)*[{SIGNS}]|[0-9]+(?:[.,][0-9]+)+|[\p{{L}}\p{{M}}\p{{N}}]+(?:['’][\p{{L}}\p{{M}}\p{{N}}]+)*|\s+|[^\s\p{{L}}\p{{M}}\p{{N}}])"


def spoken_words(s: Column) -> Column:
    """Words with the white space between them, amounts of money in one; joined they are the text."""
    return F.regexp_extract_all(s, F.lit(SPOKEN_WORD), 1)


def normalized_fragments(words: Column, language: Column) -> Column:
    """array<struct<normalized, reference, first, count>>: what is spoken for a text's words (white space as words among them).

    first and count tell which of the words that aren't blank a fragment stands for, so the references are
    these words in order. English only: a year after a cue word and a blank, a decade likewise, a range of years written without blanks,
    an amount with its currency before (and a scale word behind) or after it. The first rule in
    this order that fits a word takes it and the words it needs; a word that is taken begins nothing. Other
    languages' words stay. Null for null words.
    """

    told = kernels.normalized(YEAR_CUES, DECADE_CUES, SCALES, SIGNS, kernels.spoken_year, kernels.spoken_decade, CURRENCIES)

    @F.arrow_udf("array<struct<normalized:string,reference:string,first:int,count:int>>")
    def kernel(every: pa.Array, english: pa.Array) -> pa.Array:
        return told(every, english)

    return kernel(words, F.coalesce(short_language_code(language) == "en", F.lit(False)))


def fragments(s: Column, most: int, whole_sentences: bool = True, whole_phrases: bool = True) -> Column:
    """array<struct<text, start, last>>: a text in pieces of at most `most` code points; joined they are the text.

    A sentence joins the open piece if it fits; else it opens a new one (unless whole_sentences is off), and if
    it doesn't fit there either, its phrases are placed one by one by the same rule, and of a phrase that
    fits nowhere its words. A longer word is an error. start: the piece's place in the text; last: the sentence, phrase or word that
    was placed in it last. Null for null; an empty text has no pieces.
    """
    told = kernels.fragments(kernels.cutter(SENTENCE_END), kernels.cutter(PHRASE_END), most, whole_sentences, whole_phrases)

    @F.arrow_udf("array<struct<text:string,start:int,last:string>>")
    def kernel(texts: pa.Array) -> pa.Array:
        return told(texts)

    return kernel(s)


def last_segment(piece: Column) -> Column:
    """What was placed last in a piece of fragments(); null for none."""
    return piece["last"]
