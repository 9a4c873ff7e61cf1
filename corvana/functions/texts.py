"""Text functions as Column expressions. Lengths and places are in code points unless the name says otherwise."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.functions import kernels
from corvana.functions.vectors import let

# Emoji ranges, separators of phrases, signs that are read as words, and typographic marks with their plain forms.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]"
PHRASE_SEPARATORS = (",", "、", "，", "،", ";", "；", ":", "：", "—")
SYMBOL_WORDS = ("$", "€", "¢", "£", "¥", "©", "®", "™", "%", "&", "#", "~", "@", "+", "±", "÷", "/", "\\", "^", "*", "×", "=", "¼", "½", "¾")
PUNCTUATION = {
    "“": '"', "”": '"', "‟": '"', "ˮ": '"', "„": '"', "‹": '"', "›": '"', "❮": '"', "❯": '"', "«": '"', "»": '"', "״": '"', "❝": '"', "❞": '"', "🙶": '"', "🙷": '"', "⹂": '"', "〝": '"', "〞": '"', "〟": '"', "＂": '"', "❠": '"', "🙸": '"',
    "ߵ": "'", "ߴ": "'", "’": "'", "‘": "'", "ʹ": "'", "ʼ": "'", "＇": "'", "ʻ": "'", "՚": "'", "՛": "'", "❛": "'", "❜": "'", "❟": "'",
    "，": ",", "、": ",", "：": ":", "；": ";", "。": ".", "？": "?", "؟": "?", "！": "!", "¡": "!",
}
SENTENCE_ENDERS = (".", "?", "!", "。", "？", "！", "…")
WORD = r"[\p{L}\p{N}]"
WHITE = r"(?U)[\s\x{FEFF}]"


def is_word(s: Column) -> Column:
    return s.rlike(WORD)


def is_symbol_word(s: Column) -> Column:
    return trim(s).isin(list(SYMBOL_WORDS))


def includes_emoji(s: Column) -> Column:
    return s.rlike(EMOJI)


def is_word_or_symbol(s: Column) -> Column:
    return is_word(s) | includes_emoji(s) | is_symbol_word(s)


def includes_punctuation(s: Column) -> Column:
    return s.rlike(r"\p{P}")


def only_punctuation(s: Column) -> Column:
    return ~is_word(s) & ~is_symbol_word(s)


def is_phrase_separator(s: Column) -> Column:
    return only_punctuation(s) & includes_any(s, PHRASE_SEPARATORS)


def is_blank(s: Column) -> Column:
    return s.rlike(f"^{WHITE}*$")


def trim(s: Column) -> Column:
    """All Unicode white space off both ends, the byte order mark too."""
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+\\z", "")


def collapse(s: Column) -> Column:
    return F.regexp_replace(s, f"{WHITE}+", " ")


def whitespace(s: Column, mode: str) -> Column:
    """preserve, removeLineBreaks or collapse; the last two trim as well."""
    if mode == "preserve":
        return s
    if mode == "removeLineBreaks":
        return F.regexp_replace(trim(s), r"(\r?\n)+", " ")
    if mode == "collapse":
        return collapse(trim(s))
    raise ValueError(f"unknown white space mode {mode!r}")


def split_keeping(s: Column, separator: str) -> Column:
    """Pieces that end with their separator, a pattern of bounded length; no empty pieces."""
    return F.filter(F.split(s, f"(?<={separator})"), lambda x: x != "")


def lines(s: Column) -> Column:
    return split_keeping(s, r"\n")


def paragraphs(s: Column, breaks: str = "double", mode: str = "preserve") -> Column:
    """Paragraphs with the line feeds after them; single: each feed ends one, double: two or more do. Blank ones are dropped."""
    least = {"single": 1, "double": 2}[breaks]
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s)(.+?(?:(?:\r?\n){{{least},}}|\z))"), 1)
    return F.filter(F.transform(pieces, lambda x: whitespace(x, mode)), lambda x: ~is_blank(x))


def words(s: Column) -> Column:
    """Runs of letters, marks and digits (joined by apostrophes within), and each other visible sign alone."""
    return F.regexp_extract_all(s, F.lit(r"([\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*|[^\s\p{L}\p{M}\p{N}])"), 1)


def cut_after(s: Column, ends: str) -> Column:
    """Pieces up to and with each match of a pattern; no empty pieces."""
    return F.filter(F.split(F.regexp_replace(s, f"({ends})", "$1\u0001"), "\u0001"), lambda x: x != "")


# What ends a sentence and a phrase. Marks of Latin script do so before white space only.
SENTENCE_END = r"[。？！]+|[.?!…]+[\"'”’)\]]*\s+"
PHRASE_END = r"[、，،；：]+\s*|[,;:—]+\s+"


def sentences(s: Column) -> Column:
    """Sentences with the white space after them; joined they are the text."""
    return cut_after(s, SENTENCE_END)


def phrases(sentence: Column) -> Column:
    return cut_after(sentence, PHRASE_END)


def all_words(s: Column) -> Column:
    """words(), and the white space between them as words too; joined they are the text."""
    return F.regexp_extract_all(s, F.lit(r"([\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*|\s+|[^\s\p{L}\p{M}\p{N}])"), 1)


def parsed(s: Column) -> Column:
    """Sentences of phrases of words: array<struct<text, phrases: array<struct<text, words, separated>>>>.

    separated: whether the phrase's last visible word parts phrases.
    """
    told = kernels.parsed(kernels.cutter(SENTENCE_END), kernels.cutter(PHRASE_END), PHRASE_SEPARATORS)

    @F.arrow_udf("array<struct<text:string,phrases:array<struct<text:string,words:array<string>,separated:boolean>>>>")
    def kernel(texts: pa.Array) -> pa.Array:
        return told(texts)

    return kernel(s)


# What ends a sentence for masked_enders().
MASKED = "[.。?？!！|]"


def masked_enders(s: Column, mask: str = "_") -> Column:
    """A text whose words (pieces between white space that hold a letter or digit) have their inner sentence enders masked; a word's last sign stays."""
    if len(mask) != 1:
        raise ValueError("a mask is one sign")
    pieces = F.regexp_extract_all(s, F.lit(r"(\s+|\S+)"), 1)
    inner = lambda w: F.concat(F.regexp_replace(F.substr(w, F.lit(1), F.length(w) - 1), MASKED, "\\" + mask), F.right(w, F.lit(1)))
    return F.array_join(F.transform(pieces, lambda w: F.when(is_word(w), inner(w)).otherwise(w)), "")


def includes_any(s: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | s.contains(p)
    return found


def index_of_any(s: Column, parts) -> Column:
    """The place, from 0, of the first listed part that occurs; -1 if none does."""
    return F.coalesce(*[F.nullif(F.instr(s, p), F.lit(0)) - 1 for p in parts], F.lit(-1)).cast("int")


def starts_with_any(s: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | s.startswith(p)
    return found


def leading_zeros(n: Column, width: int) -> Column:
    """A whole number with zeros before it; longer ones stay whole."""
    return F.format_string(f"%0{width}d", F.floor(n).cast("long"))


def quoted_list(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def code_points(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


def utf16_starts(s: Column) -> Column:
    """For each code point, and the end, its place in UTF-16 units."""
    wide = F.filter(F.transform(code_points(s), lambda c, i: F.when(c > 0xFFFF, i)), lambda i: i.isNotNull())
    before = lambda places: F.transform(F.sequence(F.lit(0), F.length(s)), lambda i: i + F.size(F.filter(places, lambda p: p < i)))
    return let(wide, lambda places: F.when(F.size(places) == 0, F.sequence(F.lit(0), F.length(s))).otherwise(before(places)))


def has_invalid_codepoint(s: Column) -> Column:
    return s.contains("�")


def simplify_punctuation(s: Column) -> Column:
    return substitute_characters(s, PUNCTUATION)


def substitute_characters(s: Column, table: dict[str, str]) -> Column:
    return F.translate(s, "".join(table), "".join(table.values()))


def substitute_string(s: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(pairs[s], s)


def escape_angle_brackets(s: Column) -> Column:
    """& first, so that nothing is escaped twice."""
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def file_stem(path: Column) -> Column:
    """Name and extended extension (from the first dot on) of a path's last part."""
    name = base_name(path)
    return F.struct(F.regexp_extract(name, r"^(.[^.]*)", 1).alias("name"), F.regexp_extract(name, r"^.[^.]*\.(.*)$", 1).alias("extension"))


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/+[^/]*/*$", 1)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def name_without_extension(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parsed_path(path: Column) -> Column:
    return F.struct(dir_name(path).alias("dir"), base_name(path).alias("base"), name_without_extension(path).alias("name"), F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1).alias("ext"))


def joined_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), r"/(?:\./|/)+", "/")


# spoken forms of years, decades and money

def spoken_year(y: Column) -> Column:
    """1995: 19 95; 1905: 19 oh 5; other texts stay."""
    head, tail = F.substring(y, 1, 2), F.substring(y, 3, 2)
    four = y.rlike(r"^[0-9]{4}$")
    plain = four & (F.substring(y, 3, 1) != "0") & (head != "00")
    oh = four & (F.substring(y, 3, 1) == "0") & (F.substring(y, 4, 1) != "0") & (F.substring(y, 2, 1) != "0")
    return F.when(plain, F.concat_ws(" ", head, tail)).when(oh, F.concat(head, F.lit(" oh "), F.substring(y, 4, 1))).otherwise(y)


def spoken_decade(d: Column) -> Column:
    """1980s: 19 80s; 1900s: 19 hundreds; 2000s and other texts stay."""
    head, tail = F.substring(d, 1, 2), F.substring(d, 3, 2)
    four = d.rlike(r"^[0-9]{3}0s$")
    return F.when(four & (tail != "00"), F.concat(head, F.lit(" "), tail, F.lit("s"))).when(four & (F.substring(d, 2, 1) != "0"), F.concat(head, F.lit(" hundreds"))).otherwise(d)


# Currency signs and their spoken names.
CURRENCIES = {
    "$": "dollars", "¥": "yen", "€": "euros", "£": "pounds", "₩": "won", "₭": "kip", "₽": "rubles", "₫": "dong", "฿": "baht", "¢": "cents", "₮": "tögrög", "؋": "afghanis", "₦": "naira", "₱": "pesos", "₴": "hryvnia", "₪": "shekels",
}


def spoken_money(s: Column) -> Column:
    """A sign before or after an amount becomes its name after it, behind a following million, billion or trillion."""
    out = s
    for sign, name in CURRENCIES.items():
        mark = f"\\{sign}" if sign == "$" else sign
        out = F.regexp_replace(out, rf"{mark}\s?([0-9]+(?:[.,][0-9]+)*)((?: (?:million|billion|trillion))?)", f"$1$2 {name}")
        out = F.regexp_replace(out, rf"([0-9]+(?:[.,][0-9]+)*)\s?{mark}", f"$1 {name}")
    return out


# language codes

# The dialect a bare language code stands for.
DEFAULT_DIALECTS = {"en": "en-US", "ar": "ar-EG", "de": "de-DE", "es": "es-ES", "fr": "fr-FR", "it": "it-IT", "pt": "pt-BR", "zh": "zh-CN"}
LANGUAGE_NAMES = {"ar": "Arabic", "de": "German", "en": "English", "es": "Spanish", "fr": "French", "it": "Italian", "ja": "Japanese", "nl": "Dutch", "pt": "Portuguese", "ru": "Russian", "zh": "Chinese"}
LCIDS = {"en-US": 1033, "en-GB": 2057, "de-DE": 1031, "fr-FR": 1036, "es-ES": 3082, "it-IT": 1040, "pt-BR": 1046, "zh-CN": 2052, "ja-JP": 1041, "ru-RU": 1049, "nl-NL": 1043, "ar-EG": 3073}
THREE_LETTERS = {"ara": "ar", "deu": "de", "eng": "en", "spa": "es", "fra": "fr", "ita": "it", "jpn": "ja", "nld": "nl", "por": "pt", "rus": "ru", "zho": "zh"}


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def short_language_code(c: Column) -> Column:
    """The part before a dash in lower case; a code without one stays as it is."""
    return F.when(F.instr(c, "-") > 0, F.lower(F.substring_index(c, "-", 1))).otherwise(c)


def normal_language_code(c: Column) -> Column:
    parts = F.split(c, "-")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(F.upper(p))), "-")


def default_dialect(c: Column) -> Column:
    return F.coalesce(lookup(DEFAULT_DIALECTS, c), c)


def language_name(c: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_NAMES, short_language_code(c)), F.lit("Unknown"))


def language_with_name(c: Column, style: int = 1) -> Column:
    return F.concat(language_name(c), F.lit(" ("), c, F.lit(")")) if style == 1 else F.concat(c, F.lit(", "), language_name(c))


def parsed_language(c: Column) -> Column:
    """The two-letter code of a name, a three-letter or a two-letter code, in any case; null if it is unknown."""
    by_name = lookup({n.lower(): k for k, n in LANGUAGE_NAMES.items()}, F.lower(c))
    short = F.lower(F.substring_index(c, "-", 1))
    return F.coalesce(by_name, lookup(THREE_LETTERS, F.lower(c)), F.when(short.isin(list(LANGUAGE_NAMES)), short))


def lcid(c: Column) -> Column:
    return lookup(LCIDS, c)


def codes_of_lcid(n: Column) -> Column:
    table: dict[int, list[str]] = {}
    for code, number in LCIDS.items():
        table.setdefault(number, []).append(code)
    return F.create_map(*[x for number, codes in table.items() for x in (F.lit(number), F.array(*map(F.lit, codes)))])[n]


def translation_code(c: Column) -> Column:
    return F.when(c == "zh", "zh-CN").when(c == "he", "iw").when(c == "jv", "jw").otherwise(c)


# phones

# Classes of phones.
PHONES = {
    "plosive": "p b t d ʈ ɖ c ɟ k g q ɢ ʔ ɡ", "nasal": "m ɱ n ɳ ɲ ŋ ɴ n̩", "trill": "ʙ r ʀ", "tap": "ⱱ ɾ ɽ",
    "fricative": "ɸ β f v θ ð s z ʃ ʒ ʂ ʐ ç ʝ x ɣ χ ʁ ħ ʕ h ɦ", "lateral_fricative": "ɬ ɮ", "affricate": "tʃ ʈʃ dʒ", "approximant": "ʋ ɹ ɻ j ɰ w",
    "lateral_approximant": "l ɭ ʎ ʟ",
    "vowel": "i yɨ ʉɯ u iː ɪ ʏ ʊ ɨ ᵻ e ø ɘ ɵ ɤ o ə oː ɛ œ ɜ ɞ ʌ ɔ ɜː uː ɔː ɛː æ a ɶ ɐ ɑ ɒ ɑː ◌˞ ɚ ɝ ɹ̩ eɪ əʊ oʊ aɪ ɔɪ aʊ iə ɜr ɑr ɔr oʊr oːɹ ir ɪɹ ɔːɹ ɑːɹ ʊɹ ʊr ɛr ɛɹ əl aɪɚ aɪə",
}
FAMILIES = {"plosive_or_nasal": ("plosive", "nasal"), "trill_tap_or_flap": ("trill", "tap"), "fricative_like": ("fricative", "lateral_fricative", "affricate"), "approximant_like": ("approximant", "lateral_approximant")}


def phones(*kinds: str) -> list[str]:
    return [p for k in kinds for p in PHONES[k].split()]


def is_phone(s: Column, *kinds: str) -> Column:
    return s.isin(phones(*kinds))


def is_vowel(s: Column) -> Column:
    return is_phone(s, "vowel")


def is_consonant(s: Column) -> Column:
    return is_phone(s, *(k for k in PHONES if k != "vowel"))


def is_known_phone(s: Column) -> Column:
    """A vowel, a consonant or the blank."""
    return (s == " ") | is_phone(s, *PHONES)


def phone_cost(a: Column, b: Column, level: int = 1) -> Column:
    """Cost of putting one phone for another. 1: 0 or 1. 2: 0.5 within vowels or within consonants. 3: 0.75 within vowels, 0.5 within a family of consonants, 0.75 within other consonants. Levels 2 and 3 refuse unknown phones."""
    same = F.when(a == b, 0.0)
    if level == 1:
        return same.otherwise(1.0)
    unknown = lambda s: F.raise_error(F.concat(F.lit("not a known phone: "), s)).cast("double")
    known = F.when(~is_known_phone(a), unknown(a)).when(~is_known_phone(b), unknown(b)).when(a == b, 0.0)
    vowels, consonants = is_vowel(a) & is_vowel(b), is_consonant(a) & is_consonant(b)
    if level == 2:
        return known.when(vowels | consonants, 0.5).otherwise(1.0)
    family = F.lit(False)
    for kinds in FAMILIES.values():
        family = family | (is_phone(a, *kinds) & is_phone(b, *kinds))
    return known.when(vowels, 0.75).when(family, 0.5).when(consonants, 0.75).otherwise(1.0)


def subphones(tokens: Column, n: int = 3) -> Column:
    """token/1 to token/n for each; a pause stays one."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t == "pause", F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(t, F.lit("/"), i.cast("string"))))))


REPEATS = T.StructType([T.StructField("longest", T.IntegerType()), T.StructField("cycles", T.DoubleType())])


@F.pandas_udf(REPEATS)
def repetition(tokens: pd.Series) -> pd.DataFrame:
    """(longest, cycles): for each cycle length up to half the tokens, how long they repeat from the start on, and the largest number of cycles.

    The lengths of all those repeats are the sequence's Z-values, found in one pass.
    """

    def one(row) -> tuple[int, float]:
        if row is None or len(row) < 2:
            return 0, 0.0
        places: dict = {}
        x = [places.setdefault(t, len(places)) for t in row]
        n, z, left, right = len(x), [0] * len(x), 0, 0
        for i in range(1, n // 2 + 1):
            same = min(right - i, z[i - left]) if i < right else 0
            while i + same < n and x[same] == x[i + same]:
                same += 1
            z[i] = same
            if i + same > right:
                left, right = i, i + same
        found = [(z[c], z[c] / c + 1) for c in range(1, n // 2 + 1)]
        return max(m for m, _ in found), max(c for _, c in found)

    return pd.DataFrame(tokens.map(one).tolist(), columns=["longest", "cycles"])
