"""Phone alphabets: ARPAbet and TIMIT to IPA, and IPA to TIMIT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvana.functions.texts import subphones

# ARPAbet phones and their IPA forms; what TIMIT adds to them or changes; IPA phones as TIMIT tokens.
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AH0": "ə", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɝ", "ER0": "ɚ", "EY": "eɪ", "IH": "ɪ", "IH0": "ɨ", "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u",
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "EL": "l̩ ", "EM": "m̩", "EN": "n̩", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "Q": "ʔ", "R": "ɹ", "S": "s", "SH": "ʃ",
    "T": "t", "TH": "θ", "V": "v", "W": "w", "WH": "ʍ", "Y": "j", "Z": "z", "ZH": "ʒ",
}
TIMIT = {
    "AX": "ə", "AX-H": "ə̥", "AXR": "ɚ", "B": "", "BCL": "b", "D": "", "DCL": "d", "DX": "ɾ", "ENG": "ŋ̍", "EPI": "", "G": "", "GCL": "g", "HV": "ɦ", "H//": "", "IX": "ɨ", "KCL": "k", "K": "", "NX": "ɾ̃", "P": "", "PAU": "", "PCL": "p",
    "T": "", "TCL": "t", "UX": "ʉ",
}
IPA_TO_TIMIT = {
    "ɑ": "aa", "ɑː": "aa", "ɑːɹ": "aa r", "a": "aa", "aʊ": "aw", "aɪ": "ay", "aɪɚ": "ay r", "aɪə": "ay ax", "æ": "ae", "æʊ": "ae uh", "ʌ": "ah", "ɐ": "ah", "ə": "ax", "ə̥": "ax-h", "əʊ": "ax uh", "ɚ": "axr", "ᵻ": "ax",
    "ɔ": "ao", "ɔː": "ao", "ɔːɹ": "ao r", "ɔɪ": "oy", "ɒ": "ao", "ɛ": "eh", "ɜː": "eh", "ɝ": "er", "ɛɹ": "er", "eɪ": "ey", "eə": "ey ax", "eː": "ey", "ɪ": "ih", "ɪɹ": "ih r", "ɨ": "ix", "i": "iy", "iː": "iy", "iə": "iy ax",
    "oʊ": "ow", "oː": "ow", "oːɹ": "ow r", "ʊ": "uh", "ʊɹ": "uh r", "ʊə": "uh ax", "u": "uw", "uː": "uw",
    "b": "bcl b", "tʃ": "tcl ch", "d": "dcl d", "ð": "dh", "l̩": "el", "əl": "el", "m̩": "em", "n̩": "en", "f": "f", "ɡ": "gcl g", "h": "hh", "dʒ": "dcl jh", "k": "kcl k", "l": "l", "m": "m", "n": "n", "ŋ": "ng", "p": "pcl p",
    "ʔ": "q", "ɹ": "r", "s": "s", "ʃ": "sh", "t": "tcl t", "θ": "th", "v": "v", "w": "w", "ʍ": "wh", "j": "y", "z": "z", "ʒ": "zh", "ɾ̃": "nx", "ʉ": "ux", "ɦ": "hv", "ŋ̍": "eng", "ɾ": "dx",
}


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def arpabet_to_ipa(phone: Column) -> Column:
    """In any case; null for unknown phones."""
    return looked_up(ARPABET, F.upper(phone))


def timit_to_ipa(phone: Column) -> Column:
    """In any case; null for unknown phones. A release has no letter of its own, its closure has."""
    return looked_up(ARPABET | TIMIT, F.upper(phone))


def ipa_to_timit(phone: Column, parts: int = 0) -> Column:
    """The tokens of a phone, each in so many parts if any; null for unknown phones."""
    tokens = F.split(looked_up(IPA_TO_TIMIT, phone), " ")
    return F.when(tokens.isNotNull(), subphones(tokens, parts)) if parts else tokens


def ipa_word_to_timit(word: Column, parts: int = 0) -> Column:
    """The tokens of a word's letters, one after the other; null if a letter has none."""
    letters = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: ipa_to_timit(c, parts))
    return F.when(~F.exists(letters, lambda t: t.isNull()), F.flatten(letters))
