"""Arrow kernels for folds over a text's words, which expressions over arrays do word by word, interpreted.

Each takes a batch's rows in runs of ROWS and gives Arrow's own columns. Patterns are those of texts.py as
Python has them: letters, marks and digits by Unicode class, white space in ASCII.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa

ROWS = 256


def marks() -> str:
    """\\p{M} as ranges within a class."""
    found, start = [], None
    for n in range(sys.maxunicode + 2):
        is_mark = n <= sys.maxunicode and unicodedata.category(chr(n))[0] == "M"
        if is_mark and start is None:
            start = n
        elif not is_mark and start is not None:
            found.append(f"\\U{start:08x}-\\U{n - 1:08x}")
            start = None
    return "".join(found)


BLANK = " \\t\\n\\x0b\\f\\r"
MARKS = marks()
#: \w is letters, digits and the underscore, which is a sign here.
INNER = rf"(?:[^\W_]|[{MARKS}])+"
ALL_WORDS = re.compile(rf"{INNER}(?:['’]{INNER})*|[{BLANK}]+|[^{BLANK}]").findall
VISIBLE = re.compile("[^\\s\\ufeff]|[\\x1c-\\x1f]").search  # Java's white space has no separators of files and records


def cutter(ends: str) -> Callable[[str], list[str]]:
    """texts.cut_after() of a text."""
    marked = re.compile(f"({ends})", re.ASCII).sub
    return lambda text: [x for x in marked("\\1\x01", text).split("\x01") if x]


def by_rows(build: Callable[..., pa.Array], *given: pa.Array) -> pa.Array:
    return pa.concat_arrays([build(*[x.slice(at, ROWS) for x in given]) for at in range(0, max(1, len(given[0])), ROWS)])


def listed(values: pa.Array, sizes: list[int | None]) -> pa.ListArray:
    """Lists of so many of the values; null for null."""
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + (n or 0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([n is None for n in sizes], pa.bool_()))


def struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def parsed(sentences, phrases, separators: tuple[str, ...]) -> Callable[[pa.Array], pa.Array]:
    def build(texts: pa.Array) -> pa.Array:
        n_s, s_text, n_p, p_text, n_w, separated, w_text = [], [], [], [], [], [], []
        for text in texts.to_pylist():
            if text is None:
                n_s.append(None)
                continue
            found = sentences(text)
            n_s.append(len(found))
            s_text += found
            for sentence in found:
                parts = phrases(sentence)
                n_p.append(len(parts))
                p_text += parts
                for part in parts:
                    words = ALL_WORDS(part)
                    n_w.append(len(words))
                    w_text += words
                    separated.append(next((w for w in reversed(words) if VISIBLE(w)), "") in separators)
        words = listed(pa.array(w_text, pa.string()), n_w)
        inner = listed(struct(text=pa.array(p_text, pa.string()), words=words, separated=pa.array(separated, pa.bool_())), n_p)
        return listed(struct(text=pa.array(s_text, pa.string()), phrases=inner), n_s)

    return lambda texts: by_rows(build, texts)


def fragments(sentences, phrases, most: int, whole_sentences: bool, whole_phrases: bool) -> Callable[[pa.Array], pa.Array]:
    def ends(text: str) -> list[tuple[int, int]]:
        """(end, place of what was put in last) of each piece."""
        out, at, used, last = [], 0, 0, 0

        def put(length: int, opens: bool) -> None:
            nonlocal at, used, last
            if opens:
                out.append((at, last))
                used = 0
            last, at, used = at, at + length, used + length

        for sentence in sentences(text):
            begun, s = used, len(sentence)
            if used + s <= most:
                put(s, False)
                continue
            if whole_sentences:
                if used and s <= most:
                    put(s, True)
                    continue
                begun = 0
            for part in phrases(sentence):
                p = len(part)
                if begun + p <= most:
                    put(p, begun != used)
                    begun = used
                    continue
                if whole_phrases:
                    if begun and p <= most:
                        put(p, True)
                        begun = used
                        continue
                    begun = 0
                for word in ALL_WORDS(part):
                    w = len(word)
                    if w > most and begun + w > most:
                        raise ValueError(f"a word of length {w} exceeds {most}")
                    put(w, begun != used or begun + w > most)
                    begun = used
        return [*out, (at, last)] if at else out

    def build(texts: pa.Array) -> pa.Array:
        sizes, piece, start, tail = [], [], [], []
        for text in texts.to_pylist():
            if text is None:
                sizes.append(None)
                continue
            found, begin = ends(text), 0
            sizes.append(len(found))
            for end, last in found:
                piece.append(text[begin:end])
                start.append(begin)
                tail.append(text[last:end])
                begin = end
        return listed(struct(text=pa.array(piece, pa.string()), start=pa.array(start, pa.int32()), last=pa.array(tail, pa.string())), sizes)

    return lambda texts: by_rows(build, texts)


def normalized(year_cues, decade_cues, scales, signs: str, year: Callable[[str], str], decade: Callable[[str], str], currencies: dict[str, str]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """fragments.normalized_fragments() of (words, whether they are English)."""
    amount = "[0-9][0-9,.]*"
    is_year, is_decade, is_range = (re.compile(p).fullmatch for p in ("[0-9]{4}", "[0-9]{3}0s", "[0-9]{4}[-–][0-9]{4}"))
    before, behind = re.compile(f"[{signs}]{amount}").fullmatch, re.compile(f"{amount}[{signs}]").fullmatch
    year_cues, decade_cues, scales, digits = frozenset(year_cues), frozenset(decade_cues), frozenset(scales), frozenset("0123456789")

    def told(w: list[str], spaced: list[bool], i: int) -> list[tuple[str, str, int, int]]:
        """The fragments of the rule that fits word i; none for none."""
        word, first, n = w[i], w[i][:1], len(w)
        after = w[i + 1] if i + 1 < n else ""
        low = word.lower() if spaced[i] and after[:1] in digits else ""
        if low in year_cues and is_year(after):
            return [(word, word, i, 1), (year(after), after, i + 1, 1)]
        if low in decade_cues and is_decade(after):
            return [(word, word, i, 1), (decade(after), after, i + 1, 1)]
        if first in digits and i + 2 < n and not spaced[i] and not spaced[i + 1] and is_range(word + after + w[i + 2]):
            return [(year(word), word, i, 1), ("to", after, i + 1, 1), (year(w[i + 2]), w[i + 2], i + 2, 1)]
        if first in currencies and before(word):
            if after.lower() in scales:
                return [(f"{word[1:]} {after} {currencies[first]}", f"{word} {after}", i, 2)]
            return [(f"{word[1:]} {currencies[first]}", word, i, 1)]
        if first in digits and word[-1] in currencies and behind(word):
            return [(f"{word[:-1]} {currencies[word[-1]]}", word, i, 1)]
        return []

    marks = digits | frozenset(currencies)  # a rule's words, or the word after a cue, begin with one

    def build(words: pa.Array, english: pa.Array) -> pa.Array:
        sizes, said, written, firsts, counts = [], [], [], [], []
        flat, end = words.flatten().to_numpy(zero_copy_only=False).tolist(), 0

        def plain(w: list[str], start: int, end: int) -> None:
            said.extend(w[start:end])
            written.extend(w[start:end])
            firsts.extend(range(start, end))
            counts.extend([1] * (end - start))

        for length, is_english in zip(words.value_lengths().to_pylist(), english.to_pylist(), strict=True):
            if length is None:
                sizes.append(None)
                continue
            every, end, size, i = flat[end : end + length], end + length, len(said), 0
            seen = [not (x.isspace() or x[:1] == "\ufeff") or VISIBLE(x) is not None for x in every]
            w = [x for x, v in zip(every, seen, strict=True) if v]
            if is_english:
                spaced = [not after for v, after in zip(seen, [*seen, True][1:], strict=True) if v]
                for hot in [n for n, x in enumerate(w) if x[0] in marks]:
                    for at in (hot - 1, hot):
                        found = told(w, spaced, at) if at >= i else []
                        if found:
                            plain(w, i, at)
                            for columns, values in zip((said, written, firsts, counts), zip(*found, strict=True), strict=True):
                                columns.extend(values)
                            i = at + sum(f[3] for f in found)
            plain(w, i, len(w))
            sizes.append(len(said) - size)
        return listed(struct(normalized=pa.array(said, pa.string()), reference=pa.array(written, pa.string()), first=pa.array(firsts, pa.int32()), count=pa.array(counts, pa.int32())), sizes)

    return lambda words, english: by_rows(build, words, english)


def spoken_year(y: str) -> str:
    """texts.spoken_year() of four digits."""
    if y[2] != "0" and y[:2] != "00":
        return f"{y[:2]} {y[2:]}"
    return f"{y[:2]} oh {y[3]}" if y[2] == "0" and y[3] != "0" and y[1] != "0" else y


def spoken_decade(d: str) -> str:
    """texts.spoken_decade() of a decade."""
    if d[2:4] != "00":
        return f"{d[:2]} {d[2:4]}s"
    return f"{d[:2]} hundreds" if d[1] != "0" else d
