"""Spoken fragments and bounded pieces against loops over words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvana.functions import fragments as f
from corvana.functions import texts


def year(w):
    head, tail = int(w[:2]), int(w[2:])
    if head and tail >= 10:
        return f"{w[:2]} {tail}"
    return f"{head} oh {tail}" if head % 10 and 0 < tail < 10 else w


def decade(w):
    return f"{w[:2]} {w[2:4]}s" if w[2:4] != "00" else f"{w[:2]} hundreds" if int(w[:2]) % 10 else w


def brute(words):
    """[normalized, reference] of each fragment, one word after the other."""
    visible = [(w, n) for n, w in enumerate(words) if w.strip()]
    at, out = 0, []
    while at < len(visible):
        w, n = visible[at]
        after = visible[at + 1][0] if at + 1 < len(visible) else ""
        spaced = n + 1 < len(words) and not words[n + 1].strip()
        sign = next((s for s in f.CURRENCIES if s in w), None)
        if w.lower() in f.YEAR_CUES and spaced and re.fullmatch("[0-9]{4}", after):
            out += [(w, w), (year(after), after)]
            at += 2
        elif w.lower() in f.DECADE_CUES and spaced and re.fullmatch("[0-9]{3}0s", after):
            out += [(w, w), (decade(after), after)]
            at += 2
        elif re.fullmatch("[0-9]{4}[-–][0-9]{4}", "".join(words[n : n + 3])):
            out += [(year(w), w), ("to", words[n + 1]), (year(words[n + 2]), words[n + 2])]
            at += 3
        elif sign and re.fullmatch(re.escape(sign) + "[0-9][0-9,.]*", w):
            scaled = after.lower() in f.SCALES
            out.append((f"{w[1:]} {after} {f.CURRENCIES[sign]}", f"{w} {after}") if scaled else (f"{w[1:]} {f.CURRENCIES[sign]}", w))
            at += 1 + scaled
        elif sign and re.fullmatch("[0-9][0-9,.]*" + re.escape(sign), w):
            out.append((f"{w[:-1]} {f.CURRENCIES[sign]}", w))
            at += 1
        else:
            out.append((w, w))
            at += 1
    return out


def test_normalized_against_loop(spark):
    rng = random.Random(5)
    parts = ["in", "In", "the", "a", "1995", "1905", "2000", "0099", "1980s", "1900s", "2000s", "-", "–", "1835", "$5", "$53.1", "€3,50", "7£", "2.5", "million", "Billion", "words", ".", "©", "May"]
    texts_ = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["1835-1896-1900-1910-1920", "in 1835-1896-1900", "the 1980s", "", None, "£3"]
    df = spark.createDataFrame([(i, t, "en-GB") for i, t in enumerate(texts_)], "id long, text string, lang string")
    words = f.spoken_words(F.col("text"))
    hits = 0
    for r in df.select("id", "text", words.alias("w"), f.normalized_fragments(words, F.col("lang")).alias("f"), f.normalized_fragments(words, F.lit("fr")).alias("other")).collect():
        if r.text is None:
            assert r.f is None
            continue
        assert "".join(r.w) == r.text
        expected = brute(r.w)
        assert [(x.normalized, x.reference) for x in r.f] == expected
        hits += sum(a != b for a, b in expected)
        visible = [w for w in r.w if w.strip()]
        # each visible word belongs to one fragment, in order
        assert [n for x in r.f for n in range(x.first, x.first + x["count"])] == list(range(len(visible)))
        assert all(x.reference == " ".join(visible[x.first : x.first + x["count"]]) for x in r.f)
        assert [(x.normalized, x.reference) for x in r.other] == [(w, w) for w in visible]
    assert hits > 300


def packed(sentences, most, whole_sentences, whole_phrases):
    """Pieces as lists of what was placed in each."""
    out, held = [], []
    size = lambda: sum(map(len, held))

    def close():
        if held:
            out.append(held[:])
            held.clear()

    for s in sentences:
        if whole_sentences and size() + len(s["text"]) > most:
            close()
        if size() + len(s["text"]) <= most:
            held.append(s["text"])
            continue
        for p in s["phrases"]:
            if whole_phrases and size() + len(p["text"]) > most:
                close()
            if size() + len(p["text"]) <= most:
                held.append(p["text"])
                continue
            for w in p["words"]:
                if size() + len(w) > most:
                    close()
                held.append(w)
    close()
    return out


@pytest.mark.parametrize(("sentences", "phrases"), [(True, True), (False, True), (True, False), (False, False)])
@pytest.mark.parametrize("most", [12, 40])
def test_fragments_against_loop(spark, sentences, phrases, most):
    rng = random.Random(most)
    draw = lambda: "".join(rng.choice(["ab", "cdefg", "é", "longword", "x"]) + rng.choice([" ", " ", ", ", ". ", "! ", ": ", "\n"]) for _ in range(rng.randint(0, 40)))
    df = spark.createDataFrame([(i, draw()) for i in range(120)] + [(500, ""), (501, None), (502, "one")], "id long, text string")
    for r in df.select("text", texts.parsed(F.col("text")).alias("p"), f.fragments(F.col("text"), most, sentences, phrases).alias("f")).collect():
        if r.text is None:
            assert r.f is None
            continue
        expected = packed(r.p, most, sentences, phrases)
        assert [x.text for x in r.f] == ["".join(x) for x in expected]
        assert [x["last"] for x in r.f] == [x[-1] for x in expected]
        assert "".join(x.text for x in r.f) == r.text and all(len(x.text) <= most for x in r.f)
        assert [x.start for x in r.f] == [sum(len(y.text) for y in r.f[:n]) for n in range(len(r.f))]


def test_too_long_a_word(spark):
    with pytest.raises(Exception, match="a word of length 9 exceeds 5"):
        spark.createDataFrame([("abcdefghi",)], "text string").select(f.fragments(F.col("text"), 5)).collect()


def test_masked_enders(spark):
    rows = [("e.g. this. And 3.5! a.b.c", "e_g. this. And 3_5! a_b_c"), ("... ?! x|y|", "... ?! x_y|"), ("", ""), (None, None), ("a。b？\n c", "a_b？\n c")]
    assert [r.m for r in spark.createDataFrame([(r[0],) for r in rows], "t string").select(texts.masked_enders(F.col("t")).alias("m")).collect()] == [r[1] for r in rows]


def test_lexicon_files(spark, tmp_path):
    import json

    from corvana.sources.lexicons import read_lexicons

    first = {"en": {"Read": [{"pronunciation": {"espeak": {"en-us": "r iː d", "en": "r i d"}}, "precededBy": ["to"]}, {"pronunciation": {"espeak": {"en": "r ɛ d"}}, "succeededBy": ["it"]}], "none": {"pos": ["noun"]}}, "de": {"x": {"pronunciation": {"espeak": {"de": "x"}}}}}
    second = {"en": {"read": {"pronunciation": {"espeak": {"en-us": "own"}}, "notFollowedBy": ["me"], "notSucceededBy": ["you"]}}}
    paths = []
    for n, lexicon in enumerate((first, second)):
        (tmp_path / f"{n}.json").write_text(json.dumps(lexicon, indent=1, ensure_ascii=False))
        paths.append(str(tmp_path / f"{n}.json"))
    found = sorted((tuple(r) for r in read_lexicons(spark, paths, "en", "en-us").collect()), key=repr)
    assert found == [("read", 0, "own", None, None, None, ["me"], 1), ("read", 0, "r iː d", ["to"], None, None, None, 0), ("read", 1, "r ɛ d", None, None, ["it"], None, 0)]
    assert read_lexicons(spark, paths, "fr").count() == 0
