"""Text kernels against the classes and rules of Spark's expressions."""

from time import process_time

import pyarrow as pa
from pyspark.sql import functions as F

from corvana.functions import fragments, kernels, texts


def test_words_of_every_class(spark):
    """Python's classes cut as Java's do: letters, marks, digits, underscores, apostrophes and white space of all kinds."""
    signs = [chr(n) for n in range(1, 0x3000) if n not in (0x85, 0x2028, 0x2029)] + ["日本。", "_a_b", "it's’s '", "a\x1cb", "a b", "﻿", "½", "१", "é", "😀"]
    signs = [s for s in signs if len(s) > 1 or kernels.unicodedata.category(s) != "Cn"]
    df = spark.createDataFrame([(n, f"a{s}1 {s}{s}") for n, s in enumerate(signs)], "n int, t string")
    known = df.where(~F.col("t").rlike(r"\p{Cn}"))  # Python's Unicode is newer than Java's
    differ = [(r.t, r.w) for r in known.select("t", texts.all_words(F.col("t")).alias("w")).collect() if kernels.ALL_WORDS(r.t) != r.w]
    assert not differ and known.count() > 9_000
    blank = {r.t[1:-1]: r.b for r in spark.createDataFrame([(f"<{s}>",) for s in signs], "t string").select("t", texts.is_blank(F.expr("substring(t, 2, length(t) - 2)")).alias("b")).collect()}
    assert not [s for s, b in blank.items() if (kernels.VISIBLE(s) is None) != b]


def test_kernels_are_fast():
    """A megabyte in under a second each; expressions took about 2.4."""
    text = "In 1995 the 1980s, it's said; 1914-1918 cost $3 million or 5€ and so on for a while. " * 12_000
    split = kernels.cutter(texts.SENTENCE_END), kernels.cutter(texts.PHRASE_END)
    words = pa.array([kernels.ALL_WORDS(text)])
    rules = kernels.normalized(fragments.YEAR_CUES, fragments.DECADE_CUES, fragments.SCALES, fragments.SIGNS, kernels.spoken_year, kernels.spoken_decade, texts.CURRENCIES)
    begun = process_time()
    assert len(kernels.parsed(*split, texts.PHRASE_SEPARATORS)(pa.array([text]))[0]) == 12_000
    assert "".join(p["text"].as_py() for p in kernels.fragments(*split, 90, True, True)(pa.array([text]))[0]) == text
    assert len(rules(words, pa.array([True]))[0]) > 12_000
    assert process_time() - begun < 5
