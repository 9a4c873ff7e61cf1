"""Functions on edge cases: empty, null, ties, signs, and round trips."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvana.functions import encodings as e
from corvana.functions import randoms, signals
from corvana.functions import texts as t
from corvana.functions import times as s
from corvana.functions import vectors as v


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


@pytest.mark.parametrize(("f", "values", "expected"), [
    (v.mean, (), 0.0), (v.upper_median, (1, 2, 3, 4), 3.0), (v.index_of_max, (), -1), (v.index_of_max, (1, 3, 3), 1), (v.index_of_min, (2, 1, 1), 1),
    (v.z_scores, (5, 5, 5), [0.0, 0.0, 0.0]), (v.scale_to_sum_1, (7,), [1.0]), (v.scale_to_sum_1, (-1, 1), [0.25, 0.75]), (v.scale_to_sum_1, (0, 0), [0.0, 0.0]),
    (v.moving_average_3, (0, 3, 6), [1.0, 3.0, 5.0]), (lambda a: v.median_filter(a, 3), (9, 1, 5), [9.0, 5.0, 5.0]), (lambda a: v.median_filter(a, 5), (1, 2), [1.0, 2.0]),
    (lambda a: v.top_k_indexes(a, 2), (1, 5, 5), [1, 2]), (lambda a: v.variance(a, True), (4,), 0.0), (lambda a: v.euclidean(a, a), (), 0.0),
    (lambda a: v.cosine_similarity(a, a), (0, 0), 0.0), (v.deltas, (0.5, 1.2, 3.9), [0.0, 1.0, 2.0]), (lambda a: v.split_parts(a, 2), (1, 2, 3), [[1.0, 2.0], [3.0]]),
])
def test_vectors(spark, f, values, expected):
    assert one(spark, f(arr(*values))) == expected


def test_rounding_and_ranges(spark):
    assert one(spark, v.round_half_up(F.lit(-2.5), 0)) == -2.0
    assert one(spark, v.whole_numbers(F.lit(3), F.lit(3))) == []
    assert one(spark, v.hamming(F.lit(5), F.lit(2))) == 3
    assert one(spark, v.transpose(F.array(arr(1, 2), arr(3, 4)))) == [[1.0, 3.0], [2.0, 4.0]]


@pytest.mark.parametrize(("f", "text", "expected"), [
    (t.is_blank, " \t ﻿", True), (t.is_word, "...", False), (t.is_word, "日", True), (t.includes_emoji, "a😀", True), (t.only_punctuation, "?!", True), (t.only_punctuation, "%", False),
    (t.is_phrase_separator, ",", True), (t.lines, "a\nb\n", ["a\n", "b\n"]), (lambda x: t.paragraphs(x, "double"), "a\nb\n\nc", ["a\nb\n\n", "c"]), (lambda x: t.paragraphs(x, "single"), "a\n\n\nb", ["a\n\n\n", "b"]),
    (t.words, "don't stop, now", ["don't", "stop", ",", "now"]), (t.utf16_length, "a😀", 3), (t.utf16_starts, "😀b", [0, 2, 3]), (t.simplify_punctuation, "“a”，", '"a",'),
    (t.spoken_year, "1995", "19 95"), (t.spoken_year, "1905", "19 oh 5"), (t.spoken_year, "2000", "2000"), (t.spoken_decade, "1980s", "19 80s"), (t.spoken_decade, "1900s", "19 hundreds"), (t.spoken_decade, "2000s", "2000s"),
    (t.spoken_money, "$5 million", "5 million dollars"), (t.spoken_money, "20€", "20 euros"), (t.short_language_code, "EN", "EN"), (t.short_language_code, "EN-us", "en"), (t.normal_language_code, "EN-us", "en-US"),
    (t.default_dialect, "pt", "pt-BR"), (t.language_name, "xx", "Unknown"), (t.parsed_language, "GERMAN", "de"), (t.parsed_language, "deu", "de"), (t.parsed_language, "??", None), (t.translation_code, "zh", "zh-CN"),
    (t.file_extension, "a/b.Tar.GZ", ".gz"), (t.dir_name, "/a/b/c.txt", "/a/b"), (t.name_without_extension, "x/.bashrc", ".bashrc"), (t.escape_angle_brackets, "<&>", "&lt;&amp;&gt;"),
])
def test_texts(spark, f, text, expected):
    assert one(spark, f(F.lit(text))) == expected


def test_phones(spark):
    cost = lambda a, b, n: one(spark, t.phone_cost(F.lit(a), F.lit(b), n))
    assert [cost("p", "p", 1), cost("p", "b", 1), cost("p", "s", 2), cost("p", "a", 2), cost("p", "m", 3), cost("p", "s", 3), cost("a", "e", 3), cost("a", "p", 3)] == [0, 1, 0.5, 1, 0.5, 0.75, 0.75, 1]
    assert one(spark, t.subphones(F.array(F.lit("a"), F.lit("pause")), 2)) == ["a/1", "a/2", "pause"]
    assert tuple(one(spark, t.repetition(F.split(F.lit("a b a b a b"), " ")))) == (4, 3.0)
    assert tuple(one(spark, t.repetition(F.split(F.lit("a"), " ")))) == (0, 0.0)


def test_encodings(spark):
    for text in ("", "a", "ab", "日本😀", "x" * 1000):
        assert one(spark, F.decode(e.unbase64(e.base64(e.utf8(F.lit(text)), padded=False)), "UTF-8")) == text
        assert one(spark, e.from_utf16(e.utf16(F.lit(text)))) == text
        assert one(spark, e.from_utf32(t.code_points(F.lit(text)))) == text
    assert one(spark, e.unescape_html(F.lit("&amp;lt; &#39;&quot;"))) == "&lt; '\""
    assert one(spark, e.ascii_bytes(F.lit("é"))) is None
    assert one(spark, e.from_windows_1252(F.lit(b"\x80\x81").cast("binary"))) == "€\x81"
    assert one(spark, e.murmur3_text(F.lit("abcde"))) == e.murmur3(b"abcde")
    assert e.murmur3(b"") == 0 and e.murmur3(b"hello") == 0x248BFA47
    assert one(spark, e.murmur3_int(F.lit(77))) == e.murmur3((77).to_bytes(4, "little"), 42)
    assert e.leb128(624485) == b"\xe5\x8e\x26" and e.leb128_signed(-123456) == b"\xc0\xbb\x78"
    for n in (0, 1, -1, 63, 64, -64, -65, 2**31 - 1, -(2**31)):
        assert e.from_leb128(e.leb128_signed(n), signed=True) == n
    metrics = one(spark, e.deflate_metrics(F.lit("abc" * 100)))
    assert metrics["raw"] == 300 and zlib.decompress(zlib.compress(b"x")) == b"x" and metrics["deflated"] < 30
    for width, signed, n in ((1, False, 200), (2, True, -2), (4, False, 4_000_000_000), (4, True, -5)):
        assert one(spark, e.little_endian(e.to_little_endian(F.lit(n), width), 0, width, signed)) == n
    x = np.array([0.0, 0.5, -1.0, 1.0, -0.25])
    for bits in (8, 16, 24, 32):
        assert np.abs(e.from_pcm(e.to_pcm(x, bits), bits) - x).max() <= 2.0 ** (1 - bits)


def test_times(spark):
    assert one(spark, s.format_hms(F.lit(3661.5))) == "01:01:01.500"
    assert one(spark, s.format_ms(F.lit(3661.5), ",")) == "61:01,500"
    assert one(spark, s.frames_in(F.lit(1.0), F.lit(0.5))) is None
    assert one(spark, s.gain_to_decibels(F.lit(0.0))) == -100.0 and one(spark, s.decibels_to_gain(F.lit(-100.0))) == 0.0
    assert abs(one(spark, s.mel_to_hertz(s.hertz_to_mel(F.lit(440.0)))) - 440) < 1e-9


def test_signals(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    back = signals.istft(signals.stft(x, 512, 400, 100), 512, 400, 100)
    n = min(len(back), len(x)) - 400
    assert np.abs(back[200:n] - x[200:n]).max() < 1e-6
    banks = signals.mel_filterbanks(40, 512, 16000, 133.3333, 6855.4976)
    assert banks.shape == (40, 257) and np.allclose(banks.sum(axis=1)[banks.sum(axis=1) > 0], 1)
    assert signals.mfcc(x).shape[1] == 13
    low = signals.filter_coefficients("lowpass", 16000, 1000, 0.7071)
    assert math.isclose((low["b0"] + low["b1"] + low["b2"]) / (1 + low["a1"] + low["a2"]), 1.0)
    high = signals.filter_coefficients("highpass", 16000, 1000, 0.7071)
    assert abs(high["b0"] + high["b1"] + high["b2"]) < 1e-12
    for kind in ("bandpass", "notch", "allpass", "peaking", "lowshelf", "highshelf"):
        assert set(signals.filter_coefficients(kind, 16000, 1000, 1.0, 3.0)) == {"b0", "b1", "b2", "a1", "a2"}
    assert math.isclose(signals.q_to_bandwidth(signals.bandwidth_to_q(1.5)), 1.5)
    stereo = F.array(arr(1, -0.5), arr(0.5, 0.5))
    assert one(spark, signals.downmixed(stereo)) == [0.75, 0.0]
    assert one(spark, signals.interleaved(stereo)) == [1.0, 0.5, -0.5, 0.5]
    assert one(spark, signals.channel_of(signals.interleaved(stereo), 2, 1)) == [0.5, 0.5]
    assert one(spark, signals.mixed(arr(1, 2, 3), arr(1, 1), -1.0)) == [0.0, 1.0]
    assert one(spark, signals.leading_silent(arr(0, 0, 1, 0), F.lit(0.1))) == 2
    assert one(spark, signals.leading_silent(arr(0, 0), F.lit(0.1))) == 1
    assert abs(max(map(abs, sum(one(spark, signals.normalized(stereo)), []))) - 10 ** (-3 / 20)) < 1e-9
    assert one(spark, signals.without_bias(F.array(arr(1, 3)))) == [[-1.0, 1.0]]


def test_randoms():
    a, b = randoms.XorShift32(5), randoms.XorShift32(5)
    assert [a.next_int32() for _ in range(5)] == [b.next_int32() for _ in range(5)]
    assert sorted(a.shuffled(list(range(20)))) == list(range(20))
    assert abs(np.mean(randoms.XorShift32(1).normals(4000))) < 0.1
    assert randoms.pick([0, 0, 1], a) == 2
    assert list(randoms.packed(["aa", "b", "ccc"], 4)) == [["aa", "b"], ["ccc"]]
    with pytest.raises(ValueError):
        list(randoms.packed(["abcdef"], 4))


def test_html_to_text(spark):
    from corvana.functions.markup import html_to_text

    page = "<html><head><title>T</title><style>p{}</style></head><body><p>One <b>two</b><br>three &amp; four</p><ul><li>x<li><a href='y'>y</a></ul><img src='z' alt='z'><script>no()</script><table><tr><td>c<td>d</table>end"
    assert one(spark, html_to_text(F.lit(page))) == "One two\nthree & four\nx\ny\nc d\nend"
    assert one(spark, html_to_text(F.lit(None).cast("string"))) is None and one(spark, html_to_text(F.lit(""))) == ""


def test_parsed(spark):
    text = "One, two; three. \"Four?\" five… 六、七。八 3.14"
    found = one(spark, t.parsed(F.lit(text)))
    assert [s.text for s in found] == ["One, two; three. ", '"Four?" ', "five… ", "六、七。", "八 3.14"]
    assert [[p.text for p in s.phrases] for s in found][0] == ["One, ", "two; ", "three. "]
    assert [p.separated for p in found[0].phrases] == [True, True, False]
    assert "".join(w for s in found for p in s.phrases for w in p.words) == text
    assert one(spark, t.parsed(F.lit(""))) == []


def test_fixed_values(spark):
    assert len(t.SYMBOL_WORDS) == 25 and len(t.PUNCTUATION) == 45 and len(t.PHRASE_SEPARATORS) == 9
    assert one(spark, t.simplify_punctuation(F.lit("‹a›🙶b❜，。¡"))) == "\"a\"\"b',.!"
    assert one(spark, t.is_symbol_word(F.lit("\\"))) and one(spark, t.is_symbol_word(F.lit("×"))) and not one(spark, t.is_symbol_word(F.lit("_")))
    with pytest.raises(Exception, match="not a known phone"):
        one(spark, t.phone_cost(F.lit("a"), F.lit("?"), 3))


def test_binary_columns(spark):
    for n in (0, 1, 63, 64, -1, -64, -65, 127, 128, 300, -300, 2**31 - 1, -(2**31), 2**40):
        assert bytes(one(spark, e.encode_leb128(F.lit(n)))) == e.leb128_signed(n)
        assert one(spark, e.decode_leb128(F.lit(e.leb128_signed(n)))) == n
        if n >= 0:
            assert bytes(one(spark, e.encode_leb128(F.lit(n), signed=False))) == e.leb128(n)
            assert one(spark, e.decode_leb128(F.lit(e.leb128(n)), signed=False)) == n
    samples = [0.0, 0.5, -0.5, 1.0, -1.0, 2.0, 1 / 3]
    for bits in (16, 24, 32):
        assert bytes(one(spark, e.pcm_bytes(F.array(*map(F.lit, samples)), bits))) == e.to_pcm(samples, bits)


def test_murmur_many(spark):
    rng = np.random.default_rng(1)
    data = [rng.bytes(int(n)) for n in [*range(20), 4000, 333, 0, 7]]
    for seed in (0, 42):
        assert e.murmur3_many(data, seed).tolist() == [e.murmur3(x, seed) for x in data]
    assert e.murmur3_many([]).tolist() == []
    df = spark.createDataFrame([("abc",), (None,), ("",), ("é😀",)], "t string")
    assert [r.h for r in df.select(e.murmur3_text("t").alias("h")).collect()] == [e.murmur3(b"abc"), None, 0, e.murmur3("é😀".encode())]


def test_windows_and_sections_as_columns(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from corvana.functions import signals

    df = spark.range(0, 12).select(F.col("id").cast("int").alias("n"))
    for kind in ("hann", "hann-sqrt", "hamming", "povey"):
        for r in df.select("n", signals.windows(kind, F.col("n")).alias("w")).collect():
            assert np.allclose(r.w, signals.window_weights(kind, r.n) if r.n else [], rtol=0, atol=1e-12)
    cutoffs = spark.createDataFrame([(0.0,), (-5.0,), (120.0,), (3999.0,), (4000.0,), (9000.0,)], "f double")
    for kind in ("lowpass", "highpass", "bandpass", "notch", "allpass", "peaking", "lowshelf", "highshelf"):
        for r in cutoffs.select("f", signals.filter_sections(kind, 8000.0, F.col("f"), 0.9, 3.0).alias("c")).collect():
            expected = signals.filter_coefficients(kind, 8000.0, r.f, 0.9, 3.0)
            assert all(abs(r.c[k] - v) < 1e-9 for k, v in expected.items())
    buffers = spark.createDataFrame([([],), ([1.0, 2.0],), ([1.0, 0.0, 3.0, -4.0],), (np.fft.rfft(np.arange(8.0)).view(float).tolist(),)], "b array<double>")
    for r in buffers.select("b", signals.bin_buffer(signals.cartesian(signals.polar(signals.complex_bins(F.col("b"))))).alias("x"), signals.bin_buffer(signals.complex_bins(F.col("b"), mirrored=True)).alias("m")).collect():
        assert np.allclose(r.x, r.b)
        if len(r.b) == 10:
            assert np.allclose(np.array(r.m).view(complex), np.fft.fft(np.arange(8.0)))


def test_covariance_by_batches(spark):
    import numpy as np

    from corvana.operators import vector_sets

    rng = np.random.default_rng(3)
    vectors = {k: rng.normal(size=(n, 6)) + 5 for k, n in (("a", 700), ("b", 2), ("c", 1), (None, 9))}
    rows = [(k, v.tolist()) for k, x in vectors.items() for v in x] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(5)
    for biased in (False, True):
        found = {(r.k, r.i, r.j): r.value for r in vector_sets.covariance(df, "k", "v", biased).collect()}
        assert len(found) == 4 * 21
        for k, x in vectors.items():
            expected = np.cov(x.T, bias=biased) + 1e-6 * np.eye(6) if len(x) > 1 else np.zeros((6, 6))
            assert all(abs(found[(k, i, j)] - expected[i, j]) < 1e-9 for i in range(6) for j in range(i, 6))
