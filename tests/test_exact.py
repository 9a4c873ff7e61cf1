"""Results that must equal their SQL on rows which the small tables don't hold."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corvana.functions import signals
from corvana.plans import samples, speech, texts


def test_short_codes(spark):
    heads = ["Öß", "ßa", "En", "- ", "a-", "", None]
    got = spark.createDataFrame([(n, h) for n, h in enumerate(heads)], "n int, h string").select("n", texts.short_code(F.col("h")).alias("v")).orderBy("n").collect()
    assert [r.v for r in got] == ["öß", "ßa", "en", "- ", "a-", "", None]


def test_restored_signals_round_like_the_given(spark, tmp_path):
    x = np.array([k / 16 for k in range(-32, 32)], np.float32)  # ties of the third decimal
    assert np.abs(signals.istft(signals.stft(x, 16, 16, 4), 16, 16, 4) - x).max() < 1e-14
    spark.createDataFrame([(0, 1, x.tolist())], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (row,) = samples.queries()["sig_istft"](spark, str(tmp_path)).collect()
    assert [float(v) for v in row.value.split(",")] == [float(np.sign(v) * np.floor(abs(v) * 1000 + 0.5) / 1000) for v in x.astype(float)]


def test_cut_references_stay_as_in_sql(spark, tmp_path):
    cut = ["&", "&a", "&am", "&amp", "&quo", "&quot", "&lt", "&gt", "&nbsp", "&copy", "&middot", "&#39", "&amp;quot", "&amp;quot;", "&ampquot;", "&quot;&quot"]
    pages = [(n, f"<title>x {c}</title><h1>x {c}</h1><p>{c};{c} y&copy;</p>{c}") for n, c in enumerate(cut)] + [(len(cut), None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = speech.queries()["txt_html"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {(r.page_id, r.text) for r in got} == set(con.execute(speech.oracle_sql()["txt_html"]).fetchall())
    assert dict(got)[5] == 'x &quot\nx &quot\n"&quot y©\n&quot'
