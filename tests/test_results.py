"""Recognisers' results, seeded permutations and normal numbers against loops."""

import json
import random

from pyspark.sql import functions as F

from corvana.functions import randoms
from corvana.operators import events as ev


def looped(result, total=None):
    out, last, shift = [], 0, 0.0
    for n, s in enumerate(result["transcription"]):
        for k, t in enumerate(s["tokens"]):
            at = t.get("offsets")
            if at is None:
                at = {"from": last, "to": last}
            else:
                last = at["to"]
            if k == 0 and t["text"] == "[_BEG_]" and at["from"] == 0:
                shift = s["offsets"]["from"] / 1000
            if total is None:
                a, b = at["from"] / 1000, at["to"] / 1000
            else:
                a, b = max(t["t_dtw"] / 100, 0), s["tokens"][k + 1]["t_dtw"] / 100 if k + 1 < len(s["tokens"]) else total
            out.append((n, k, t["id"], t["text"], round(a + shift, 6), round(b + shift, 6), t["p"]))
    return out


def test_results_against_loop(spark):
    rng = random.Random(2)
    results = []
    for _ in range(60):
        at, segments = 0, []
        for n in range(rng.randint(0, 5)):
            tokens = []
            for k in range(rng.randint(0, 6)):
                begin = k == 0 and rng.random() < 0.5
                token = {"id": rng.randrange(50000), "text": "[_BEG_]" if begin else rng.choice([" one", "two", ",", " é"]), "p": rng.randrange(100) / 100, "t_dtw": rng.randrange(-1, 900)}
                if rng.random() < 0.7:
                    token["offsets"] = {"from": 0 if begin and rng.random() < 0.8 else at, "to": at + 50}
                at += 60
                tokens.append(token)
            segments.append({"offsets": {"from": n * 1000, "to": n * 1000 + 900}, "tokens": tokens})
        results.append({"result": {"language": "en"}, "transcription": segments})
    df = spark.createDataFrame([(i, json.dumps(r), 9.5) for i, r in enumerate(results)] + [(100, None, 1.0), (101, "{broken", 1.0)], "id long, json string, total double")
    for total in (None, "total"):
        got = {}
        for r in ev.result_tokens(df, "id", "json", total).collect():
            got.setdefault(r[0], []).append((r.segment, r.token, r[4], r.text, round(r.start_time, 6), round(r.end_time, 6), r.confidence))
        for i, result in enumerate(results):
            assert sorted(got.get(i, [])) == looped(result, None if total is None else 9.5)
        assert not {100, 101} & set(got)
    tokens = ev.result_tokens(df.withColumnRenamed("id", "doc"), "doc", "json")
    words = ev.result_timeline(tokens, "doc").collect()
    visible = sum(t["text"] != "[_BEG_]" for r in results for s in r["transcription"] for t in s["tokens"])
    assert sum(len(w.tokens) for w in words) == visible
    assert all(w.text == "".join(t.text for t in w.tokens).strip() and w.start_time == min(t.start_time for t in w.tokens) for w in words)


def test_draws_are_the_seeds(spark):
    rows = [(i, list(range(100, 100 + i % 17)), i % 9, i / 10, 1.5) for i in range(60)] + [(-1, [5, 6], 2, 0.0, 1.0), (None, [1], 1, 0.0, 1.0), (3, None, None, 0.0, 1.0), (4, [], 0, None, 1.0)]
    df = spark.createDataFrame(rows, "seed long, items array<long>, n int, mean double, deviation double")
    for part in (df.repartition(7), df.coalesce(1)):
        for r in part.select("*", randoms.shuffled(F.col("items"), F.col("seed")).alias("s"), randoms.normals(F.col("seed"), F.col("n"), F.col("mean"), F.col("deviation")).alias("x")).collect():
            if r.seed is None or r["items"] is None:
                assert r.s is None
            else:
                assert r.s == randoms.XorShift32(r.seed).shuffled(r["items"])
            if None in (r.seed, r.n, r["mean"]):
                assert r.x is None
            else:
                assert len(r.x) == r.n and max([abs(a - b) for a, b in zip(r.x, randoms.XorShift32(r.seed).normals(r.n, r["mean"], r["deviation"]), strict=True)], default=0) < 1e-12
