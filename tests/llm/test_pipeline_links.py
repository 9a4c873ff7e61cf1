"""Near-duplicates of the pipeline: links of fingerprints and links of shingle sets make components together."""

import numpy as np

import corpus_pipeline as p
from corvana.llm import shingles, simhash


def test_links_of_both_kinds(spark, tmp_path):
    rng = np.random.default_rng(11)
    base = [f"w{n}" for n in rng.integers(0, 400, 300)]
    docs = []
    for n in range(40):  # changed words spread evenly: every change costs five shingles of five words
        text = list(base)
        for at in range(3, 300, 300 // (1 + n)):
            text[at] = f"x{n}_{at}"
        docs.append((n, " ".join(text), "en", "s", 0))
    docs += [(100 + n, " ".join(f"v{i}" for i in rng.integers(0, 10**6, 60)), "en", "s", 0) for n in range(20)]
    # a line that is repeated weighs in a fingerprint, not in a set; what follows it differs
    docs += [(200 + n, " ".join(["one line of a few words that stands here again"] * 60 + [f"t{n}_{i}" for i in range(20)]), "en", "s", 0) for n in range(4)]
    fps = simhash.fingerprints([d[1] for d in docs]).astype(np.uint64)
    sets = [set(shingles.shingle_set(d[1]).tolist()) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    only_bits = 0
    for a in range(len(docs)):
        for b in range(a):
            jaccard = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8
            bits = (int(fps[a]) ^ int(fps[b])).bit_count() <= 3
            only_bits += bits and not jaccard
            if jaccard or bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert only_bits  # else the test says nothing of fingerprints
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in p.drop_near_duplicates(spark, df, str(tmp_path)).collect()}
    assert got == {docs[n][0] for n in range(len(docs)) if find(n) == n}
