"""The label model on drawn votes, held-out accuracy on drawn and on given documents, odd rows."""

import random
import zlib

import numpy as np

from corvana.llm import toxicity as x
from corvana.session import table


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def patterns(votes, y, given):
    """Distinct rows of votes with their counts by known label and without one."""
    masks = (votes.astype(int) << np.arange(x.N_VOTERS)).sum(axis=1)
    kinds, at = np.unique(masks, return_inverse=True)
    labelled, other = np.zeros((len(kinds), 2)), np.zeros(len(kinds))
    np.add.at(labelled, (at[given], y[given].astype(int)), 1)
    np.add.at(other, at[~given], 1)
    return x.bits(kinds), labelled, other, at


def voters(n, prior, seed):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    votes = np.zeros((n, x.N_VOTERS))
    for k, (hit, miss) in enumerate([(0.9, 0.02), (0.6, 0.05), (0.5, 0.1), (0.3, 0.02), (0.1, 0.1)]):
        votes[:, k] = rng.random(n) < np.where(y, hit, miss)
    votes[:, 5] = np.where(rng.random(n) < 0.9, votes[:, 1], votes[:, 5])  # mostly repeats the second voter
    return y, votes, rng.random(n)


def test_label_model_against_counts():
    """Accuracies, correlations and posteriors of drawn votes, a tenth of the labels known."""
    y, votes, luck = voters(60_000, 0.2, 0)
    kinds, labelled, other, at = patterns(votes, y, luck < 0.1)
    model = x.LabelModel.fit(kinds, labelled, other)
    assert abs(model.prior - 0.2) < 0.02
    assert 1 in (model.leans[5], [j for j in range(x.N_VOTERS) if model.leans[j] == 5 or j == 1][0])
    assert abs(model.chance[2, 1].mean() - 0.5) < 0.06 and abs(model.chance[2, 0].mean() - 0.1) < 0.03
    post = model.posterior(kinds)
    size = np.bincount(at)
    share = np.bincount(at, y) / size  # what the labels say
    often = size > 400
    assert np.abs(post - share)[often].max() < 0.07


def test_posterior_by_brute_force():
    """The posterior of every pattern of the first voters from the joint probabilities of both labels."""
    y, votes, luck = voters(3_000, 0.3, 1)
    kinds, labelled, other, _ = patterns(votes, y, luck < 0.5)
    model = x.LabelModel.fit(kinds, labelled, other)
    every = np.zeros((64, x.N_VOTERS))
    every[:, :6] = [[k >> j & 1 for j in range(6)] for k in range(64)]
    want = []
    for row in every:
        joint = [1 - model.prior, model.prior]
        for label in (0, 1):
            for j in range(x.N_VOTERS):
                on = int(row[model.leans[j]]) if model.leans[j] >= 0 else 0
                p = model.chance[j, label, on]
                joint[label] *= p if row[j] else 1 - p
        want.append(joint[1] / sum(joint))
    assert np.allclose(model.posterior(every), want)
    for j, p in enumerate(model.leans):  # a tree: nobody leans on itself in a circle
        seen = {j}
        while p >= 0:
            assert p not in seen
            seen.add(p)
            p = model.leans[p]


def test_no_labels():
    y, votes, luck = voters(2_000, 0.2, 2)
    kinds, labelled, other, at = patterns(votes, y, luck < 0)
    post = x.LabelModel.fit(kinds, labelled, other).posterior(kinds)[at]
    assert post[y].mean() > post[~y].mean()


def test_copies_are_no_evidence(spark):
    body = " ".join(f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(200))
    rows = [(f"{body} tail{n % 2}", 1) for n in range(30)] + [(f"another {'abcdefghij'[n] * 3} text {'abcdefghij'[n] * 2} of some {'abcdefghij'[n]} words", 1) for n in range(5)] + [(None, 0), ("", 0)]
    got = [r.t for r in x.without_copies(spark.createDataFrame(rows, "t string, y int")).collect()]
    assert sum(t is not None and t.startswith("wa") for t in got) <= 2 and sum(t is not None and t.startswith("another") for t in got) == 5
    assert x.telling({"loser": 9, "lose|": 10, "grum|": 6, "grumfa": 3}) == ["loser", "grum|", "grumfa"]


def drawn(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "lin", "mer", "tos", "vi", "ran"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "worthless", "grumpf" + word(), "zorkel"]))
        rows.append((i, " ".join(words), "extra"))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = drawn(1500, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (4, None), *labels[:50]], "doc_id long, toxic int")
    model, seen = x.fit(docs, known)
    assert any(e.startswith("grum") or e.startswith("zork") for e in model.lexicon.entries)
    got = {r.doc_id: r for r in x.verdicts(x.score(seen, model)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == is_held_out(i) for i, r in got.items())
    test = [(y, got[i].predicted) for i, y in labels if is_held_out(i)]
    caught = sum(p for y, p in test if y) / sum(y for y, _ in test)
    wrong = sum(p for y, p in test if not y) / sum(not y for y, _ in test)
    assert caught > 0.95 and wrong < 0.02
    for bound in (10_000, 0):
        clean = x.keep_clean(docs, (model, seen), broadcast_rows=bound)
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}


def test_held_out_labels_change_nothing(spark):
    rows, labels = drawn(400, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    turned = [(i, 1 - y if is_held_out(i) else y) for i, y in labels]
    scores = []
    for given in (labels, turned):
        model, seen = x.fit(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
        scores.append({r.doc_id: round(r.score, 9) for r in x.score(seen, model).collect()})
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (3, "x " * 50_000), (3, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model, seen = x.fit(docs, none)
    got = x.verdicts(x.score(seen, model)).collect()
    assert len(got) == 5
    assert {r.predicted for r in got if r.doc_id is None} == {1}
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert x.score(x.voted(docs.limit(0), model.lexicon), model).count() == 0
    empty = x.fit(docs.limit(0), none)
    assert x.score(empty[1], empty[0]).count() == 0 == x.keep_clean(docs.limit(0), empty).count()


def test_given_documents(spark, medium):
    folder = medium.replace("sf0.01", "sf0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model, seen = x.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in x.verdicts(x.score(seen, model)).collect()}
    test = [(r.toxic, got[r.doc_id]) for r in labels.collect() if is_held_out(r.doc_id)]
    assert sum(p for y, p in test if not y) <= 0.02 * len(test)
    assert sum(p for y, p in test if y) >= 0.9 * sum(y for y, _ in test)
