"""Toxicity by weak supervision.

1. Lexicons: besides a short seed list, words and word beginnings that are frequent in toxic and
   rare in other rows of a bounded, documented sample of labelled rows (FIT_ROWS).
2. Voters: each lexicon is dealt into several voters; patterns (shouting, bursts of marks, masked
   words, address in the second person) and the absence of every lexicon entry vote as well. One pass
   over all documents writes each one's votes and lexicon entries to a small table.
3. Label model: a generative model of the votes given the unknown label, P(y) * product of
   P(vote | y, the vote it leans on). What each vote leans on, the correlations, is the tree of
   largest mutual information given the label. Accuracies and correlations are estimated by
   expectation maximisation over the counts of all documents' vote patterns; where a label is given
   it is known, elsewhere it is the posterior of the round before.
4. A logistic regression on lexicon entries and votes is trained on the posteriors, from the votes
   alone, of a bounded sample of labelled and other documents. It scores every row of the small table.

Labels are taken only from rows whose crc32(id as text) mod 4 is not 2; neither labels nor ids,
languages or sources are inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.llm.batches import mapper
from corvana.llm.simhash import BROADCAST_ROWS, text_key
from corvana.session import cut

#: Bound of the sample of labelled rows that lexicons are drawn from, and of the labelled and the other rows that the classifier is fitted on.
FIT_ROWS = 20_000
MIN_TOXIC, MIN_PRECISION = 3, 0.85
THRESHOLD = 0.3
HELD_OUT_MOD, HELD_OUT = 4, 2

# Seed lexicon of common English insults.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
LEXICON_VOTERS = 8
MASKED = re.compile(r"\b[^\W\d_]+\*{2,}[^\W\d_]*")
BURST = re.compile(r"[!?]{3,}")
SECOND_PERSON = re.compile(r"\b(?:you|your|you're)\b", re.IGNORECASE)
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
N_VOTERS = 2 + LEXICON_VOTERS + 5


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def entries_of(words: set[str]) -> set[str]:
    """A text's candidates: its words and their beginnings, marked by a bar."""
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "|" for w in words if len(w) > n])
    return found


@dataclass
class Lexicon:
    entries: list[str]

    def __post_init__(self):
        self.at = {e: n for n, e in enumerate(self.entries)}
        self.whole = {e for e in self.entries if not e.endswith("|")}
        self.begin = {n: {e[:-1] for e in self.entries if e.endswith("|") and len(e) == n + 1} for n in PREFIXES}

    def hits(self, words: set[str]) -> list[int]:
        at = self.at
        found = [at[w] for w in words & self.whole]
        for n, begins in self.begin.items():
            if begins:
                found += [at[p + "|"] for p in {w[:n] for w in words if len(w) > n} & begins]
        return sorted(found)

    def votes(self, text: str | None, words: set[str], hits: list[int]) -> int:
        """The votes as the bits of a number: for toxic, but the last, which is for clean."""
        text = text or ""
        seeds = sum(w in words for w in SEEDS)
        upper = len(UPPER(text)) / len(text) if text else 0.0
        cast = [
            seeds > 0, seeds > 1, *[False] * LEXICON_VOTERS,
            upper > 0.5, bool(BURST.search(text)), bool(MASKED.search(text)), bool(SECOND_PERSON.search(text)), not hits and not seeds,
        ]
        for h in hits:
            cast[2 + h * LEXICON_VOTERS // len(self.entries)] = True
        return sum(1 << n for n, vote in enumerate(cast) if vote)


def bits(masks: np.ndarray) -> np.ndarray:
    """Votes as rows of zeros and ones."""
    return (masks[:, None] >> np.arange(N_VOTERS) & 1).astype(float)


@dataclass
class LabelModel:
    """prior: of label 1; leans: the voter that each one leans on, -1 for none; chance[j, y, b]: of vote j for label y where the vote it leans on is b."""

    prior: float
    leans: list[int]
    chance: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, labelled: np.ndarray, other: np.ndarray, rounds: int = 25) -> LabelModel:
        """votes: patterns; labelled[k]: how many documents of pattern k have label 0 and 1; other[k]: how many have none."""
        known = labelled.sum(axis=0)
        prior = min(max((known[1] + 1) / (known.sum() + 10), 0.01), 0.5)
        # before any round a document without a label is half as toxic as its share of votes, so the prior decides where no label is known
        share = votes[:, :-1].max(axis=1) if known.min() == 0 else np.zeros(len(votes))
        weight = labelled + (other[:, None] * np.stack([1 - share, share], axis=1) if known.min() == 0 else 0)
        model = cls.of(votes, weight, prior)
        for _ in range(rounds if other.sum() else 0):
            post = model.posterior(votes)
            weight = labelled + other[:, None] * np.stack([1 - post, post], axis=1)
            model = cls.of(votes, weight, min(max(weight[:, 1].sum() / max(weight.sum(), 1), 0.005), 0.5))
        return model

    @classmethod
    def of(cls, votes: np.ndarray, weight: np.ndarray, prior: float) -> LabelModel:
        """The model of weighted patterns whose labels are known."""
        leans = leaning(votes, weight)
        chance = np.empty((N_VOTERS, 2, 2))
        for j, p in enumerate(leans):
            on = votes[:, p] if p >= 0 else np.zeros(len(votes))
            for y in (0, 1):
                base = (weight[:, y] @ votes[:, j] + 0.5) / (weight[:, y].sum() + 1)
                for b in (0, 1):
                    own = weight[:, y] * (on == b)
                    chance[j, y, b] = (own @ votes[:, j] + 2 * base) / (own.sum() + 2)
        return cls(prior, leans, np.clip(chance, 1e-6, 1 - 1e-6))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of label 1 given each row of votes."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.leans):
            b = (votes[:, p] if p >= 0 else np.zeros(len(votes))).astype(int)
            one, zero = self.chance[j, 1, b], self.chance[j, 0, b]
            odds += np.where(votes[:, j] == 1, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def leaning(votes: np.ndarray, weight: np.ndarray, least: float = 1e-4) -> list[int]:
    """For each voter the one it leans on: the tree of largest mutual information given the label; ties of under `least` are none."""
    total = max(weight.sum(), 1e-9)
    information = np.zeros((N_VOTERS, N_VOTERS))
    for y in (0, 1):
        w = weight[:, y]
        n = max(w.sum(), 1e-9)
        both = (votes * w[:, None]).T @ votes / n
        one = np.diag(both)
        for cell, p, q in ((both, one[:, None], one[None, :]), (one[:, None] - both, one[:, None], 1 - one[None, :]), (one[None, :] - both, 1 - one[:, None], one[None, :]), (1 - one[:, None] - one[None, :] + both, 1 - one[:, None], 1 - one[None, :])):
            cell, expected = np.maximum(cell, 0), np.maximum(p * q, 0)
            information += n / total * np.where((cell > 1e-12) & (expected > 1e-12), cell * np.log(np.maximum(cell, 1e-300) / np.maximum(expected, 1e-300)), 0)
    leans, inside = [-1] * N_VOTERS, [0]
    while len(inside) < N_VOTERS:
        rest = [j for j in range(N_VOTERS) if j not in inside]
        best, j, p = max((information[j, p], -j, p) for j in rest for p in inside)
        leans[-j] = p if best >= least else -1
        inside.append(-j)
    return leans


def linear(masks: np.ndarray, hits: np.ndarray, row: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """bias + weights of each row's votes and of its lexicon entries (hits of the given rows)."""
    n_entries = len(weight) - N_VOTERS
    return bias + bits(masks) @ weight[n_entries:] + np.bincount(row, weight[hits], len(masks))


def logistic(masks: np.ndarray, hits: np.ndarray, row: np.ndarray, n_entries: int, target: np.ndarray, l2: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradient descent; entries are kept sparse."""
    n, m = len(masks), n_entries + N_VOTERS
    votes = bits(masks)
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    rate = 4.0 / (1 + (votes.sum() + len(hits)) / max(n, 1))
    for step in range(steps):
        mu = step / (step + 3)
        lw, lb = w + mu * vw, b + mu * vb
        p = 1 / (1 + np.exp(-np.clip(linear(masks, hits, row, lw, lb), -30, 30)))
        err = (p - target) / max(n, 1)
        slope = np.concatenate([np.bincount(hits, err[row], n_entries), votes.T @ err])
        nw, nb = lw - rate * (slope + l2 * lw), lb - rate * float(err.sum())
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


@dataclass
class Model:
    lexicon: Lexicon
    labels: LabelModel
    weight: np.ndarray
    bias: float

    def scores(self, masks: np.ndarray, hits: np.ndarray, row: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(linear(masks, hits, row, self.weight, self.bias), -30, 30)))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))


def least_hash(words: Column, seed: int) -> Column:
    """The least hash of the runs of four words."""
    return F.array_min(F.transform(words, lambda x, i: F.xxhash64(F.lit(seed), x, F.get(words, i + 1), F.get(words, i + 2), F.get(words, i + 3))))


def without_copies(sample: DataFrame, looks: int = 3) -> DataFrame:
    """Rows (t, y) of which near copies are left out, whose words would else pass for evidence: of those that share the least hash of their runs of four words, under several hashes in turn, one stays."""
    words = F.split(F.lower(F.coalesce("t", F.lit(""))), r"[^\p{L}]+")
    for look in range(looks):
        marked = sample.withColumn("w", words).withColumn("least", least_hash(F.col("w"), look))
        sample = marked.groupBy("least", "y").agg(F.min("t").alias("t")).select("t", "y")
    return cut(sample)


def telling(counts: dict[str, int]) -> list[str]:
    """The entries in order, without beginnings that tell hardly more than the whole words they begin."""
    whole: dict[str, int] = {}
    for entry, n in counts.items():
        if not entry.endswith("|"):
            for k in PREFIXES:
                if len(entry) > k:
                    whole[entry[:k] + "|"] = max(n, whole.get(entry[:k] + "|", 0))
    return [e for e, n in counts.items() if n - whole.get(e, 0) >= MIN_TOXIC]


SEEN = "id long, key string, mask int, hits array<int>"


def voted(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, mask, hits): each row's text by its key, its votes and lexicon entries, without a shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, hits = [], []
        for text in batch.column("t").to_pylist():
            words = words_of(text)
            hits.append(lexicon.hits(words))
            masks.append(lexicon.votes(text, words, hits[-1]))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(masks, pa.int32()), pa.array(hits, pa.list_(pa.int32()))], names=["id", "key", "mask", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(mapper(kernel, "t"), SEEN)


def flattened(hits: list) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and the row of each."""
    sizes = np.array([len(h) for h in hits], np.int64)
    return np.fromiter((x for h in hits for x in h), np.int64, int(sizes.sum())), np.repeat(np.arange(len(hits)), sizes)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and voted() of docs. Without labelled rows of both kinds the seeds alone are the lexicon. A label of an id holds for all its rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    fitted = without_copies(texts.join(F.broadcast(sample), "id").select("t", "y"))  # at most FIT_ROWS rows are broadcast

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, every, n = Counter(), Counter(), [0, 0]
        for text, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
            found = entries_of(words_of(text))
            every.update(found)
            n[0] += 1
            if y:
                toxic.update(found)
                n[1] += 1
        every[""], toxic[""] = n
        return pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([toxic[e] for e in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["entry", "n_toxic", "n_all"])

    counts = fitted.mapInArrow(mapper(counted, "t"), "entry string, n_toxic long, n_all long").groupBy("entry").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_all").alias("n_all"))
    counts = cut(counts.where(f"entry <> '' and n_toxic >= {MIN_TOXIC} and n_toxic >= {MIN_PRECISION} * n_all"))
    evidence = F.desc(F.col("n_toxic") * F.col("n_toxic") / F.col("n_all"))
    lexicon = Lexicon(telling({r["entry"]: r["n_toxic"] for r in counts.orderBy(evidence, "entry").collect()}))  # bounded by the words of FIT_ROWS ids

    seen = cut(voted(docs, lexicon, id_col, text_col))
    told = seen.join(known, "id", "left")
    patterns = told.groupBy("mask", "y").agg(F.count("*").alias("n")).collect()  # 3 * 2^N_VOTERS rows at most, whatever the input
    masks = np.array(sorted({r["mask"] for r in patterns}), np.int64)
    place = {m: k for k, m in enumerate(masks.tolist())}
    labelled, other = np.zeros((len(masks), 2)), np.zeros(len(masks))
    for r in patterns:
        if r["y"] is None:
            other[place[r["mask"]]] += r["n"]
        else:
            labelled[place[r["mask"]], int(r["y"] > 0)] += r["n"]
    model = LabelModel.fit(bits(masks), labelled, other)

    drawn = lambda kind: cut(told.where(kind).orderBy(F.xxhash64("id", "key"), "id", "key").select("mask", "hits").limit(FIT_ROWS))  # noqa: E731  cut: else each task sends as many to the driver
    rows = drawn("y is not null").collect() + drawn("y is null").collect()  # 2 * FIT_ROWS at most
    masks, (hits, row) = np.array([r["mask"] for r in rows], np.int64), flattened([r["hits"] for r in rows])
    target = model.posterior(bits(masks)) if rows else np.zeros(0)
    weight, bias = logistic(masks, hits, row, len(lexicon.entries), target)
    return Model(lexicon, model, weight, bias), seen


def score(seen: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, key, score) of each row of voted(), without a shuffle or another look at the texts. A null text counts as empty."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks = batch.column("mask").to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column("hits")
        hits = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(model.scores(masks, hits, row), pa.float64())], names=["id", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kernel(batch)

    return seen.mapInArrow(run, "id long, key string, score double").withColumnRenamed("id", id_col)


def verdicts(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The held-out mark, score and decision of each row; a null id isn't held out."""
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, fitted: tuple[Model, DataFrame], text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores under the threshold; fitted: what fit() gave for docs."""
    model, seen = fitted
    toxic = cut(score(seen, model).where(F.col("score") >= THRESHOLD).select(F.col("key").alias("toxic_key")).distinct())
    toxic = F.broadcast(toxic) if toxic.count() <= broadcast_rows else toxic
    return docs.join(toxic, text_key(F.col(f"`{text_col}`")) == F.col("toxic_key"), "left_anti")
