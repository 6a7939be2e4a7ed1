"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

The examples are a bounded sample of the labelled rows (EXAMPLES of each label, by hash of the id).  Terms that
separate the labels beyond chance among them make the vocabulary; their document frequencies are counted over
all documents.  A text's nearest examples vote, weighted by distance and by how many labelled rows an example
stands for; a logistic curve fitted to left-out votes turns the vote into a calibrated score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.llm.common import small_batches, written

EXAMPLES = 3_000  # labelled rows of either label that are learnt from, at most
TERMS = 4_096  # terms of the vocabulary, at most
CHANCE = 30.0  # chi-squared that a term must exceed
NEIGHBOURS = 25
BLOCK = 64  # examples of a block
NEAREST = 0.05  # distance that is added before weighting, so that equal texts do not weigh without bound
EVIDENCE = 3
BEGINNINGS = range(4, 9)  # characters
KNOWN_WORDS = 300_000  # words whose terms a worker remembers before it starts anew

_TERMS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _TERMS.findall((text or "").lower())


def forms(word: str) -> list[str]:
    """The terms of a word: itself, and its beginnings (marked), which hold what inflected forms share."""
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if k < len(word))]


def terms_of(text: str | None) -> set[str]:
    return {f for w in set(words_of(text)) for f in forms(w)}


@dataclass
class Index:
    """Example vectors as inverted lists: by term, the examples of each block and the block's largest weight."""

    rows: list[tuple[np.ndarray, np.ndarray]]  # unit vectors (terms, weights)
    n_terms: int
    tops: np.ndarray = field(init=False)  # (term, block) largest weight

    def __post_init__(self) -> None:
        lead = [tuple(t[np.argsort(-w, kind="stable")][:3]) for t, w in self.rows]
        self.order = np.array(sorted(range(len(self.rows)), key=lambda k: (lead[k], k)), np.int64)  # like with like
        blocks = -(-len(self.rows) // BLOCK)
        self.tops = np.zeros((self.n_terms, blocks), np.float64)
        lists: dict[tuple[int, int], list] = {}
        for at, k in enumerate(self.order.tolist()):
            for term, weight in zip(self.rows[k][0].tolist(), self.rows[k][1].tolist(), strict=True):
                lists.setdefault((term, at // BLOCK), []).append((at % BLOCK, weight))
                self.tops[term, at // BLOCK] = max(self.tops[term, at // BLOCK], weight)
        self.lists = {key: (np.array([x for x, _ in v]), np.array([w for _, w in v])) for key, v in lists.items()}

    def nearest(self, terms: np.ndarray, weights: np.ndarray, count: int, but: int = -1) -> list[tuple[float, int]]:
        """The ``count`` examples of largest positive cosine (ties: least number), by falling cosine.

        Blocks are opened by falling bound; none is left closed whose bound reaches the last kept cosine.
        """
        if not len(terms) or not len(self.rows):
            return []
        bounds = weights @ self.tops[terms]
        kept: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or (len(kept) == count and bounds[block] < -kept[-1][0] - 1e-9):
                break
            score = np.zeros(BLOCK)
            for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
                found = self.lists.get((term, block))
                if found is not None:
                    score[found[0]] += weight * found[1]
            at = np.nonzero(score > 0)[0]
            kept += [(-round(float(score[a]), 9), int(self.order[block * BLOCK + a])) for a in at.tolist()]
            kept = sorted(x for x in kept if x[1] != but)[:count]
        return [(-s, k) for s, k in kept]


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # labelled rows that an example stands for
    names: list[int]
    index: Index
    base: float  # score of a text without a term of the vocabulary
    curve: tuple[float, float] = (1.0, 0.0)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def terms(self, word: str) -> tuple[int, ...]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(self.vocabulary[f] for f in forms(word) if f in self.vocabulary)
        return found

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weights = (1 + np.log([counts[t] for t in terms.tolist()])) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, weights / (np.sqrt((weights**2).sum()) or 1.0)

    def vote(self, found: list[tuple[float, int]]) -> float:
        at = np.array([k for _, k in found])
        closeness = self.weights[at] / (1 - np.array([s for s, _ in found]) + NEAREST)
        return float((closeness * self.labels[at]).sum() / closeness.sum())

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.nearest(*self.vector(counts), NEIGHBOURS)
        if not found:
            return self.base, []
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.vote(found) + b)))), found[:EVIDENCE]

    def counts(self, text: str | None) -> dict[int, int]:
        known, out = self.known, Counter()
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                found = self.terms(word)
            if found:
                out.update(found)
        return out


def _fitted_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the vote, lightly ridged, by Newton steps."""
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    w, theta = weights / weights.mean(), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (w * (labels - p)) - 1e-2 * theta
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the rows of ``labels`` that satisfy ``learn_from`` (a condition on them).

    An id that repeats counts as labelled 1 if any of its rows is; null labels and ids are left out; examples of
    equal text count once.  With no example of either label every text scores the share of label 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(learn_from & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = written(known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")), "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect() if r["label"] in (0, 1)}
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for v in (0, 1)]
    chosen = F.broadcast(written(chosen[0].unionByName(chosen[1]), "chosen"))  # 2 * EXAMPLES rows at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    rows = rows.withColumn("key", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["key"])
    examples = written(rows.select("doc_id", "label", "text"), "examples")

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "terms": [sorted(terms_of(t)) for t in batch["text"]]})

    have = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    seen = examples.mapInPandas(used, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    seen = seen.groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(n0 + n1)
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), 2.0) / ((a + b) * (n - a - b) * float(n1) * float(n0))
    seen = seen.withColumn("chi", F.when((a + b < n) & F.lit(bool(n1 and n0)), chi).otherwise(0.0)).where(F.col("chi") > CHANCE)
    vocabulary = {r["term"]: k for k, r in enumerate(seen.orderBy(F.col("chi").desc(), "term").limit(TERMS).collect())}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's texts with each term: as many rows as the vocabulary has terms, and one for the texts."""
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                total[list(model.counts(t))] += 1
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    stands = {v: sizes[v] / have[v] for v in have if v in sizes}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    model = Model(vocabulary, np.ones(len(vocabulary)), np.zeros(0), np.zeros(0), [], Index([], len(vocabulary)), share)
    everywhere = docs.select(F.col(text).alias("text")).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary) + 1)
    df[everywhere["term"]] = everywhere["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = [model.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [list(c) for c in counted], "n": [list(c.values()) for c in counted]})

    held = examples.mapInPandas(vectors, "doc_id long, label int, terms array<int>, n array<int>").toPandas().sort_values("doc_id", kind="stable")
    if not len(held) or not (n0 and n1):
        return model
    labels_, weights = held["label"].to_numpy(float), held["label"].map(stands).to_numpy(float)
    rows = [model.vector(dict(zip(map(int, t), map(int, n), strict=True))) for t, n in zip(held["terms"], held["n"], strict=True)]
    bare = np.array([not len(t) for t, _ in rows])
    base = float(((weights * labels_)[bare].sum() + share) / (weights[bare].sum() + 1))
    model = Model(vocabulary, idf, labels_, weights, held["doc_id"].tolist(), Index(rows, len(vocabulary)), base)
    left_out = [(k, model.index.nearest(*rows[k], NEIGHBOURS, but=k)) for k in range(len(rows)) if not bare[k]]
    votes = [(model.vote(found), labels_[k], weights[k]) for k, found in left_out if found]
    if votes:
        model.curve = _fitted_curve(*np.array(votes).T)
    return model


def scored(model: Model, text: str = "text", spark=None) -> Column:  # type: ignore[no-untyped-def]
    """A struct column (score, predicted, evidence) for any text, null and empty ones too.

    evidence: the nearest examples (doc_id, similarity, label), none where a text has no term of the vocabulary.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by EXAMPLES and TERMS

    @F.pandas_udf("score double, predicted int, evidence array<struct<doc_id: long, similarity: double, label: int>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, told = shared.value, {}
        for batch in batches:
            rows = []
            for t in batch:
                counts = m.counts(t)
                key = tuple(sorted(counts.items()))
                if key not in told:
                    if len(told) > 50_000:
                        told.clear()
                    told[key] = m.score(counts)
                s, found = told[key]
                rows.append((s, int(s >= 0.5), [{"doc_id": m.names[k], "similarity": c, "label": int(m.labels[k])} for c, k in found]))
            yield pd.DataFrame(rows, columns=["score", "predicted", "evidence"])

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, evidence.  Equal texts have equal scores."""
    model = learn(docs, labels, learn_from, doc_id, text)
    told = docs.select(F.col(doc_id).alias("doc_id"), scored(model, text, docs.sparkSession).alias("t"))
    return told.select("doc_id", "t.*")


def without_toxic(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    model = learn(docs, labels, learn_from, doc_id, text)
    return docs.where(scored(model, text, docs.sparkSession)["predicted"] == 0)
