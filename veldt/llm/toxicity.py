"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its words; a document's is the noisy-or of its sentences, 1 - prod(1 - s). The
word weights are learned from document labels alone, by gradient descent on the
likelihood of the documents, so the labels' blame settles on the sentences that
explain them; each text's worst sentence is reported with its score.

Learning reads the text and `toxic` label of about `sample` documents at most
that are not held out, chosen by a hash of doc_id. Of their words those that
stand in `least_docs` documents at least are candidates, and the `vocabulary`
most associated with the labels get weights.

Cases: null and empty texts have no sentence; like texts without a known word
they get the score of that many plain sentences, 0 without any. Null labels are not used; several labels of a
document count as toxic if one is; with no labels, or of one kind only, every
score is 0. An empty table gives an empty result; repeated rows are scored
alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, through_pandas
from .minhash import word_hashes

_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
_STOP = np.array([chr(i) in ".!?\n" for i in range(256)])


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Word hashes, the sentence number of each, where each sentence's first word begins (a byte), and how many sentences have a word."""
    b = np.frombuffer((text or "").encode().lower(), np.uint8)
    start, words = word_hashes(b, _WORD)
    if not len(words):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    part = np.searchsorted(np.flatnonzero(_STOP[b]), start)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return words, np.cumsum(np.r_[0, part[1:] != part[:-1]]), start[first], len(first)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch: in how many documents, and toxic documents, each word stands."""
    for pdf in batches:
        own = [np.unique(sentences(t)[0]) for t in pdf["text"]]
        if own:
            w, at = np.unique(np.concatenate(own), return_inverse=True)
            toxic = np.repeat(pdf["toxic"].to_numpy(float), [len(x) for x in own])
            yield pd.DataFrame({"w": w.view(np.int64), "df": np.bincount(at, minlength=len(w)), "pos": np.bincount(at, toxic, len(w)).astype(np.int64)})


def _bags(words: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                w, s, _, n = sentences(text)
                k = np.minimum(np.searchsorted(words, w), len(words) - 1)
                hit = words[k] == w
                both = np.unique(np.stack([s[hit], k[hit]]), axis=1).astype(np.int32)
                out.append((int(toxic), n, both[0].tobytes(), both[1].tobytes()))
            yield pd.DataFrame(out, columns=["toxic", "n", "s", "c"])

    return run


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def sentence_scores(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.words) and n:
            k = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[k] == words
            if hit.any():
                pairs = np.unique(np.stack([at[hit], k[hit]]), axis=1)  # a word counts once a sentence
                z += np.bincount(pairs[0], self.weights[pairs[1]], n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def document_score(self, s: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum())) if len(s) else 0.0


class Bags:
    """Labelled documents as sentences with known words: y, the number of sentences n, and for each document the sentence and column of each known word, once a sentence."""

    def __init__(self, y: np.ndarray, n: np.ndarray, sentence: list[np.ndarray], column: list[np.ndarray], columns: int):
        self.y, self.columns = y, columns
        sent = np.concatenate(sentence).astype(np.int64) + np.repeat(np.r_[0, np.cumsum(n)[:-1]], [len(x) for x in sentence])
        self.col = np.concatenate(column)
        row, self.inv = np.unique(sent, return_inverse=True)
        self.owner = np.searchsorted(np.cumsum(n), row, side="right")
        self.plain = n - np.bincount(self.owner, minlength=len(y))  # sentences without a known word

    def loss(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalized negative log likelihood a document, and its gradient, at weights x[:-1] and bias x[-1]."""
        theta, bias, y, rows = x[:-1], x[-1], self.y, len(self.owner)
        z = np.clip(bias + np.bincount(self.inv, theta[self.col], rows), -30, 30)
        s, s0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        quiet = np.bincount(self.owner, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)) + self.plain * np.log1p(-s0)
        p = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
        # d(-log likelihood)/d quiet, with d quiet / dz = -s
        g = np.where(y > 0, (1 - p) / p, -1.0)
        dz = -g[self.owner] * s
        grad = np.r_[np.bincount(self.col, dz[self.inv], self.columns) + 0.05 * theta, dz.sum() - (g * self.plain).sum() * s0] / len(y)
        return float(-np.where(y > 0, np.log(p), quiet).sum() + 0.025 * (theta**2).sum()) / len(y), grad


def fit(bags: pd.DataFrame, words: np.ndarray, surprise: np.ndarray, steps: int = 400) -> Model:
    """bags: toxic, n (sentences), s and c (sentence and column of each known word of each sentence); words and surprise by column."""
    part = Bags(bags["toxic"].to_numpy(float), bags["n"].to_numpy(), *[[np.frombuffer(x, np.int32) for x in bags[c]] for c in "sc"], len(words))
    x = np.r_[np.clip(surprise / 4, -2, 4), -5.0]
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        grad = part.loss(x)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(words, x[:-1], float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, vocabulary: int = 1000, least_docs: int = 4) -> Model:
    lab = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, lab.count())
    lab = lab.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < sample / n * 1_000_000).withColumnRenamed("doc_id", "__d")
    rows = docs.select("doc_id", "text").join(lab, F.col("doc_id") == F.col("__d")).select("text", "toxic")
    docs_n, toxic_n = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic_n or toxic_n == docs_n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    base = toxic_n / docs_n
    counts = rows.mapInPandas(_counted, "w long, df long, pos long").groupBy("w").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    counts = counts.where(F.col("df") >= least_docs).withColumn("x", (F.col("pos") - F.col("df") * base) / F.sqrt(F.col("df") * (base * (1 - base))))
    top = counts.where(F.abs("x") > 2).orderBy(F.abs("x").desc(), "w").limit(vocabulary).select("w", "x").toPandas()  # at most so many rows
    if top.empty:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    words = top["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return fit(rows.mapInPandas(_bags(words[order]), "toxic int, n long, s binary, c binary").toPandas(), words[order], top["x"].to_numpy()[order])


def _scored(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf.pop("text"):
                w, at, first, n = sentences(text)
                s = model.sentence_scores(w, at, n)
                k = int(s.argmax()) if n else None
                out.append((model.document_score(s), k, int(first[k]) if n else None, float(s[k]) if n else None))
            yield pdf.join(pd.DataFrame(out, columns=["score", "worst_sentence", "worst_byte", "worst_score"], index=pdf.index).astype({"worst_sentence": "Int64", "worst_byte": "Int64"}))

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, and the worst sentence: its number, the byte at which it begins, its score."""
    schema = "held_out boolean, score double, worst_sentence long, worst_byte long, worst_score double"
    return through_pandas(docs, _scored(model), schema, held_out(F.col("doc_id")).alias("held_out"), "text")


def op7_multiple_instance(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "worst_sentence", "worst_byte", "worst_score")
