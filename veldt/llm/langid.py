"""Language ID by rank-order profiles.

A profile ranks the most frequent letter n-grams (one to three characters,
words bounded by one blank) of a language's training texts. A document's own
most frequent n-grams are ranked likewise, and the language whose profile has
the least out-of-place distance is predicted: the sum of rank differences,
with the profile's length for n-grams that it lacks.

Learning reads text and lang only, of documents that are not held out and whose
lang is known, and of each language about `per_language` documents at most,
chosen by a hash of doc_id.

Cases: a null text, or one without a letter, is `und` with score 0, and so is
every text where nothing can be learned; ties of n-grams go by code, ties of
languages by name; an empty table gives an empty result; repeated rows are
predicted alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, table, through_pandas

_BITS = np.uint64(21)
_known: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    if not _known:
        _known.append(np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)]))
    return _known[0]


def ngrams(text: str | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams, ascending, and their counts; none without a letter. A code is the characters' code points, the blank's being 1."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    c = np.where(_letters()[c], c, 1).astype(np.uint64)
    if not (c > 1).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = np.ones(1, np.uint64)
    c = np.concatenate([one, c, one])
    c = np.concatenate([one, c[1:][(c[1:] > 1) | (c[:-1] > 1)]])
    out, code = [c[c > 1]], c
    for n in range(2, longest + 1):
        code = (code[:-1] << _BITS) | c[n - 1 :]
        out.append(code)
    return np.unique(np.concatenate(out), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, best first."""
    if len(codes) > 2 * size:  # all that can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:size]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            parts = [ngrams(t) for t in group["text"]]
            if lang in total:
                parts.append(total[lang])
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total[lang] = codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
    for lang, (codes, counts) in total.items():
        yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": counts})


def profiles(docs: DataFrame, size: int = 400, per_language: int = 3000) -> dict[str, np.ndarray]:
    """Each language's ranked codes; languages x size rows come to the driver."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    picked = known.where(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    grams = picked.select("lang", "text").mapInPandas(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    top = grams.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size).toPandas()
    return {lang: g.sort_values("r")["code"].to_numpy(np.int64).view(np.uint64) for lang, g in sorted(top.groupby("lang"))}


def _predicted(learned: dict[str, np.ndarray], size: int):
    order = {lang: np.argsort(p) for lang, p in learned.items()}
    codes = {lang: p[order[lang]] for lang, p in learned.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best, score = [], []
            for text in pdf.pop("text"):
                own = ranked(*ngrams(text), size)
                found = ("und", 0.0)
                if len(own) and learned:
                    far = []
                    rank = np.arange(len(own))
                    for lang, have in codes.items():
                        k = np.minimum(np.searchsorted(have, own), len(have) - 1)
                        far.append((int(np.where(have[k] == own, np.abs(order[lang][k] - rank), size).sum()), lang))
                    d, lang = min(far)
                    found = (lang, 1 - d / (size * len(own)))
                best.append(found[0])
                score.append(min(1.0, max(0.0, found[1])))
            yield pdf.assign(lang_pred=best, score=score)

    return run


def identify(docs: DataFrame, size: int = 400, per_language: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    learned = profiles(docs.select("doc_id", "text", "lang"), size, per_language)
    return through_pandas(docs, _predicted(learned, size), "held_out boolean, lang_pred string, score double", held_out(F.col("doc_id")).alias("held_out"), "text")


def op8_rank_order_profiles(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
