"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed in segments of whole documents: for each term (a 64-bit
hash of a word), the ascending places at which it stands in the segment. The
index is written to the shared folder once, whatever the number of test items:
test windows are taken in blocks of a stated number, all blocks read the same
index, and only if there is a single block are words that no item has left out
of it. Counts over the index tell which terms are rare. In each segment, the
windows whose rarest term stands there are looked up, and no others: the
rarest term's list, moved back by its place in the window, gives candidate
beginnings, and the lists of the other terms, rarest first and moved likewise,
are intersected with them, for all windows at once. What is left are proximity
matches, where each term stands up to `slop` places away from where the phrase
would have it, and among them the exact phrase matches.

Words are runs of characters other than ASCII punctuation, space and controls,
with A-Z lower-cased. A window is `width` consecutive item words; an item of
fewer words, but not none, is one window.

Cases: a null or empty text has no words, is not contaminated, and as an item
gives no window; equal items match alike and all are named, repeated rows of
items once; items of null item_id count like others and are named null, at the
end and once in a count of the distinct names, but not in their digest; a
window that occurs twice in a document counts its words once; rows are judged
one by one, so repeated rows are judged alike; empty tables give empty results
or no hits; other columns are not looked at. A text of any length is one
document of one segment.

A block's windows are held by every task: `block_windows` times 160 bytes. Hits
of several blocks are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PUNCT_ANYCASE, materialize, table
from .minhash import word_hashes

#: Windows of test items that one block may have.
BLOCK_WINDOWS = 200_000
#: Words of documents that one index segment holds; a longer document is a segment of its own.
SEGMENT_WORDS = 400_000
#: Candidates that a segment looks at in one go.
CANDIDATES = 300_000

ANSWER = "__row binary, n_words long, n_hit long, hits binary, items array<string>, near_items array<string>"
MERGED = "__row binary, n_words long, items array<string>, near_items array<string>, n_hit long"
SEGMENT = "__rows array<binary>, __starts binary, __terms binary, __ends binary, __places binary"

_INSIDE = np.array([chr(i).isdigit() or "a" <= chr(i) <= "z" if i < 128 else True for i in range(256)])


def terms_of(text: str | None) -> np.ndarray:
    """A hash of each word of the text."""
    return word_hashes(np.frombuffer((text or "").encode().lower(), np.uint8), _INSIDE)[1]


class Windows:
    """The distinct windows of some items: terms (a row each, 0 beyond its size), size, and the items that have it (own_at, own)."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.names, rows, owner = [name for name, _ in items], [], []
        for n, (_, text) in enumerate(items):
            t = terms_of(text)
            if not len(t):
                continue
            w = np.lib.stride_tricks.sliding_window_view(np.r_[t, np.zeros(max(0, width - len(t)), np.uint64)], width)
            rows.append(np.c_[w, np.full(len(w), min(width, len(t)), np.uint64)])
            owner.append(np.full(len(w), n))
        flat = np.concatenate(rows) if rows else np.zeros((0, width + 1), np.uint64)
        found, at = np.unique(flat, axis=0, return_inverse=True)
        self.terms, self.size = np.ascontiguousarray(found[:, :width]), found[:, width].astype(np.int64)
        pairs = np.unique(np.stack([at.ravel(), np.concatenate(owner)]), axis=1) if rows else np.zeros((2, 0), np.int64)
        self.own_at, self.own = np.searchsorted(pairs[0], np.arange(len(found) + 1)), pairs[1]
        self.vocabulary = np.unique(flat[:, :width][np.arange(width) < flat[:, width:].astype(np.int64)]) if rows else np.zeros(0, np.uint64)

    def by_rarity(self, terms: np.ndarray, counts: np.ndarray) -> None:
        """Order each window's places by how often its terms stand in the corpus (terms, sorted, and counts), and the windows by their rarest term; windows of a term that stands nowhere go."""
        width = self.terms.shape[1]
        inside = np.arange(width) < self.size[:, None]
        k = np.searchsorted(terms, self.terms)
        k[k == len(terms)] = 0
        n = np.where(terms[k] == self.terms, counts[k], 0) if len(terms) else np.zeros(self.terms.shape, np.int64)
        n = np.where(inside, n, np.iinfo(np.int64).max)
        live = np.flatnonzero((n > 0).all(axis=1))
        self.order = np.argsort(n, axis=1, kind="stable")
        rarest = self.terms[np.arange(len(self.terms)), self.order[:, 0]]
        by = live[np.argsort(rarest[live], kind="stable")]
        self.rarest, first = np.unique(rarest[by], return_index=True)
        self.listed, self.list_at = by, np.r_[first, len(by)]


def _segments(gap: int, only: np.ndarray | None):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, starts, parts, n = [], [], [], 0

        def flush() -> pd.DataFrame:
            flat = np.concatenate(parts)
            place = np.concatenate([np.arange(s, s + len(p), dtype=np.int32) for s, p in zip(starts, parts, strict=True)])
            if only is not None:
                k = np.minimum(np.searchsorted(only, flat), len(only) - 1)
                keep = only[k] == flat
                flat, place = flat[keep], place[keep]
            order = np.argsort(flat, kind="stable")
            terms, first = np.unique(flat[order], return_index=True)
            ends = np.r_[first[1:], len(flat)] if len(terms) else first
            return pd.DataFrame({"__rows": [list(rows)], "__starts": [np.array([*starts, n], np.int64).tobytes()], "__terms": [terms.tobytes()], "__ends": [ends.astype(np.int64).tobytes()], "__places": [place[order].tobytes()]})

        for pdf in batches:
            for row, text in zip(pdf["__row"], pdf["text"], strict=True):
                t = terms_of(text)
                rows.append(row)
                starts.append(n)
                parts.append(t)
                n += len(t) + gap
                if n >= SEGMENT_WORDS:
                    yield flush()
                    rows, starts, parts, n = [], [], [], 0
        if rows:
            yield flush()

    return index


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each term stands in a segment."""
    for pdf in batches:
        for terms, ends in zip(pdf["__terms"], pdf["__ends"], strict=True):
            yield pd.DataFrame({"t": np.frombuffer(terms, np.int64), "n": np.diff(np.frombuffer(ends, np.int64), prepend=0)})


def _those_of(vocabulary: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = pdf["t"].to_numpy(np.int64).view(np.uint64)
            k = np.minimum(np.searchsorted(vocabulary, t), len(vocabulary) - 1)
            yield pdf[vocabulary[k] == t]

    return run


class Segment:
    """Term lists of some whole documents. Places count words; each document is followed by a gap of places without a word, so no match crosses documents."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int):
        self.terms, self.ends, self.stride = terms, ends, length + 1024
        self.first = np.r_[0, ends][:-1] if len(ends) else ends
        # a posting as one number, ascending: the term's number and the place
        self.postings = np.repeat(np.arange(len(terms)) * self.stride, ends - self.first) + places

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term, -1 of those that do not stand here."""
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def agree(self, w: Windows, number: np.ndarray, own: np.ndarray, at: np.ndarray, win: np.ndarray, slop: int) -> np.ndarray:
        """Which candidates (window win, whose terms' numbers are number[own], beginning at `at`) hold their terms within slop places, the rarest first."""
        left = np.arange(len(at))
        for j in range(1, w.terms.shape[1]):
            o, a, v = own[left], at[left], win[left]
            jj = w.order[v, j]
            there = number[o, jj] * self.stride + a + jj
            k = np.minimum(np.searchsorted(self.postings, there - slop), len(self.postings) - 1)
            near = (self.postings[k] >= there - slop) & (self.postings[k] <= there + slop)
            left = left[near | (j >= w.size[v])]
        return left

    def matches(self, w: Windows, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Window, beginning, the rarest term's place, and whether it is exact, of all matches."""
        if not len(self.terms) or not len(w.rarest):
            return
        few, many = (self.terms, w.rarest) if len(self.terms) < len(w.rarest) else (w.rarest, self.terms)
        k = np.minimum(np.searchsorted(many, few), len(many) - 1)
        here = np.searchsorted(w.rarest, few[many[k] == few])
        if not len(here):
            return
        win = w.listed[np.concatenate([np.arange(w.list_at[r], w.list_at[r + 1]) for r in here])]
        number = self.numbers(w.terms[win])
        full = ((number >= 0) | (np.arange(w.terms.shape[1]) >= w.size[win][:, None])).all(axis=1)
        win, number = win[full], number[full]
        rare = number[np.arange(len(win)), w.order[win, 0]]
        n = self.ends[rare] - self.first[rare]
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(n) - n) // CANDIDATES)) + 1).tolist(), len(win)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = np.repeat(np.arange(a, b), n[a:b])
            within = np.arange(len(own)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            v = win[own]
            place = self.postings[self.first[rare[own]] + within] - rare[own] * self.stride
            at = place - w.order[v, 0]
            left = self.agree(w, number, own, at, v, slop)
            exact = np.ones(len(left), bool)
            if slop:
                exact[:] = False
                exact[self.agree(w, number, own[left], at[left], v[left], 0)] = True
            yield v[left], at[left], place[left], exact


def _named(pairs: list[np.ndarray], docs: int, names: list[str | None]) -> list[list[str | None]]:
    """For each document, the sorted names of the items paired with it (document * items + item)."""
    out: list[list[str | None]] = [[] for _ in range(docs)]
    for x in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
        out[x // len(names)].append(names[x % len(names)])
    for found in out:
        found.sort(key=lambda x: (x is None, x or ""))
    return out


def _answers(w: Windows, gap: int, slop: int, many: bool):
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, starts, terms, ends, places in pdf.itertuples(index=False):
                starts = np.frombuffer(starts, np.int64)
                seg = Segment(np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.int64), np.frombuffer(places, np.int32), int(starts[-1]))
                hit = np.zeros(int(starts[-1]) + 1, np.int32)
                exact_pairs, near_pairs = [], []
                for win, at, place, exact in seg.matches(w, slop):
                    np.add.at(hit, at[exact], 1)
                    np.add.at(hit, (at + w.size[win])[exact], -1)
                    n = w.own_at[win + 1] - w.own_at[win]
                    which = np.repeat(w.own_at[win], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pair = np.repeat(np.searchsorted(starts, place, side="right") - 1, n) * len(w.names) + w.own[which]
                    near_pairs.append(np.unique(pair))
                    exact_pairs.append(np.unique(pair[np.repeat(exact, n)]))
                marked = np.cumsum(hit) > 0
                covered = np.r_[0, np.cumsum(marked)]
                yield pd.DataFrame({
                    "__row": list(rows), "n_words": np.diff(starts) - gap, "n_hit": covered[starts[1:]] - covered[starts[:-1]],
                    "hits": [np.packbits(marked[a : b - gap]).tobytes() if many else b"" for a, b in zip(starts[:-1], starts[1:], strict=True)],
                    "items": _named(exact_pairs, len(rows), w.names), "near_items": _named(near_pairs, len(rows), w.names),
                })

    return answer


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted, that have an occurring window), near_items; a row for each row of docs.

    items: item_id, text. near_items also has items whose window's words stand within slop places of theirs.
    """
    found = _leaks(docs, items, width, slop, block_windows)
    return found.withColumn("doc_id", F.when(F.decode("__row", "UTF-8").startswith("v"), F.expr("substring(decode(__row, 'UTF-8'), instr(decode(__row, 'UTF-8'), '|') + 1)")).cast(docs.schema["doc_id"].dataType)).drop("__row")


def _row() -> Column:
    # the row's id travels as text of its own type, so that null ids and ids of any type come back as they were
    return F.encode(F.concat(F.when(F.col("doc_id").isNull(), "n").otherwise("v"), F.xxhash64("text").cast("string"), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")


def _leaks(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 2, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """As find_leaks, with __row in place of doc_id."""
    rows, gap = docs.select(_row().alias("__row"), "text"), width + slop
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    n_words = F.size(F.array_remove(F.split("text", PUNCT_ANYCASE), ""))
    n = -(-(items.agg(F.sum(F.greatest(n_words - width + 1, F.lit(1)))).first()[0] or 0) // block_windows) or 1

    def block(b: int) -> Windows:
        return Windows([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()], width)

    index = counts = found = None
    for b in range(n):
        w = block(b)
        if index is None:
            only = w.vocabulary if n == 1 and len(w.vocabulary) else None
            index = materialize(rows.mapInPandas(_segments(gap, only), SEGMENT), "postings")
            counts = index.select("__terms", "__ends").mapInPandas(_counts, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
            counts = materialize(counts, "counts") if n > 1 else counts
        # at most a row a term of the block comes to the driver
        freq = counts.mapInPandas(_those_of(w.vocabulary), "t long, n long").toPandas() if len(w.vocabulary) else pd.DataFrame({"t": [], "n": []})
        t = freq["t"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(t)
        w.by_rarity(t[by], freq["n"].to_numpy(np.int64)[by])
        part = index.mapInPandas(_answers(w, gap, slop, n > 1), ANSWER)
        part = materialize(part, "answers") if n > 1 else part
        found = part if found is None else found.unionByName(part)
    return found.drop("hits") if n == 1 else _merged(found, rows)


def _merged(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The hits of several blocks as one, for each row. Rows of equal doc_id and text have equal hits."""

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["n_hit"] = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in h])).sum()) for h in pdf.pop("hits")]
            yield pdf

    flat = lambda c: F.array_sort(F.flatten(F.collect_set(c))).alias(c)
    per = found.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.collect_set("hits").alias("hits"), flat("items"), flat("near_items"))
    return rows.select("__row").join(per.mapInPandas(together, MERGED), "__row")


def op10_positional_index(spark, sf_dir: str) -> DataFrame:
    f = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_distinct("items")
    near = F.size(F.array_distinct("near_items")).cast("bigint").alias("n_near_items")
    return f.select("doc_id", "n_words", "n_hit", near, F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g, w[i:i + least(len(w), 10) - 1] AS gl
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, win.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
dt AS (SELECT doc_id, w, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dw),
tf AS (SELECT t, count(*) AS c FROM dt GROUP BY t),
rare AS (SELECT item_id, gl, j, gl[j] AS t FROM (SELECT item_id, gl, j, coalesce(c, 0) AS c, min(coalesce(c, 0)) OVER (PARTITION BY item_id, gl) AS least
           FROM (SELECT item_id, gl, unnest(range(1, len(gl) + 1)) AS j FROM win) LEFT JOIN tf ON gl[j] = t) WHERE least > 0 QUALIFY row_number() OVER (PARTITION BY item_id, gl ORDER BY c, j) = 1),
near AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM rare JOIN dt ON rare.t = dt.t
           WHERE list_bool_and(list_transform(range(1, len(gl) + 1), lambda k: k = j OR (p - j + k + 2 >= 1 AND list_contains(w[greatest(p - j + k - 2, 1):greatest(p - j + k + 2, 1)], gl[k]))))) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(words.c, 0)::BIGINT AS n_hit, coalesce(near.c, 0)::BIGINT AS n_near_items, coalesce(its.c, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, words.c IS NOT NULL AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id LEFT JOIN near ON dw.doc_id = near.doc_id
"""


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without an exact match, each by its own text, whatever rows share its doc_id."""
    bad = _leaks(docs, items, **{"slop": 0, **options}).where("n_hit > 0").select("__row").distinct()
    return docs.withColumn("__row", _row()).join(bad, "__row", "left_anti").drop("__row")
