"""Near-duplicate documents by MinHash, banding, verification and components.

A document's set are its distinct shingles of consecutive words (A-Z
lower-cased), as 64-bit hashes. Equal sets are found first and stand for all
their documents by the smallest doc_id. The minima of `bands` x `rows`
universal hash functions form a signature; sets that agree on a whole band
share a bucket and are candidates. Candidates whose signatures agree enough
are verified on their full sets.

No bucket is expanded into all its pairs. A bucket is a star around a pivot
first; links found join sets into components, and only buckets whose sets are
still in several components go on, with another pivot. At last each set is
written as what it lacks of and adds to the shingles that most sets of its
group hold (see `_apart`): sets that need no common difference to be linked are
linked with the one nearest that majority, and all others are found by their
rarest common differences. Pairs within a component need no test, as components
are the result; so no link between components is lost.

Cases: a null, empty or blank text has no shingles, is linked with nothing and
kept; a text of fewer words than a shingle has its whole sequence as its one
shingle; rows of one doc_id are one vertex, also with different texts, and
linked as any of these is (`deduplicated` tells them apart); a row without doc_id is linked with
nothing and kept; an empty table gives an empty result; names that start with
two underscores are reserved.

At a similarity of 0.8 a pair misses all of 25 bands of 4 with probability
(1 - 0.8^4)^25 = 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_enough, table
from .components import components

_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers["p"]) < n:
        for k, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            x = np.full(2 * n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["q"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _MIX
    return x ^ (x >> np.uint64(29))


#: Two sets and the components they are in.
_PAIR, _PAIR_DDL = ["u", "v", "cu", "cv"], "u long, v long, cu long, cv long"

#: Bytes that are not white space.
NOT_SPACE = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])


def word_hashes(b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin, and a 64-bit hash of each; words are runs of bytes marked in the table inside."""
    marked = np.zeros(len(b) + 2, bool)
    marked[1:-1] = inside[b]
    edge = np.flatnonzero(marked[1:] != marked[:-1])
    start, end = edge[::2], edge[1::2]
    p, q = _grown(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=sums[1:])
    return start, _mixed((sums[end] - sums[start]) * q[start])


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    _, words = word_hashes(np.frombuffer((text or "").encode().lower(), np.uint8), NOT_SPACE)
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(width, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h = _mixed(h * _MULT + words[i : n + i])
    return np.unique(h)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 2048):  # stays in cache
        np.minimum(low, ((a[:, None] * s[None, i : i + 2048] + b[:, None]) >> _S32).min(axis=1), out=low)
    return low.astype(np.uint32)


def _sketch(width: int, n: int):
    rng = np.random.default_rng(77)
    a, b = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, no, t in zip(pdf["__v"], pdf["__no_id"], pdf["text"], strict=True):
                s = shingles(t, width)
                f1, f2 = (int((_mixed(s ^ m) * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for m in (_MULT, _MIX))
                out.append((i, no, len(s), f1, f2, signature(s, a, b).tobytes() if len(s) else None))
            yield pd.DataFrame(out, columns=["__v", "__no_id", "n_shingles", "__f1", "__f2", "__sig"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"__v": pdf["__v"], "__set": [shingles(t, width).tobytes() for t in pdf["text"]]})

    return run


def _alike(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(len(pdf), -1) for c in ("__sig1", "__sig2"))
                yield pdf.loc[(x == y).mean(axis=1) >= least, _PAIR]

    return run


def _linked(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["__set1"], pdf["__set2"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                k = np.searchsorted(x, y)
                k[k == len(x)] = 0
                both = int((x[k] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(ok, bool), _PAIR]

    return run


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of a batch's sets hold a shingle, by group."""
    for pdf in batches:
        for k, g in pdf.groupby("__k"):
            e, n = np.unique(np.frombuffer(b"".join(g["__set"]), np.int64), return_counts=True)
            yield pd.DataFrame({"__k": k, "__e": e, "__n": n})


def _differences(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, base in zip(pdf["__set"], pdf["__base"], strict=True):
                s, base = np.frombuffer(s, np.int64), np.asarray([] if base is None else base, np.int64)
                d = np.setxor1d(s, base, assume_unique=True)
                both = (len(s) + len(base) - len(d)) // 2
                out.append((percent * len(s) - (100 + percent) * both, (100 + percent) * len(base), d))
            yield pdf[["__k", "__v", "__c"]].assign(__a=[x[0] for x in out], __t=[x[1] for x in out], __d=[x[2] for x in out])

    return run


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that join all linked sets of different components (cu, cv) of each group in members(__k, __v, __c, __set).

    A group is named by one of its components, best its largest; its base B are
    the shingles that over half its sets hold. With n shingles, b of them in B,
    sets x and y share b_x + b_y - |B| shingles, and besides as many as they
    share differences from B (what they lack of it or add to it). So they are
    linked if a_x + a_y + t is at most (100 + percent) times the differences
    shared, where a = percent * n - (100 + percent) * b, t = (100 + percent) * |B|.

    Where that sum is at most 0 for x and y, it is so for each of them and the
    set of the least a: these pairs stand for all such. Others share a
    difference, and from the first they share, by frequency, both have at least
    as many left as they need. Any B gives the same links, the majority's
    with few differences.
    """
    counts = members.select("__k", "__set").mapInPandas(_counts, "__k long, __e long, __n long")
    # a shingle of over half of two or more sets is in two at least
    counts = counts.groupBy("__k", "__e").agg(F.sum("__n").alias("__n")).where("__n > 1")
    sizes = members.groupBy("__k").agg(F.count("*").alias("__of"))
    base = counts.join(sizes, "__k").where("2 * __n > __of").groupBy("__k").agg(F.collect_list("__e").alias("__base"))
    sets = materialize(members.join(materialize(base, "bases"), "__k", "left").mapInPandas(_differences(percent), "__k long, __v long, __c long, __a long, __t long, __d array<long>"), "differences")
    best = materialize(sets.groupBy("__k").agg(F.min_by(F.struct("__v", "__c"), F.struct("__a", "__v")).alias("__p"), F.min("__a").alias("__least")), "best")
    near = sets.join(best, "__k").where((F.col("__a") + F.col("__least") + F.col("__t") <= 0) & (F.col("__c") != F.col("__p")["__c"]))
    near = near.select(F.col("__p")["__v"].alias("u"), F.col("__v").alias("v"), F.col("__p")["__c"].alias("cu"), F.col("__c").alias("cv"))
    each = sets.select("__k", "__v", "__c", "__a", "__t", F.explode("__d").alias("__e"))
    often = each.groupBy("__k", "__e").agg(F.count("*").alias("__n"), F.max(F.col("__c") != F.col("__k")).alias("__out")).where("__n > 1 and __out")
    left = F.row_number().over(Window.partitionBy("__k", "__v").orderBy(F.desc("__n"), F.desc("__e")))
    each = each.join(often, ["__k", "__e"]).withColumn("__left", left).join(best.select("__k", "__least"), "__k")
    each = materialize(each.where(F.col("__a") + F.col("__least") + F.col("__t") <= (100 + percent) * F.col("__left")).select("__k", "__e", "__v", "__c", "__a", "__t", "__left"), "postings")
    x = each.where("__c <> __k").select("__k", "__e", F.col("__v").alias("u"), F.col("__c").alias("cu"), F.col("__a").alias("__a1"), F.col("__left").alias("__left1"))
    y = each.withColumnsRenamed({"__v": "v", "__c": "cv"})
    need = F.col("__a1") + F.col("__a") + F.col("__t")
    enough = (need > 0) & (need <= (100 + percent) * F.least("__left1", "__left"))
    far = x.join(y, ["__k", "__e"]).where(enough & F.expr("cu <> cv and (cv = __k or u < v)")).select(*_PAIR)
    return near.union(far.distinct())


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 25, rows: int = 4, pivots: int = 3, alike: float = 0.6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the smallest doc_id of its component); a row for each row of docs.

    alike: candidates of which a smaller share of minima agrees are dropped;
    at a true similarity of 0.8 that loses a pair with probability 3e-6.
    """
    # ids without nulls: pandas would make those of a batch with nulls floats
    vs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("__v"), F.col("doc_id").isNull().alias("__no_id"), "text")
    sk = materialize(vs.mapInPandas(_sketch(width, bands * rows), "__v long, __no_id boolean, n_shingles long, __f1 long, __f2 long, __sig binary"), "sketches")
    sk = sk.withColumn("__v", F.when(~F.col("__no_id"), F.col("__v")))
    vs = vs.where("not __no_id").select("__v", "text")
    same = ["__f1", "__f2", "n_shingles"]
    # equal sets have equal signatures, so any member's serves
    rep = sk.where("n_shingles > 0 and __v is not null").groupBy(*same).agg(F.min("__v").alias("__rep"), F.first("__sig").alias("__sig"))
    rep = materialize(rep, "sets")
    sig = rep.select(F.col("__rep").alias("__v"), "n_shingles", "__sig")
    step = 4 * rows
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("__sig", i * step + 1, step)) for i in range(bands)])).alias("__b")
    banded = sig.select("__v", bucket)
    shared = materialize(banded.groupBy("__b").agg(F.min("__v").alias("__first"), F.max("__v").alias("__last")).where("__first < __last"), "buckets")
    # buckets of one set are gone from here on
    banded = materialize(banded.join(shared, "__b").select("__b", "__v", "__first"), "banded")

    def side(pairs: DataFrame, what: DataFrame, at: str, suffix: str) -> DataFrame:
        return pairs.join(what.select(F.col("__v").alias(at), *[F.col(c).alias(c + suffix) for c in what.columns if c != "__v"]), at)

    def full(ids: DataFrame) -> DataFrame:
        """The sets (__v, __set) of distinct ids (__v)."""
        # a million ids are 8 MB; more are joined by a shuffle of the texts
        wanted = vs.join(F.broadcast(ids) if small_enough(ids, 1_000_000) else ids, "__v")
        return wanted.mapInPandas(_sets(width), "__v long, __set binary")

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that are links, by length, signature and then full sets, with their components (cu, cv)."""
        p = side(side(pairs.distinct(), sig, "u", "1"), sig, "v", "2")
        p = p.where(100 * F.least("n_shingles1", "n_shingles2") >= percent * F.greatest("n_shingles1", "n_shingles2"))
        p = materialize(p.select(*_PAIR, "__sig1", "__sig2").mapInPandas(_alike(alike), _PAIR_DDL), "candidates")
        sets = materialize(full(materialize(p.select(F.col("u").alias("__v")).union(p.select("v")).distinct(), "wanted")), "full")
        return materialize(side(side(p, sets, "u", "1"), sets, "v", "2").mapInPandas(_linked(percent), _PAIR_DDL), "links")

    def placed(at: DataFrame, by: DataFrame) -> DataFrame:
        """at with the component __c replaced by the one that it is now part of."""
        return at.join(by.select(F.col("u").alias("__c"), "component"), "__c", "left").withColumn("__c", F.coalesce("component", "__c")).drop("component")

    found = links(banded.where("__v <> __first").select(F.col("__first").alias("u"), F.col("__v").alias("v"), F.col("__first").alias("cu"), F.col("__v").alias("cv")))
    steps = [materialize(components(found), "components")]
    at = placed(banded.select("__b", "__v", F.col("__v").alias("__c")), steps[0])
    for turn in range(pivots):
        at = materialize(at, "placed")
        pivot = F.min_by(F.struct("__v", "__c"), F.struct(F.xxhash64(F.lit(turn), "__v"), "__v"))
        open_ = materialize(at.groupBy("__b").agg(F.min("__c").alias("__lo"), F.max("__c").alias("__hi"), pivot.alias("__p")).where("__lo < __hi"), "open")
        if open_.isEmpty():
            break
        at = materialize(at.join(open_.select("__b", "__p"), "__b"), "opened")
        if turn < pivots - 1:
            rest = at.where(F.col("__c") != F.col("__p")["__c"])
            pairs = rest.select(F.col("__p")["__v"].alias("u"), F.col("__v").alias("v"), F.col("__p")["__c"].alias("cu"), F.col("__c").alias("cv"))
        else:
            # buckets with the same largest component form a group
            most = at.groupBy("__b", "__c").count().groupBy("__b").agg(F.max_by("__c", F.struct("count", "__c")).alias("__k"))
            most = materialize(most, "most")  # so that the join deals both sides and Spark can split a hot bucket
            members = materialize(at.join(most, "__b").select("__k", "__v", "__c").distinct(), "members")
            sets = materialize(full(members.select("__v").distinct()), "groups")
            pairs = _apart(materialize(members.join(sets, "__v"), "grouped"), percent)
        swap = F.col("u") > F.col("v")
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(swap, F.col("cv")).otherwise(F.col("cu")).alias("cu"), F.when(swap, F.col("cu")).otherwise(F.col("cv")).alias("cv"))
        found = links(pairs)
        # the components found so far are the vertices of the next ones
        steps.append(materialize(components(found.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "components"))
        at = placed(at.drop("__p"), steps[-1])
    own = sk.select("__v", *same).withColumn("__on", F.col("__v").isNotNull())
    out = own.join(rep.select(*same, "__rep", F.lit(True).alias("__on")), [*same, "__on"], "left").select("__v", "n_shingles", F.coalesce("__rep", "__v").alias("__c"))
    for by in steps:
        out = placed(out, by)
    out = out.select(F.col("__v").alias("doc_id"), "n_shingles", F.col("__c").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash_components(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each document that is kept.

    Of rows with equal doc_id and text any one stays; texts that share a doc_id
    are documents of their own, which come last in their group;
    rows without doc_id all stay.
    """
    keyed = docs.withColumn("__h", text_hash())
    ids = keyed.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__d"), F.col("__h").alias("__g")).count()
    ids = materialize(ids.groupBy("__d").agg(F.count(F.lit(1)).alias("__texts"), F.max("count").alias("__rows")).where("__texts > 1 or __rows > 1"), "repeated")
    if ids.isEmpty():
        gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__d")).distinct()
        return docs.join(gone, F.col("doc_id") == F.col("__d"), "left_anti")
    # numbers from 2^62 on stand for texts that share a doc_id
    own = F.when(F.col("__texts") > 1, F.shiftrightunsigned(F.xxhash64("doc_id", "__h"), 2).bitwiseOR(F.lit(1 << 62))).otherwise(F.col("doc_id").cast("bigint"))
    keyed = keyed.join(ids, F.col("doc_id") == F.col("__d"), "left").withColumn("__own", own).drop("__d")
    gone = near_duplicates(keyed.select(F.col("__own").alias("doc_id"), "text"), **options).where(~F.col("kept")).select(F.col("doc_id").alias("__d")).distinct()
    left = keyed.join(gone, F.col("__own") == F.col("__d"), "left_anti")
    # only rows that may be repeated are compared, which combines before it shuffles
    twice = left.where("__rows > 1").dropDuplicates(["__own"])
    return left.where("__rows is null or __rows = 1").union(twice).select(docs.columns)


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_UP.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN link ON b = u),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON d.doc_id = comp.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
