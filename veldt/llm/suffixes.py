"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte is removed if it is covered by a string of `length` bytes that starts
anywhere else too, in any document or its own. Every such string holds an
anchor: of the `width` positions at its beginning the one with the least hash
of the eight bytes there, the first of equals. As equal strings choose the
anchor alike, only suffixes that begin at anchors are compared, about one in
width / 2 positions. For each anchor the strings that chose it are known; they
span its context, from `dhi` bytes before it to length - `dlo` bytes after it.

Anchors whose first bytes occur nowhere else are dropped by counting a hash of
these bytes; that is all that hashing settles. The others are sorted as
suffixes: each task sorts its own, keeps one of those whose contexts it holds
twice or more (these are covered whatever other tasks hold), front-codes the
runs (a common prefix's length and the rest) and sends them to the task of their
first bytes, which merges them with a loser tree. The tree's players know how
long a prefix they share with the last winner; the longer one wins without a
look at the bytes, and equal ones are compared beyond that prefix only. Of the
sorted suffixes, with their common prefixes, each string's equals agree on the
bytes after the anchor, hence lie in one stretch, and on the bytes before it.

However often a passage repeats, a task sends one suffix for each different
context. First bytes that more than `hot` anchors share, with ever different
contexts, would still meet in one merging task; each of their strings is counted
by its hash instead, which combines before it shuffles and has no hot task.

Cases: null counts as empty; texts shorter than length lose nothing; repeated
rows are documents of their own, so their strings do occur elsewhere; an empty
table gives an empty result; other columns are not looked at, and names that
start with two underscores are reserved. Strings are compared by 64-bit hashes
within groups of equal 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, small_enough, table, through_pandas
from .minhash import _BYTE, _grown, _mixed

_EIGHT = 8
#: Suffixes that one merging task may get on average.
MERGE_ROWS = 40_000
#: Hashes of first bytes that may be broadcast, 8 bytes each.
BROADCAST_ROWS = 2_000_000
#: Anchors that may share their first bytes in one merging task.
HOT = 200_000


def _sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = _grown(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=sums[1:])
    return sums, q


def anchors(b: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """p, dlo, dhi of each anchor, and the hash of the length - width + 1 bytes from it."""
    n = len(b)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    sums, q = _sums(b)
    m = n - length + width  # positions that a string can choose
    key = (_mixed((sums[_EIGHT : m + _EIGHT] - sums[:m]) * q[:m]) & ~np.uint64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
    blocks = np.full(-(-m // width) * width, ~np.uint64(0), np.uint64)
    blocks[:m] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - length + 1
    chosen = (np.minimum(behind[:k], ahead[width - 1 : width - 1 + k]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    p = chosen[first]
    last = np.r_[first[1:], k] - 1
    part = length - width + 1
    near = _mixed((sums[p + part] - sums[p]) * q[p])
    return p, p - last, p - first, near


ANCHORS = "__id long, __h long, __near array<long>, __p array<int>, __lo array<int>, __hi array<int>"


def _anchored(length: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, h, t in zip(pdf["__id"], pdf["__h"], pdf["text"], strict=True):
                p, lo, hi, near = anchors(np.frombuffer(t.encode(), np.uint8), length, width)
                if len(p):
                    out.append((i, h, near.view(np.int64), p.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)))
            yield pd.DataFrame(out, columns=["__id", "__h", "__near", "__p", "__lo", "__hi"])

    return run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which known bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while n - known > 1:
        mid = (known + n) // 2
        if a[known:mid] == b[known:mid]:
            known = mid
        else:
            n = mid
    return known


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of sorted strings: common prefix with the one before, the rests, and the rests' lengths."""
    lcp = [0][: len(strings)] + [common_prefix(a, b, 0) for a, b in zip(strings, strings[1:], strict=False)]
    rest = [s[k:] for s, k in zip(strings, lcp, strict=True)]
    return np.array(lcp, np.int32), b"".join(rest), np.array([len(r) for r in rest], np.int32)


def decoded(lcp: np.ndarray, rest: bytes, size: np.ndarray) -> list[bytes]:
    out, at, last = [], 0, b""
    for k, n in zip(lcp.tolist(), size.tolist(), strict=True):
        last = last[:k] + rest[at : at + n]
        at += n
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with the string before) of all strings in order, by a loser tree.

    runs: sorted strings and, for each, the common prefix with the one before.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    know = [0] * size  # prefix that a run's string shares with the last winner
    live = [k < len(runs) and len(runs[k][0]) > 0 for k in range(size)]

    def wins(x: int, y: int) -> bool:
        """Whether run x's string comes before run y's; the loser's prefix becomes what it shares with the winner."""
        if not live[y]:
            return True
        if not live[x]:
            return False
        if know[x] != know[y]:
            return know[x] > know[y]
        a, b = runs[x][0][at[x]], runs[y][0][at[y]]
        k = common_prefix(a, b, know[x])
        first = k == len(a) if k == min(len(a), len(b)) else a[k] < b[k]
        if k == len(a) == len(b):
            first = x < y
        know[y if first else x] = k
        return first

    loser = [0] * size
    up = list(range(size))
    while len(up) > 1:  # play from the leaves; node i of a level of n is loser[n + i] of half the level's size
        n = len(up) // 2
        nxt = []
        for i in range(n):
            x, y = up[2 * i], up[2 * i + 1]
            won = wins(x, y)
            loser[n + i] = y if won else x
            nxt.append(x if won else y)
        up = nxt
    top = up[0]
    while live[top]:
        yield top, at[top], know[top]
        at[top] += 1
        if at[top] < len(runs[top][0]):
            know[top] = runs[top][1][at[top]]
        else:
            live[top] = False
        node = (size + top) // 2
        while node:
            other = loser[node]
            if wins(other, top):
                loser[node], top = top, other
            node //= 2


#: A text and the anchors asked for; times: how many rows are this text.
WANT = ["__id", "__h", "text", "__near", "__p", "__lo", "__hi", "__times"]
RUNS = "__part int, n int, lcp binary, rest binary, size binary, before binary, meta binary, known binary"
#: Bytes of runs that a task hands over at once.
FRAME_BYTES = 1 << 20


def _runs(length: int, parts: int, most: int = 30_000):
    """Contexts of the anchors asked for, as sorted front-coded runs for each part, with the ranges already known to be covered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes, bytes, tuple]] = []

        def flush() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: x[:3])
            out, size, a = [], 0, 0
            while a < len(held):
                part, keep, known, e = held[a][0], [], [], a
                while e < len(held) and held[e][0] == part:
                    c = e + 1
                    while c < len(held) and held[c][:3] == held[e][:3]:
                        c += 1
                    i, h, p, lo, hi, times = held[e][3]
                    done = c - e > 1 or times > 1
                    if done:
                        known += [(m[0], m[1], m[2] - m[4], m[2] - m[3] + length) for m in (x[3] for x in held[e:c])]
                    keep.append((held[e][1], held[e][2], (i, h, p, lo, hi, int(done))))
                    e = c
                lcp, rest, sizes = front_coded([x[0] for x in keep])
                before, meta = b"".join(x[1] for x in keep), np.array([x[2] for x in keep], np.int64)
                out.append((part, len(keep), lcp.tobytes(), rest, sizes.tobytes(), before, meta.tobytes(), np.array(known, np.int64).tobytes()))
                size, a = size + len(rest) + len(before) + 56 * len(keep) + 32 * len(known), e
                if size >= FRAME_BYTES or a == len(held):
                    yield pd.DataFrame(out, columns=["__part", "n", "lcp", "rest", "size", "before", "meta", "known"])
                    out, size = [], 0
            held.clear()

        for pdf in batches:
            for i, h, t, near, at, los, his, times in zip(*[pdf[c] for c in WANT], strict=True):
                b = t.encode()
                for part, p, lo, hi in zip((near % parts).tolist(), at.tolist(), los.tolist(), his.tolist(), strict=True):
                    held.append((part, b[p : p + length - lo], b[p - hi : p], (i, h, p, lo, hi, times)))
                    if len(held) >= most:
                        yield from flush()
        if held:
            yield from flush()

    return run


def _starts(length: int):
    """A hash of each string that chose one of the anchors asked for, and where it begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, h, t, _, at, los, his, times in zip(*[pdf[c] for c in WANT], strict=True):
                sums, q = _sums(np.frombuffer(t.encode(), np.uint8))
                for a in range(0, len(at), 1000):
                    ranges = zip((at - his)[a : a + 1000].tolist(), (at - los)[a : a + 1000].tolist(), strict=True)
                    begin = np.repeat(np.concatenate([np.arange(x, y + 1) for x, y in ranges]), times)
                    yield pd.DataFrame({"__s": _mixed((sums[begin + length] - sums[begin]) * q[begin]).view(np.int64), "__id": i, "__h": h, "__from": begin.astype(np.int32)})

    return run


COVER = "__id long, __h long, __from int, __to int"


def _merged(length: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, before, meta, base = [], [], [], [0]
        for _, n, lcp, rest, size, left, m, _ in pdf.itertuples(index=False):
            lcp = np.frombuffer(lcp, np.int32)
            runs.append((decoded(lcp, rest, np.frombuffer(size, np.int32)), lcp.tolist()))
            before.append(left)
            meta.append(np.frombuffer(m, np.int64).reshape(n, 6))
            base.append(base[-1] + n)
        order, lcp = [], []
        for r, i, k in merge_runs(runs):
            order.append(base[r] + i)
            lcp.append(k)
        del runs
        meta, lcp = np.concatenate(meta)[order], np.array(lcp)
        lo, hi = meta[:, 3], meta[:, 4]
        # the bytes before each anchor, nearest first
        flat = np.frombuffer(b"".join(before), np.uint8)
        left_end = np.cumsum(np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 6)[:, 4] for m in pdf["meta"]]))[order]
        power, _ = _grown(width + 1)
        hashed, equal = np.zeros(len(order), np.uint64), np.zeros((len(order), width), bool)
        for d in range(width):
            if d:
                use = hi >= d
                hashed[use] += _BYTE[flat[left_end[use] - d]] * power[d]
            act = np.flatnonzero((lo <= d) & (d <= hi))
            if len(act) < 2:
                continue
            key = _mixed(np.cumsum(lcp < length - d).astype(np.uint64)[act] * np.uint64(0x9E3779B97F4A7C15) + hashed[act])
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            equal[act[by], d] = np.r_[False, same] | np.r_[same, False]
        equal[meta[:, 5] > 0] = False  # known already
        rows, out = np.flatnonzero(equal.any(axis=1)), []
        for r in rows:
            d = np.flatnonzero(equal[r])
            cut = np.flatnonzero(np.diff(d) > 1)
            i, h, p = meta[r, :3]
            out += [(i, h, p - y, p - x + length) for x, y in zip(d[np.r_[0, cut + 1]], d[np.r_[cut, len(d) - 1]], strict=True)]
        known = np.frombuffer(b"".join(pdf["known"]), np.int64).reshape(-1, 4)
        return pd.DataFrame(np.concatenate([np.array(out, np.int64).reshape(-1, 4), known]), columns=["__id", "__h", "__from", "__to"]).astype({"__from": np.int32, "__to": np.int32})

    return run


def repeats(docs: DataFrame, length: int = 400, width: int = 280, hot: int = HOT) -> DataFrame:
    """__id, __h, __from, __to: byte ranges of the keyed docs that repeated strings cover; ranges may overlap."""
    spark = docs.sparkSession
    texts = docs.select("__id", "__h", "text").where(F.octet_length("text") >= length)
    found = materialize(texts.mapInPandas(_anchored(length, width), ANCHORS), "anchors")
    a = found.select("__id", "__h", F.inline(F.arrays_zip("__near", "__p", "__lo", "__hi")))
    # a row for first bytes that occur again, written out
    again = materialize(a.groupBy("__near").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__near", (F.col("__n") > hot).alias("__hot")), "again")
    # rows of equal id and text are one text that occurs several times
    copies = materialize(found.groupBy("__id", "__h").agg(F.count(F.lit(1)).alias("__times")).where("__times > 1"), "copies")
    repeated = not copies.isEmpty()
    once = (lambda df: df.dropDuplicates(["__id", "__h"])) if repeated else (lambda df: df)
    a = once(found).select("__id", "__h", F.inline(F.arrays_zip("__near", "__p", "__lo", "__hi")))
    # few are broadcast; more are joined by a shuffle whose hot keys Spark can split
    want = a.join(F.broadcast(again) if small_enough(again, BROADCAST_ROWS) else again, "__near").groupBy("__id", "__h").agg(F.collect_list(F.struct("__near", "__p", "__lo", "__hi", "__hot")).alias("__want"), F.count(F.lit(1)).alias("__n"), F.max("__hot").alias("__hot"))
    want = want.join(copies, ["__id", "__h"], "left") if repeated else want.withColumn("__times", F.lit(1).cast("bigint"))
    want = materialize(want, "want")
    n, any_hot = want.agg(F.sum("__n"), F.max("__hot")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // MERGE_ROWS))
    with_text = once(texts.join(want.select("__id", "__h", "__want", F.coalesce("__times", F.lit(1)).alias("__times")), ["__id", "__h"]))

    def asked(is_hot: bool) -> DataFrame:
        # plain arrays, which pandas holds without an object for each anchor
        w = with_text.withColumn("__want", F.filter("__want", lambda x: x["__hot"] == F.lit(is_hot))) if any_hot else with_text
        return w.where(F.size("__want") > 0).select("__id", "__h", "text", *[F.col(f"__want.{c}").alias(c) for c in WANT[3:7]], "__times")

    cover = asked(False).mapInPandas(_runs(length, parts), RUNS).groupBy("__part").applyInPandas(_merged(length, width), COVER)
    if any_hot:
        each = materialize(asked(True).mapInPandas(_starts(length), "__s long, __id long, __h long, __from int"), "starts")
        often = materialize(each.groupBy("__s").count().where("count > 1").select("__s"), "often")
        cover = cover.union(each.join(often, "__s").select("__id", "__h", "__from", F.col("__from") + length))
    return cover


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, cover in zip(pdf.pop("text"), pdf.pop("__cover"), strict=True):
            b = (text or "").encode()
            spans: list[list[int]] = []
            for r in sorted((r["__from"], r["__to"]) for r in cover) if cover is not None else ():
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = [], 0
            for x, y in spans:
                kept.append(b[at:x])
                at = y
            kept = b"".join([*kept, b[at:]])
            out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
        yield pdf.join(pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"], index=pdf.index))


def remove_repeats(docs: DataFrame, length: int = 400, width: int = 280, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (byte ranges removed) for each row of docs."""
    k = keyed(docs.select("doc_id", "text"))
    cover = repeats(k, length, width, hot).groupBy(F.col("__id").alias("__i"), F.col("__h").alias("__k")).agg(F.collect_set(F.struct("__from", "__to")).alias("__cover"))
    joined = k.join(cover, (F.col("__id") == F.col("__i")) & (F.col("__h") == F.col("__k")), "left")
    return through_pandas(joined, _cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>", "text", "__cover")


def op6_suffix_merge_sort(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
