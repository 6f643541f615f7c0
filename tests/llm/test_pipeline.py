"""The pipeline's rows against all five stages in plain Python, on whole small tables."""

import hashlib
import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline

CUTS = {
    "symbols": (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1), "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25), "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeats": (0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.12, 0.1), "long_words": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0),
}


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def lowered(text):
    return (text or "").encode().lower().decode()


def measured(text):
    """Whether the base rule fails, and the scores."""
    w, t = words(text), text or ""
    n = len(w)
    seen = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeats = len({i + k for i in range(n - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)})
    lines = [x for x in t.split("\n") if words(x)]
    chars = sum(map(len, w))
    if n < 10 or 100 * repeats > 20 * n:
        return True, {}
    return False, {"symbols": sum(c in "#*$%&|<>" for c in t) / n, "capitals": sum("A" <= c <= "Z" for c in t) / chars, "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeats": repeats / n, "long_words": chars / n}


def quality(docs, labels, risk=0.025, alpha=0.05):
    got = {d["doc_id"]: measured(d["text"]) for d in docs}
    over = lambda s, p: any(s[r] > c[p] for r, c in CUTS.items())
    p_values, gains = {}, {}
    for lang in {d["lang"] for d in docs}:
        mine = [got[d["doc_id"]][1] | {"good": labels[d["doc_id"]]} for d in docs if d["lang"] == lang and d["doc_id"] in labels and not got[d["doc_id"]][0]]
        good, bad = [m for m in mine if m["good"]], [m for m in mine if not m["good"]]
        if not mine:
            continue
        p_values[lang], gains[lang] = [], []
        for p in range(8):
            k, n = sum(over(m, p) for m in good), len(good)
            tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k < n * risk else 1.0
            p_values[lang].append(max([tail, *p_values[lang][-1:]]))
            gains[lang].append(sum(over(m, p) for m in bad) / max(len(bad), 1) - k / max(n, 1))
    level, left = {}, sorted(p_values, key=lambda x: (p_values[x][-1], x is None, x))
    while left and p_values[left[0]][-1] <= alpha / len(left):
        level[left[0]] = alpha / len(left)
        left = left[1:]
    level |= {x: alpha / len(left) for x in left}
    policy = {}
    for lang, ps in p_values.items():
        usable = [p for p in range(8) if ps[p] <= level[lang] and gains[lang][p] > 0]
        if usable:
            policy[lang] = max(usable, key=lambda p: (gains[lang][p], -p))
    return [d for d in docs if not got[d["doc_id"]][0] and not (d["lang"] in policy and over(got[d["doc_id"]][1], policy[d["lang"]]))], policy


def line_dedup(docs):
    seen, out = set(), []
    for d in sorted(docs, key=lambda x: x["doc_id"]):
        lines = d["text"].split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for j in range(len(at) - 2):
            w = tuple(lines[i].strip(" \t\n\x0b\x0c\r") for i in at[j : j + 3])
            if w in seen:
                gone |= set(at[j : j + 3])
            seen.add(w)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append(d | {"text": text, "n_chars": len(text)})
    return out


def near_dedup(docs):
    sets = {}
    for d in docs:
        w = words(lowered(d["text"]))
        sets[d["doc_id"]] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                comp[hi] = lo
    return [d for d in docs if root(d["doc_id"]) == d["doc_id"]]


def decontaminate(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    windows = {}
    for t in items:
        w = split(t)
        k = min(10, len(w))
        windows.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k)
    hit = lambda w: any(tuple(w[i : i + k]) in s for k, s in windows.items() if k for i in range(len(w) - k + 1))
    return [d for d in docs if not hit(split(d["text"]))]


def mix(docs):
    unit, sizes = 1 << 30, {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(words(d["text"]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(3 * sizes[s]) for s in full}
        rest -= sum(3 * sizes[s] for s in full)
        open_ -= full
    out = []
    for s in order:
        mine = sorted((d for d in docs if d["source"] == s), key=lambda d: (len(words(d["text"])), hashlib.md5(f"mix:{d['doc_id']}".encode()).hexdigest()))
        rate = math.floor(target[s] / sizes[s] * unit) if sizes[s] else 0
        u = int(hashlib.md5(f"mix:{s or ''}".encode()).hexdigest()[:7], 16) * 4
        for n, d in enumerate(mine):
            copies = ((u + n * (rate % unit)) % unit + rate) // unit
            out += [d | {"copy": c} for c in range(1, copies + 1)]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pipeline_by_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    docs, items = (pq.read_table(f"{d}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    labels = {}
    for x in pq.read_table(f"{d}/labels.parquet").to_pylist():
        if x["quality"] is not None:
            labels[x["doc_id"]] = min(x["quality"], labels.get(x["doc_id"], 1))
    kept, policy = quality(docs, labels)
    assert (len(policy) > 0) == (sf == "sf0.01")  # the smaller table has too few labels
    want = mix(decontaminate(near_dedup(line_dedup(kept)), [x["text"] for x in items]))
    got = corpus_pipeline.run(spark, d)
    cols = ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert got.columns == cols
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(x[c] for c in cols) for x in want)
