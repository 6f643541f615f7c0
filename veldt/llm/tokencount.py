"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. The tokens' byte lengths give their
character spans; the document's sections are spans of characters that cover
it. Both lists are sorted, so joining the intervals is one merge. A token
that crosses a boundary is allocated by rule: `start`, to the section of its
first character; `most`, to the section with most of its characters, the
earlier of equals; `share`, to each section by its share of the characters. A
token that begins inside a character counts that character as its first.

Sections are lines, each with its line feed; in general any list of starts.

Cases: a null text has no rows; an empty text has one empty section without
tokens; empty tables give empty results; repeated rows are counted one by one;
other columns are not looked at. The vocabulary file is read on each worker
from `vocabulary`, a path that all of them see.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, through_pandas

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer pattern of the byte-level BPE vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The encode function, and the number of bytes of each token."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, length


def lines(b: np.ndarray) -> np.ndarray:
    """Bytes at which lines begin; what follows the last line feed is a line only if it has a byte."""
    at = np.r_[0, np.flatnonzero(b == 10) + 1]
    return at[(at < len(b)) | (at == 0)]


def attribute(token_bytes: np.ndarray, b: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """For each section, given by its first byte: first_char, n_chars, and the tokens by each rule."""
    chars = np.r_[0, np.cumsum((b & 0xC0) != 0x80)]  # characters begun before each byte
    n = len(starts)
    first = chars[starts]
    end = np.r_[first[1:], chars[-1]]
    ends = np.cumsum(token_bytes)
    if not len(ends):
        zero = np.zeros(n, np.int64)
        return {"first_char": first, "n_chars": end - first, "start": zero, "most": zero, "share": np.zeros(n)}
    lo = chars[ends - token_bytes + 1] - 1  # the character that holds the token's first byte
    hi = chars[ends]
    here = np.searchsorted(first, lo, side="right") - 1
    last = np.searchsorted(first, hi - 1, side="right") - 1
    start = np.bincount(here, minlength=n)
    most, share = start.copy(), start.astype(float)
    for t in np.flatnonzero(last > here):
        k = np.arange(here[t], last[t] + 1)
        part = np.minimum(end[k], hi[t]) - np.maximum(first[k], lo[t])
        most[here[t]] -= 1
        most[k[part.argmax()]] += 1
        share[here[t]] -= 1
        share[k] += part / part.sum()
    return {"first_char": first, "n_chars": end - first, "start": start, "most": most, "share": share}


def _attributed(vocabulary: str, rule: str, sections: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, length = encoder(vocabulary)
        for pdf in batches:
            ids, found, n = [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if text is None:
                    continue
                b = np.frombuffer(text.encode(), np.uint8)
                got = attribute(length[np.array(encode(text), np.int64)], b, sections(b))
                ids.append(doc_id)
                found.append(got)
                n += len(got["start"])
                if n > 50_000:
                    yield _frame(ids, found, rule)
                    ids, found, n = [], [], 0
            if ids:
                yield _frame(ids, found, rule)

    return run


def _frame(ids: list, found: list[dict], rule: str) -> pd.DataFrame:
    sizes = [len(x["start"]) for x in found]
    joined = {c: np.concatenate([x[c] for x in found]) for c in ("first_char", "n_chars", rule)}
    return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object).repeat(sizes).to_numpy(), "section": np.concatenate([np.arange(k) for k in sizes]), "first_char": joined["first_char"], "n_chars": joined["n_chars"], "n_tokens": joined[rule].astype(float)})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start", sections: Callable[[np.ndarray], np.ndarray] = lines) -> DataFrame:
    """doc_id, section (from 0), first_char, n_chars, n_tokens (double: `share` gives fractions)."""
    if rule not in ("start", "most", "share"):
        raise ValueError(f"unknown rule {rule!r}")
    return through_pandas(docs, _attributed(vocabulary, rule, sections), "section long, first_char long, n_chars long, n_tokens double", "text")


def op1_section_tokens(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
