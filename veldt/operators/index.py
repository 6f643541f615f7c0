"""All kinds of vector index by a factory text, and searches by a text of parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

from .graph import GraphIndex
from .ivf import IVFIndex
from .pq import PQIndex

#: Parameters by name: the argument they set.
PARAMS = {"nprobe": "nprobe", "k_factor": "k_factor", "efSearch": "ef", "itopk_size": "ef", "search_width": "width"}
TAKEN = {IVFIndex: {"nprobe"}, PQIndex: {"nprobe", "k_factor"}, GraphIndex: {"ef", "width"}}


def build_index(data: DataFrame, key: str, col: str, spec: str, metric: str = "L2") -> IVFIndex | PQIndex | GraphIndex:
    """The index of a text: Flat, IVF<lists>[,Flat], [IVF<lists>,]PQ<parts>[x8], HNSW<links>[,Flat], Cagra,<links before>,<links>[,<way of building>]; a leading GPU is passed over, as are Cagra's number of links before pruning and its way of building."""
    text = ",".join(p for p in (p.strip() for p in spec.split(",")) if p != "GPU")
    if re.fullmatch(r"Flat|IVF\d+(,Flat)?", text):
        return IVFIndex.build(data, key, col, text, metric)
    if m := re.fullmatch(r"(?:IVF(\d+),)?PQ(\d+)(?:x8)?", text):
        return PQIndex.build(data, key, col, int(m[2]), int(m[1]) if m[1] else None, metric)
    if m := re.fullmatch(r"HNSW(\d+)(?:,Flat)?", text):
        return GraphIndex.build(data, key, col, int(m[1]), metric)
    if m := re.fullmatch(r"Cagra,\d+,(\d+)(?:,\w+)?", text):
        return GraphIndex.build(data, key, col, max(2, int(m[1]) // 2), metric)
    raise ValueError(f"index {spec!r} is not offered")


def parse_params(text: str) -> dict[str, int]:
    """Arguments of a text such as `nprobe=30` or `efSearch=128`."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, value = (x.strip() for x in part.partition("="))
        if name not in PARAMS:
            raise ValueError(f"search parameter {name!r} is not offered")
        out[PARAMS[name]] = int(value)
    return out


def search_index(index: IVFIndex | PQIndex | GraphIndex, query: DataFrame, query_key: str, query_col: str, k: int, params: str = "", where: Column | None = None, distance: str = "vs_distance") -> DataFrame:
    """k nearest by any index; parameters of another kind of index are an error."""
    args = parse_params(params)
    if other := set(args) - TAKEN[type(index)]:
        raise ValueError(f"{type(index).__name__} takes no {sorted(other)}")
    return index.search(query, query_key, query_col, k, where=where, distance=distance, **args)
