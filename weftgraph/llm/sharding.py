"""Contiguous minimax sharding of documents.

Groups of equal texts are the atoms. They stand in the order of a 128-bit hash of their text,
and the smallest capacity for which greedy filling needs no more than the given number of
shards is found by binary search. Within that capacity the cuts fall as near to even shares as can be. The driver sees the groups only as sizes of hash ranges:
ranges in which a cut may fall are split again until each holds one group, so what it gathers
is bounded whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import gapless_rank, stage, text_key, without

FIRST_BITS, MORE_BITS, LAST_BITS = 14, 10, 54


@dataclass
class Atoms:
    """Hash ranges in order: lowest hash, bits that fix it, bytes, bytes of the largest group, groups."""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    largest: np.ndarray
    groups: np.ndarray

    def pick(self, rows: np.ndarray) -> Atoms:
        return Atoms(*(x[rows] for x in vars(self).values()))


def _cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Greedy filling over running totals: index after each shard's last atom."""
    cuts, start = [], 0
    for _ in range(shards):
        before = int(ends[start - 1]) if start else 0
        start = int(np.searchsorted(ends, before + capacity, side="right"))
        cuts.append(start)
    return cuts


def minimax_capacity(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity with which greedy filling of the ordered sizes needs at most `shards` shards."""
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _cuts(ends, middle, shards)[-1] == len(sizes):
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Index after each shard's last atom: as near to even shares as shards of at most `capacity` allow, where that many suffice."""
    upto = np.concatenate([[0], ends])
    least = [len(ends)]  # atoms that the first shards have to take so that the others can hold the rest
    for _ in range(shards - 1):
        least.append(int(np.searchsorted(upto, upto[least[-1]] - capacity, side="left")))
    cuts = [0]
    for k, low in enumerate(least[-1:0:-1], 1):
        target = int(ends[-1]) * k / shards
        near = int(np.searchsorted(upto, target, side="left"))
        near -= near > 0 and target - upto[near - 1] <= upto[min(near, len(ends))] - target
        most = int(np.searchsorted(upto, upto[cuts[-1]] + capacity, side="right")) - 1
        cuts.append(min(max(near, low, cuts[-1]), most))
    return [*cuts[1:], len(ends)]


def _ranges(groups: DataFrame, bits: int, within: tuple[int, list[int]] | None = None) -> Atoms:
    if within:
        groups = groups.where(F.shiftright("_h1", 64 - within[0]).isin(within[1]))
    rows = groups.groupBy(F.shiftright("_h1", 64 - bits).alias("r")).agg(F.sum("bytes").alias("size"), F.max("bytes").alias("largest"), F.count(F.lit(1)).alias("groups")).collect()
    rows.sort(key=lambda x: x.r)
    get = lambda k: np.array([x[k] for x in rows], dtype=np.int64)
    return Atoms(get("r") << (64 - bits), np.full(len(rows), bits), get("size"), get("largest"), get("groups"))


def _open(atoms: Atoms, shards: int) -> np.ndarray:
    """Ranges of several groups in which a cut of the best partition, or an even share's end, may fall."""
    ends = np.concatenate([[0], np.cumsum(atoms.size)])
    least = max(int(atoms.largest.max()), -(-int(ends[-1]) // shards))
    most = minimax_capacity(atoms.size, shards)
    inside = np.zeros(len(atoms.size), dtype=bool)
    early = late = 0
    for _ in range(shards):
        early = int(ends[np.searchsorted(ends, early + least, side="right") - 1])
        late = int(ends[min(np.searchsorted(ends, late + most, side="left"), len(ends) - 1)])
        inside |= (ends[1:] > early) & (ends[:-1] < late)
    for k in range(1, shards):
        even = int(ends[-1]) * k / shards
        inside |= (ends[1:] > even) & (ends[:-1] < even)
    return np.flatnonzero(inside & (atoms.groups > 1) & (atoms.bits < LAST_BITS))


def plan(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hash of every shard but the first, and the capacity. groups: (_h1, bytes)."""
    atoms = _ranges(groups, FIRST_BITS)
    while len(rows := _open(atoms, shards)):
        finest = int(atoms.bits[rows].max())
        rows = rows[atoms.bits[rows] == finest]
        bits = finest + MORE_BITS
        finer = _ranges(groups, bits, (finest, [int(x) >> (64 - finest) for x in atoms.low[rows]]))
        kept = atoms.pick(np.setdiff1d(np.arange(len(atoms.low)), rows))
        joined = Atoms(*(np.concatenate(x) for x in zip(vars(kept).values(), vars(finer).values(), strict=True)))
        atoms = joined.pick(np.argsort(joined.low, kind="stable"))
    capacity = minimax_capacity(atoms.size, shards)
    cuts = even_cuts(np.cumsum(atoms.size), capacity, shards)
    return [int(atoms.low[x]) for x in cuts[:-1] if x < len(atoms.low)], capacity


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Deal all rows into at most `shards` shards of nearly equal bytes, equal texts together.

    Adds size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot (place in the shard,
    from 0 without gaps). A group of at least an even share of the bytes gets a shard of its own
    and the rest is shared out among the others; without such a group this is the plain minimax
    partition. A null text counts as no bytes and goes with the empty ones. Repeated rows are each
    dealt; rows alike in id and text get neighbouring slots in any order. No rows give no rows.
    Input columns named as an added one are replaced, all others stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keep = without(docs, ["size", "text_crc32", "shard", "slot", "_h1", "_h2", "_order"])
    sized = docs.select(*keep, F.col(id_col).alias("_order"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), *text_key(body))
    groups = stage(sized.groupBy("_h1", "_h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-groups")

    total, n_rows = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    giants: list[tuple[int, int]] = []
    left, rest = shards, groups
    while total and left > 1:
        found = rest.where(F.col("bytes") * left >= total).select("_h1", "_h2", "bytes").collect()
        if not found or len(found) >= left:
            break
        giants += [(x._h1, x._h2) for x in found]
        left, total = left - len(found), total - sum(x.bytes for x in found)
        for x in found:
            rest = rest.where(~((F.col("_h1") == x._h1) & (F.col("_h2") == x._h2)))
    starts = plan(rest, left)[0] if total else []

    shard = F.lit(len(giants))
    for start in starts:
        shard = shard + F.when(F.col("_h1") >= start, 1).otherwise(0)
    for k, (h1, h2) in enumerate(giants):
        shard = F.when((F.col("_h1") == h1) & (F.col("_h2") == h2), k).otherwise(shard)
    placed = sized.withColumn("shard", shard.cast("int"))
    return gapless_rank(placed, ["shard"], ["_order", "_h1", "_h2"], "slot", n_rows or 0).drop("_order", "_h1", "_h2")
