"""Joins inside many groups at once, of any size, without all their pairs.

members(group, node, label, payload...) are dealt by group.  Members of one label
are known to be linked and never compared.  A group that is too large is cut into
blocks: every member that lacks the group's commonest label meets every block, so a
group whose members are nearly all linked already costs as much as it has members.
A task holds two blocks at most and returns a spanning forest of the links among
what it holds: at most as many rows as members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy


def blocks_of(members: DataFrame, block: int, size: str | None = None, block_bytes: int = 1) -> DataFrame:
    """(group, major, blocks, rest): the groups of members(group, label) that have
    several labels; their commonest label, the number of blocks, and of those of
    the members with other labels.  A block has about `block` members, and about
    block_bytes of the column `size`, if given."""
    held = F.sum(size) if size else F.lit(0)
    by_label = members.groupBy("group", "label").agg(F.count("*").alias("n"), held.alias("bytes"))
    out = by_label.groupBy("group").agg(F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels"))

    def cut(n, held):
        return F.greatest(F.ceil(n / block), F.ceil(held / block_bytes) if size else F.lit(1), F.lit(1)).cast("int")

    blocks = cut(F.col("n"), F.col("bytes"))
    rest = cut(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    return out.where("labels > 1").select("group", F.col("most.label").alias("major"), blocks.alias("blocks"), F.when(blocks > 1, rest).otherwise(1).alias("rest"))


def dealt(members: DataFrame, cut: DataFrame, tasks: int) -> DataFrame:
    """members(group, node, label, ...), once for each pair (bi, bj) of blocks
    that they belong to; cut: the rows of blocks_of() with several blocks.  Groups
    that aren't in it are one block."""
    rows = members.join(cut, "group", "left")
    whole = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj")))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    among = F.pmod(F.xxhash64("node", F.lit(9)), F.col("rest")).cast("int")
    in_all = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: F.struct(k.alias("bi"), own.alias("bj")))
    in_rest = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(among.alias("bi"), k.alias("bj")))
    every = F.when(F.col("blocks").isNull(), whole).when(F.col("label") == F.col("major"), in_all).otherwise(F.array_union(in_all, in_rest))
    rows = rows.withColumn("at", F.explode(every)).select("*", "at.bi", "at.bj").drop("major", "blocks", "rest", "at")
    return rows.repartition(tasks, "group", "bi", "bj").sortWithinPartitions("group", "bi", "bj", "node")


Links = Callable[[pd.DataFrame], list[tuple[int, int]]]


def forest(rows: DataFrame, links: Links, pairs: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None = None, leaf: int = 8) -> DataFrame:
    """(a, b) links of every group of dealt rows.  links gives those of one
    group as positions; pairs, if given, tests pairs of positions of many groups
    of at most `leaf` members in one call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(frames):
            ends = _ends(frame)
            starts = np.concatenate(([0], ends[:-1]))
            node = frame["node"].to_numpy()
            size = ends - starts
            a, b = [], []
            few = (size > 1) & (size <= leaf) if pairs is not None else np.zeros(len(size), bool)
            if few.any():
                left, right = [], []
                for n in range(2, leaf + 1):
                    s = starts[few & (size == n)]
                    for i in range(n):
                        for j in range(i + 1, n):
                            left.append(s + i)
                            right.append(s + j)
                left, right = np.concatenate(left), np.concatenate(right)
                ok = pairs(frame, left, right)
                a.append(node[left[ok]])
                b.append(node[right[ok]])
            for s, e in zip(starts[(size > 1) & ~few], ends[(size > 1) & ~few], strict=True):
                part = frame.iloc[s:e]
                found = links(part)
                if found:
                    at = np.array(found) + s
                    a.append(node[at[:, 0]])
                    b.append(node[at[:, 1]])
            if a:
                out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                yield out.drop_duplicates()

    return rows.mapInPandas(tidy(run), "a long, b long")


def grow(labels: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest by growing components; near(i, free) gives free partners.
    Nodes of one label are one from the start."""
    n = len(labels)
    _, code = np.unique(labels, return_inverse=True)
    order = np.argsort(code, kind="stable")
    at = np.searchsorted(code[order], np.arange(code.max() + 2 if n else 1))
    free, out = np.ones(n, bool), []

    def take(i: int) -> list[int]:
        own = order[at[code[i]] : at[code[i] + 1]]
        free[own] = False
        return own.tolist()

    left = n
    for seed in range(n):
        if not free[seed]:
            continue
        queue = take(seed)
        left -= len(queue)
        while queue and left:
            i = queue.pop()
            for j in near(i, free).tolist():
                if free[j]:
                    more = take(j)
                    left -= len(more)
                    queue += more
                    out.append((i, j))
        if not left:
            break
    return out


def _ends(frame: pd.DataFrame) -> np.ndarray:
    k = frame[["group", "bi", "bj"]].to_numpy()
    return np.append(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(frame))


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames cut at the ends of groups."""
    held = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[["group", "bi", "bj"]].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if held and (cut or (held[-1][["group", "bi", "bj"]].to_numpy()[-1] != k[0]).any()):
            if cut:
                yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
                held = [frame.iloc[cut:]]
            else:
                yield pd.concat(held, ignore_index=True)
                held = [frame]
        elif held:
            held.append(frame)
        else:
            if cut:
                yield frame.iloc[:cut].reset_index(drop=True)
            held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)
