"""Benchmark decontamination by greedy string tiling.

Words are compared without case and punctuation.  Documents and test items meet
where they share a seed, a run of `least` words found by rolling hashes; hits on
one diagonal join into maximal matches.  Tiling then marks the longest match
whose words are all unmarked, cuts what overlaps marked words, and repeats down
to matches of `least` words (running Karp-Rabin, whose search lengths are the
lengths of the matches left).  Words are verified one by one, not by hash alone.
An item's coverage is the share of its words that tiles mark, in any order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import chunks, fresh, grams, require, span_hashes

THRESHOLD = 0.5
_FILTER_BITS = 20


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits; of other ASCII none, of the rest all."""
    gap = (buf < 48) | ((buf > 57) & (buf < 65)) | ((buf > 90) & (buf < 97)) | ((buf > 122) & (buf < 128))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _lowered(texts) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def tile(matches: list[tuple[int, int, int]], least: int, n_item: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length) from maximal matches."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    item = np.zeros(n_item, bool)
    text: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [not item[i + k] and j + k not in text for k in range(n)]
        if all(free):
            item[i : i + n] = True
            text.update(range(j, j + n))
            out.append((i, j, n))
            continue
        start = None
        for k in range(n + 1):  # what is left between marked words comes again
            if k < n and free[k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= least:
                    heapq.heappush(heap, (-(k - start), i + start, j + start))
                start = None
    return out


class Items:
    """Test items with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least = least
        self.ids, self.words, self.spelt = [], [], []
        hashes, owner, place = [], [], []
        for i, raw in zip(ids, _lowered(texts), strict=True):
            buf = np.frombuffer(raw + b"\n", np.uint8)
            w = span_hashes(buf, *_words(buf))
            if not len(w):
                continue
            g = grams(w, least)
            if len(w) >= least:
                hashes.append(g)
                owner.append(np.full(len(g), len(self.ids)))
                place.append(np.arange(len(g)))
            self.ids.append(i)
            self.words.append(w)
            self.spelt.append([raw[a:b] for a, b in zip(*_words(buf), strict=True)])
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def best(self, texts, threshold: float) -> list[tuple]:
        """(item, coverage, tiles, items over the threshold) of each text."""
        out: list[tuple] = []
        for first, last, buf, offsets in chunks(_lowered(texts)):
            starts, ends = _words(buf)
            words = span_hashes(buf, starts, ends)
            at = np.searchsorted(starts, offsets)
            rows: list[tuple] = [(None, 0.0, 0, 0)] * (last - first)
            seeds = grams(words, self.least)
            if len(seeds) and len(self.seeds):
                hit = np.flatnonzero(self.filter[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                where = np.minimum(np.searchsorted(self.seeds, seeds[hit]), len(self.seeds) - 1)
                same = self.seeds[where] == seeds[hit]
                hit, where = hit[same], where[same]
                doc = np.searchsorted(at, hit, side="right") - 1
                inside = hit + self.least <= at[doc + 1]
                hit, where, doc = hit[inside], where[inside], doc[inside]
                many = self.first[where + 1] - self.first[where]
                of = np.repeat(np.arange(len(hit)), many)
                entry = self.first[where][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                owner, i, j, doc = self.owner[entry], self.place[entry], hit[of], doc[of]
                order = np.lexsort((i, j - i, owner, doc))
                owner, i, j, doc = owner[order], i[order], j[order], doc[order]
                cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(owner) != 0)) + 1
                for s, e in zip(np.append(0, cut), np.append(cut, len(doc)), strict=True):
                    if e > s:
                        self._rate(rows, int(doc[s]), int(owner[s]), i[s:e], j[s:e], words, buf, starts, ends, threshold)
            out += rows
        return out

    def _rate(self, rows, doc, owner, i, j, words, buf, starts, ends, threshold):
        item = self.words[owner]
        most = len(np.unique(i)) * self.least  # words that tiles can mark
        if most < threshold * len(item) and most / len(item) < rows[doc][1]:
            return
        runs = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1)) + 1
        matches = []
        for s, e in zip(np.append(0, runs), np.append(runs, len(i)), strict=True):
            n = int(e - s) + self.least - 1
            a, b = int(i[s]), int(j[s])
            if (item[a : a + n] == words[b : b + n]).all() and all(buf[starts[b + k] : ends[b + k]].tobytes() == self.spelt[owner][a + k] for k in range(n)):
                matches.append((int(i[s]), int(j[s]), n))
        tiles = tile(matches, self.least, len(item))
        coverage = sum(n for _, _, n in tiles) / len(item)
        best, most, n_tiles, over = rows[doc]
        over += coverage >= threshold
        if coverage > most or (coverage == most and best is not None and self.ids[owner] < best):
            best, most, n_tiles = self.ids[owner], coverage, len(tiles)
        rows[doc] = (best, most, n_tiles, over)


def _best(shared, threshold: float):
    @pandas_udf("item_id long, coverage double, tiles int, items int")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = shared.value.best(texts, threshold)
        out = pd.DataFrame(rows, columns=["item_id", "coverage", "tiles", "items"])
        return out.assign(item_id=out["item_id"].astype("Int64"))

    return best


def coverage(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 4,
    threshold: float = THRESHOLD,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """docs with item_id (of the best covered test item), coverage (0 to 1), tiles
    and items (how many reach the threshold); a column of docs with such a name
    is renamed with a leading underscore.

    The benchmark is read in blocks of about block_bytes of text, whose index
    goes to all executors; each block passes over the documents once more.  Ties
    go to the smaller item id.  Items of fewer than `least` words, null texts and
    empty ones have no seed: coverage 0, no item.  Items with a null id are left
    out.  An empty benchmark leaves every document at 0.
    """
    require(docs, text_col)
    require(benchmark, item_col, item_text_col)
    names = ("item_id", "coverage", "tiles", "items")
    clash = {c: n for c, n in zip(names, fresh(docs, *names), strict=True) if c != n}
    docs = docs.withColumnsRenamed({c: clash[c.lower()] for c in docs.columns if c.lower() in clash})
    text_col = clash.get(text_col.lower(), text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    found = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        index = Items([r.i for r in sorted(own)], [r.t for r in sorted(own)], least)
        found.append(_best(spark.sparkContext.broadcast(index), threshold))
    col = fresh(docs, "found_")[0]
    out = docs.withColumn(col, found[0](F.col(text_col)))
    for more in found[1:]:
        a, b = F.col(col), more(F.col(text_col))
        out = out.withColumn(f"{col}2", b)
        b = F.col(f"{col}2")
        better = (b["coverage"] > a["coverage"]) | ((b["coverage"] == a["coverage"]) & (F.coalesce(b["item_id"] < a["item_id"], F.lit(False))))
        pick = lambda n, a=a, b=b, better=better: F.when(better, b[n]).otherwise(a[n]).alias(n)
        out = out.withColumn(col, F.struct(pick("item_id"), pick("coverage"), pick("tiles"), (a["items"] + b["items"]).alias("items"))).drop(f"{col}2")
    return out.select("*", *[F.col(col)[n].alias(n) for n in names]).drop(col)
