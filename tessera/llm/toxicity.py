"""Toxicity: a linear classifier on character n-grams whose features are scaled
by naive Bayes log-count ratios.

Features are hashed 3-, 4- and 5-grams of the lower-cased text, present or not.
Training counts in how many toxic and clean texts each occurs, takes the log
ratio r of the two smoothed shares, and fits a logistic regression with an L2
penalty to the features times r.  It uses at most `most` labelled rows of each
class (the smallest by a hash of the id), the one bounded sample here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, mix, release, require

NGRAMS = (3, 4, 5)
BITS = 18
#: Rows of training that a step works on at a time.
BLOCK = 256
#: Characters of a text that are hashed at a time.
PIECE = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C55)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the hashed features, float32
    bias: float


def features(text: str | None, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct feature numbers of a text; of those marked in keep only, if given.
    A long text is hashed a PIECE at a time, with no n-gram left out between two."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, np.int64)
    text, found = text.lower(), []
    for start in range(0, len(text), PIECE):
        # n-grams that begin in the piece
        codes = np.frombuffer(text[start : start + PIECE + max(NGRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        rolled = codes
        for n in range(2, max(NGRAMS) + 1):
            if len(codes) < n:
                break
            rolled = rolled[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
            if n in NGRAMS:
                at = (mix(rolled + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
                found.append(np.unique(at if keep is None else at[keep[at]]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def fit(rows: list[np.ndarray], toxic: np.ndarray, alpha: float = 1.0, l2: float = 0.05, least_ratio: float = 0.7, steps: int = 200) -> Model:
    """Model from feature sets and 0/1 labels.  Without both classes: the
    smoothed share of toxic rows for every text."""
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    n_pos, n_neg = int(toxic.sum()), int((1 - toxic).sum())
    prior = float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
    if not n_pos or not n_neg:
        return Model(weights, prior)
    p, q = np.full(size, alpha), np.full(size, alpha)
    for r, y in zip(rows, toxic, strict=True):
        (p if y else q)[r] += 1  # the features of a row are distinct
    ratio = np.log(p / (n_pos + 2 * alpha)) - np.log(q / (n_neg + 2 * alpha))
    ratio[(np.abs(ratio) < least_ratio) | (p + q < 3 + 2 * alpha)] = 0.0
    used = np.flatnonzero(ratio)
    if not len(used):
        return Model(weights, prior)
    column = np.full(size, -1, np.int32)
    column[used] = np.arange(len(used), dtype=np.int32)
    kept = [r[ratio[r] != 0] for r in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for k in kept])
    flat = np.concatenate(kept)
    col, x = column[flat], ratio[flat].astype(np.float32)
    del kept, flat
    # classes weigh the same; Nesterov steps on the mean logistic loss, a block of
    # rows at a time, so that no array as long as the features is made in a step
    cost = np.where(toxic == 1, 0.5 / n_pos, 0.5 / n_neg)
    at = np.searchsorted(row, np.arange(0, len(rows) + BLOCK, BLOCK))
    blocks = [(k * BLOCK, slice(a, b)) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    norm = sum(float((cost[row[s]] * x[s] * x[s]).sum()) for _, s in blocks)
    rate = 1.0 / (0.25 * norm + l2 / len(rows) + 0.25)
    w = last = np.zeros(len(used))
    b = last_b = 0.0
    for t in range(1, steps + 1):
        ahead, ahead_b = w + (t - 1) / (t + 2) * (w - last), b + (t - 1) / (t + 2) * (b - last_b)
        slope, slope_b = l2 / len(rows) * ahead, 0.0
        for k, s in blocks:
            n = min(BLOCK, len(rows) - k)
            z = np.bincount(row[s] - k, x[s] * ahead[col[s]], minlength=n) + ahead_b
            err = cost[k : k + n] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[k : k + n])
            slope += np.bincount(col[s], x[s] * err[row[s] - k], minlength=len(used))
            slope_b += float(err.sum())
        last, last_b = w, b
        w = ahead - rate * slope
        b = ahead_b - rate * slope_b
    weights[used] = w * ratio[used]
    return Model(weights, float(b))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 1500) -> Model:
    """Fits on at most `most` labelled rows of each class.  Labels other than 0
    and 1, and null ids or texts, are left out.  A row labelled both ways counts in
    both classes; of rows that repeat an id the smallest text counts.  An empty
    table, or one class only, gives the smoothed share as every score.  A very long
    text is hashed whole."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").distinct()
    by = F.xxhash64("i", F.lit(3))
    one = known.where("y = 1").orderBy(by, "i").limit(most)
    none = known.where("y = 0").orderBy(by, "i").limit(most)
    sample = F.broadcast(one.unionByName(none))  # 2 * most rows at the most

    @pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        out = pd.Series([features(t).astype(np.int32) for t in texts])
        release()
        return out

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(sample, "i").where("t is not null")
    once = rows.groupBy("i", "y").agg(F.min("t").alias("t"))
    got = once.select("i", "y", hashed("t").alias("f")).toArrow()
    order = sorted(range(len(got)), key=lambda k, i=got["i"].to_pylist(), y=got["y"].to_pylist(): (i[k], y[k]))
    sets = [part.slice(k, 1).flatten().to_numpy() for part in got["f"].chunks for k in range(len(part))]
    model = fit([sets[k] for k in order], got["y"].to_numpy()[order].astype(np.int64))
    del sets, got
    pa.default_memory_pool().release_unused()  # the driver goes on without the sample
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores in 0 to 1, higher if likelier toxic.  A null
    or empty text has no features: it scores the bias.  A column of that name is
    renamed with a leading underscore.  Other columns play no part."""
    require(docs, text_col)
    if (new := fresh(docs, name)[0]) != name:
        docs = docs.withColumnsRenamed({c: new for c in docs.columns if c.lower() == name.lower()})
        text_col = new if text_col.lower() == name.lower() else text_col
    weights, bias, keep = model.weights, model.bias, model.weights != 0

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        z = np.array([bias + float(weights[features(t, keep)].sum()) for t in texts], np.float64)
        release()
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return docs.withColumn(name, scored(F.col(text_col)))
