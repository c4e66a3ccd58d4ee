"""Document fingerprints by Lempel-Ziv phrases.

An LZ78 parse cuts a text into phrases, each the shortest string not yet in the
dictionary.  Texts that share much share phrases, as a compressor would find.
The phrase set is hashed; BINS bins by the leading bits keep the minimum of what
falls into them (one-permutation minimum hashing), 16 bits of which make up the
fingerprint, in hexadecimal.  0000 is an empty bin.  Likeness of two fingerprints
is the share of equal bins among those that either fills; 1 for two empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_rows, partitions, position_in, require, span_hashes

BINS = 128
_LOW = -(1 << 63)


def parse(text: str, start: int = 0, at: int = 0, known: set | None = None, ends: list | None = None, stop: int | None = None):
    """(start of the open phrase, dictionary, ends of phrases) after the text up
    to stop, going on from an earlier state."""
    known = set() if known is None else known
    ends = [] if ends is None else ends
    add, end = known.add, ends.append
    for j in range(at + 1, (len(text) if stop is None else stop) + 1):
        phrase = text[start:j]
        if phrase not in known:
            add(phrase)
            end(j)
            start = j
    return start, known, ends


def sketch(text: str, ends: list[int]) -> np.ndarray:
    out = np.zeros(BINS, np.uint16)
    if not ends:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.array(ends, np.int64)
    h = np.sort(span_hashes(codes, np.append(0, stop[:-1]), stop))
    bins = (h >> np.uint64(64 - 7)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out[bins[first]] = np.maximum((h[first] >> np.uint64(16)) & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def written(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a > 0) | (b > 0)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def with_next(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 64) -> DataFrame:
    """Rows (range, tail, id, text), dealt and sorted such that each row's
    successor in id order follows it in its range; a range ends with tail rows,
    copies of what comes first in the next one (after the last: the first)."""
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = given.count()
    ranges = max(1, min(8 * partitions(spark), 4096, n // rows_per_range))
    cuts = []
    if ranges > 1:
        share = [k / ranges for k in range(1, ranges)]
        cuts = sorted(set(given.agg(F.percentile_approx("id", share, 20 * ranges)).first()[0]))
    known = literal_rows([{"i": c} for c in cuts], "struct<i:bigint>")
    of = position_in(known, len(cuts), F.struct(F.col("id").alias("i"))) if cuts else F.lit(0)
    ranged = given.withColumn("range", of)
    firsts = sorted((r.range, r.low) for r in ranged.groupBy("range").agg(F.min("id").alias("low")).collect())
    before = [{"r": None, "low": None} for _ in range(len(cuts) + 1)]
    for k, (r, low) in enumerate(firsts):
        before[r] = {"r": firsts[k - 1][0], "low": low}
    entry = F.get(literal_rows(before, "struct<r:int,low:bigint>"), F.col("range"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    tail = F.struct(entry["r"].alias("range"), F.lit(True).alias("tail"))
    dealt = ranged.withColumn("to", F.explode(F.when(F.col("id") == entry["low"], F.array(own, tail)).otherwise(F.array(own))))
    dealt = dealt.select("to.range", "to.tail", "id", "text")
    return dealt.repartition(partitions(spark), "range").sortWithinPartitions("range", "tail", "id", "text")


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 4) code points replaced by as
    many first ones (or all) of the next document by id; after the last comes
    the first.  Rows that repeat an id follow each other by text.  A null text is
    empty, with an empty fingerprint; a null id comes first.  An empty table gives
    no rows."""
    require(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its successor
        done = None  # range whose last row has met its tail
        out: list[tuple] = []
        for frame in frames:
            for r, tail, i, text in zip(frame["range"], frame["tail"], frame["id"], frame["text"], strict=True):
                if tail and done == r:
                    continue
                state = _begun(text)
                if held is not None:
                    out.append(_finished(held, text, state[-1]))
                if tail:
                    held, done = None, r
                else:
                    held = (i, text, *state)
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = with_next(spark, docs, id_col, text_col)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(_LOW)))


def _begun(text: str):
    """The state of the parse where the last quarter begins, and the sketch."""
    keep = len(text) - len(text) // 4
    start, known, ends = parse(text, stop=keep)
    then = (start, set(known), list(ends))
    _, _, ends = parse(text, start, keep, known, ends)
    return keep, then, sketch(text, ends)


def _finished(held, following: str, next_sketch: np.ndarray) -> tuple:
    i, text, keep, (start, known, ends), own = held
    edited = text[:keep] + following[: len(text) - keep]
    _, _, ends = parse(edited, start, keep, known, ends)
    other = sketch(edited, ends)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return i, len(text), digest, written(own), written(other), likeness(own, other), likeness(own, next_sketch)
