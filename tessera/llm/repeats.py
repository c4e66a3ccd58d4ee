"""Substring dedup by recompression.

Rounds of recompression turn each document's words into fewer symbols: a maximal
run of one symbol gets a name, then each symbol whose name falls on the left side
that is followed by one on the right side forms a named pair.  Names are hashes
of what they stand for, so equal substrings get equal symbols in their interior
everywhere, without an exchange.  With each symbol goes its context, the words
that decide that it is parsed this way.

A window whose words also occur elsewhere has all symbols whose context lies in
it elsewhere, too.  The first exchange finds symbols that occur in one document
only; a window that holds the context of one is not repeated.  The windows left
are known by what they parse to: their interior symbols, and the words that these
don't cover.  Equal windows parse alike, so the second exchange, of 64-bit hashes of
parses, finds the repeats.  Two unlike windows have one hash with chance 2**-64;
words aren't compared again.

Documents lie in blocks ordered by id.  Per exchange, each block sends its sorted
distinct keys, packed, to buckets by hash, and gets one bit for each key back:
other blocks, or earlier blocks, have it.  A key is sent once per block, however
often it occurs, so a passage in every document loads no task.  A block sends a row
to a bucket only if it has a key for it, so there are never more rows than keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _INV_P, _P, Scratch, _power, encoded, keyed, mix, partitions, require, span_hashes, word_spans

ROUNDS = 2
_FAR = 1 << 60


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """(name, context start, context end, doc, first word, end) of the symbols
    after the rounds.  A context that reaches past its document's ends is that of no
    other."""
    x, n = words, len(words)
    lo, hi = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    d, begin = doc, lo
    for r in range(rounds):
        if not len(x):
            break
        # runs; that one ends where it does depends on its neighbours
        new = np.append(True, (x[1:] != x[:-1]) | (d[1:] != d[:-1]))
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(x))
        first, last = np.append(True, d[s[1:]] != d[s[1:] - 1]), np.append(d[e[:-1]] != d[e[:-1] - 1], True)
        lo = np.where(first, -_FAR, lo[np.maximum(s - 1, 0)])
        hi = np.where(last, _FAR, hi[np.minimum(e, len(x) - 1)])
        x, d, begin, count = x[s], d[s], begin[s], e - s
        many = count > 1
        x = np.where(many, mix(x ^ mix(count.astype(np.uint64) * _P + np.uint64(r + 1))), x)
        # pairs; a symbol alone depends on the neighbour that it could have joined
        right = (mix(x + np.uint64(r + 77)) & np.uint64(1)).astype(bool)
        follows = np.append((d[1:] == d[:-1]), False)
        opens = ~right & np.append(right[1:], False) & follows
        second = np.append(False, opens[:-1])
        next_hi = np.where(follows, np.append(hi[1:], _FAR), _FAR)
        before_lo = np.where(np.append(False, follows[:-1]), np.append(-_FAR, lo[:-1]), -_FAR)
        name = np.where(opens, mix(mix(x + np.uint64(2 * r + 5)) * _P + np.append(x[1:], np.uint64(0))), x)
        hi2 = np.where(right, hi, next_hi)
        lo2 = np.where(right, before_lo, lo)
        keep = ~second
        x, d, lo, hi, begin = name[keep], d[keep], lo2[keep], hi2[keep], begin[keep]
    return x, lo, hi, d, begin, np.append(begin[1:], n)


def window_keys(words: np.ndarray, window: int, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each window's parse: of the symbols whose context it holds, by
    where they begin, and of the words that none of them covers.  Symbols come in
    order, contexts no longer than a window."""
    n = len(words) - window + 1
    power = _power(_P, len(words) + 1, "p")
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    instead = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(mix(name + np.uint64(1)) * power[begin] - (sums[end] - sums[begin]), out=instead[1:])
    at = np.arange(n)
    first = np.searchsorted(lo, at, "left")
    last = np.maximum(np.searchsorted(hi, at + window, "right"), first)
    whole = sums[window:] - sums[:n] + instead[last] - instead[first]
    return mix(whole * _power(_INV_P, len(words) + 1, "inv")[:n])


class _Block:
    """The parsed words of a block of documents."""

    def __init__(self, texts, window: int):
        self.texts = [t or b"" for t in texts]
        self.window = window
        size = np.array([len(t) + 1 for t in self.texts])
        buf = np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8)
        self.starts, self.ends = word_spans(buf)
        self.words = span_hashes(buf, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, np.append(0, np.cumsum(size)))
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.at))
        self.buf = buf

    def symbols(self):
        """Distinct usable symbols: (names, of several documents here), and for
        each occurrence its name's number, context and extent."""
        x, lo, hi, d, begin, end = recompress(self.words, self.doc)
        use = hi - lo <= self.window
        x, lo, hi, d, begin, end = x[use], lo[use], hi[use], d[use], begin[use], end[use]
        names, number = np.unique(x, return_inverse=True)
        first = np.full(len(names), len(self.texts), np.int64)
        last = np.full(len(names), -1, np.int64)
        np.minimum.at(first, number, d)
        np.maximum.at(last, number, d)
        return names, first != last, number, lo, hi, begin, end

    def candidates(self, names, several, number, lo, hi, begin, end, elsewhere):
        """(distinct keys, positions, key number of each) of windows that may be
        repeated; elsewhere: symbols that other blocks have."""
        n = len(self.words) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        alone = ~(several | elsewhere)[number]
        kill = np.zeros(n + 1, np.int64)
        a, b = np.maximum(hi[alone] - self.window, 0), np.minimum(lo[alone], n - 1)
        fits = a <= b
        np.add.at(kill, a[fits], 1)
        np.add.at(kill, b[fits] + 1, -1)
        whole = self.doc[: n] == self.doc[self.window - 1 :]
        at = np.flatnonzero((np.cumsum(kill[:n]) == 0) & whole)
        parses = window_keys(self.words, self.window, names[number], lo, hi, begin, end)
        keys, number = np.unique(parses[at], return_inverse=True)
        return keys, at, number


def _packed(block: int, keys: np.ndarray, buckets: int) -> pd.DataFrame:
    """Sorted distinct keys cut by bucket: equal ranges of the key space."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    full = of[cut[:-1]]
    return pd.DataFrame({"bucket": full.astype(np.int32), "block": np.full(len(full), block, np.int64), "keys": [keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})


def _answer(earlier: bool):
    """Of one bucket, for each block a bit for each key: an earlier block (or any
    other) has it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        parts = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
        size = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")  # blocks ascend among equal keys
        sorted_ = flat[order]
        same = sorted_[1:] == sorted_[:-1]
        bit = np.append(False, same)
        if not earlier:
            bit |= np.append(same, False)
        out = np.zeros(len(flat), bool)
        out[order] = bit
        cut = np.cumsum(size) - size
        bits = [np.packbits(out[c : c + n]).tobytes() for c, n in zip(cut, size, strict=True)]
        return pd.DataFrame({"block": frame["block"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "n": size, "bits": bits})

    return run


def _unpacked(answers, n: int) -> np.ndarray:
    """The bits of a block's keys, in their order."""
    if answers is None or not len(answers):
        return np.zeros(n, bool)
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(a["n"])) for a in sorted(answers, key=lambda a: a["bucket"])]
    out = np.concatenate(parts).astype(bool)
    if len(out) != n:
        raise ValueError("a block's keys differ from those that it sent")
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words that
    lie in a window of `window` words which also starts in a document with a
    smaller id; kept joins the others by one space.

    A null or wordless text has no words and an empty kept text.  Rows that repeat
    an id, or have none (these come last), are documents of their own, in an order
    that a rerun repeats.  Other columns are not returned.  A very long text is a
    block of its own.  An empty table gives no rows.  Answers of at most
    broadcast_bytes go to all executors; larger ones are joined by a shuffle.
    """
    require(docs, id_col, text_col)
    scratch = Scratch(spark, "repeats")
    rows, key = keyed(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scratch)
    given = rows.select(F.col(key).alias("id"), F.col("doc_id").cast("string").alias("own"), "text")

    def to_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        ids, own, texts, size = [], [], [], 0

        def row():
            return pd.DataFrame({"block": [at], "ids": [np.array(ids, np.int64)], "own": [list(own)], "texts": [list(texts)]})

        for frame in frames:
            for i, o, t in zip(frame["id"].to_numpy(), frame["own"], encoded(frame["text"]), strict=True):
                if ids and size >= block_bytes:
                    yield row()
                    at, ids, own, texts, size = at + 1, [], [], [], 0
                ids.append(i)
                own.append(o)
                texts.append(t)
                size += len(t or b"") + 1
        if ids:
            yield row()

    ordered = given.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id")
    blocks = scratch.table(ordered.mapInPandas(to_blocks, "block long, ids array<long>, own array<string>, texts array<binary>"), "blocks")
    total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))

    def send_symbols(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, texts in zip(frame["block"], frame["texts"], strict=True):
                yield _packed(block, _Block(texts, window).symbols()[0], buckets)

    def exchanged(sent: DataFrame, earlier: bool, name: str) -> DataFrame:
        got = sent.groupBy("bucket").applyInPandas(_answer(earlier), "block long, bucket int, n int, bits binary")
        got = scratch.table(got, f"{name}-bits")
        got = scratch.table(got.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name)), name)
        scratch.drop(f"{name}-bits")
        return got

    def answered(to: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        held = answers.agg(F.coalesce(F.sum(F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["bits"]) + 32)), F.lit(0))).first()[0]
        return to.join(F.broadcast(answers) if held <= broadcast_bytes else answers, "block", "left")

    wire = "bucket int, block long, keys binary"
    symbols = exchanged(blocks.select("block", "texts").mapInPandas(send_symbols, wire), False, "symbols")

    def send_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, texts, answers in zip(frame["block"], frame["texts"], frame["symbols"], strict=True):
                b = _Block(texts, window)
                found = b.symbols()
                keys, _, _ = b.candidates(*found, _unpacked(answers, len(found[0])))
                yield _packed(block, keys, buckets)

    first = answered(blocks, symbols, "symbols")
    windows = exchanged(first.select("block", "texts", "symbols").mapInPandas(send_windows, wire), True, "windows")

    def frame_of(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, named, texts, symbols, windows in zip(frame["ids"], frame["own"], frame["texts"], frame["symbols"], frame["windows"], strict=True):
                b = _Block(texts, window)
                found = b.symbols()
                keys, at, number = b.candidates(*found, _unpacked(symbols, len(found[0])))
                earlier = _unpacked(windows, len(keys))
                ids = np.asarray(ids, np.int64)
                own = ids[b.doc[at]] if len(at) else np.zeros(0, np.int64)
                least = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(least, number, own)
                gone = at[earlier[number] | (least[number] < own)]
                cover = np.zeros(len(b.words) + 1, np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
                removed = np.cumsum(cover[:-1]) > 0
                out, raw = [], b.buf.tobytes()
                for k, i in enumerate(named):
                    s, e = b.at[k], b.at[k + 1]
                    r = removed[s:e]
                    kept = b" ".join([raw[x:y] for x, y in zip(b.starts[s:e][~r].tolist(), b.ends[s:e][~r].tolist(), strict=True)])
                    out.append((i, int(e - s), int(r.sum()), kept.decode("utf-8", "surrogatepass")))
                    if len(out) >= 256:
                        yield frame_of(out)
                        out = []
                if out:
                    yield frame_of(out)

    last = answered(first, windows, "windows")
    out = last.select("ids", "own", "texts", "symbols", "windows").mapInPandas(finish, "id string, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept")
