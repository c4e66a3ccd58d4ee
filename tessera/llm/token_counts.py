"""Token counts by offset-mapped attribution.

A document's fields, joined by line feeds, are encoded once as a whole.  Tokens
of a byte-level vocabulary have known lengths, so their running sum gives each
token's span of bytes; sections (lines, or fields) have spans, too.  An interval
join of the two orders gives each token to a section.  A token across a border
goes by rule: "first", to the section of its first byte, or "most", to the one
with the most of its bytes, the earlier of equals.  A line feed belongs to the
section that it ends.  Counts of sections add up to the document's.
"""

from __future__ import annotations

import base64
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, require

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenisation pattern of the public vocabulary above
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Byte-level BPE of a file of ranks, and the bytes in each token."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """Ends, in bytes, of the tokens of a text; they start where the last ended."""
        return np.cumsum(self.length[np.array(self.encoding.encode_ordinary(text), np.int64)])


def _tokenizer(shared, pattern: str) -> Tokenizer:
    """One a worker process."""
    cache = sys.__dict__.setdefault("_tessera_tokenizers", {})
    key = (hash(shared.value), pattern)
    if key not in cache:
        cache[key] = Tokenizer(shared.value, pattern)
    return cache[key]


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens in each section, given the ends of tokens and of sections."""
    starts = np.concatenate(([0], ends[:-1]))
    of = np.searchsorted(borders, starts, side="right")
    if rule == "most":
        last = np.searchsorted(borders, ends - 1, side="right")
        for k in np.flatnonzero(last > of):
            cuts = np.concatenate(([starts[k]], borders[of[k] : last[k]], [ends[k]]))
            of[k] += int(np.argmax(np.diff(cuts)))
    return np.bincount(of, minlength=len(borders))[: len(borders)]


def sections(fields: list[str], by: str) -> tuple[str, np.ndarray]:
    """The document, and the ends of its sections in bytes."""
    text = "\n".join(fields)
    if not text and len(fields) < 2:
        return text, np.zeros(0, np.int64)
    if by == "fields":
        sizes = [len(f.encode()) + 1 for f in fields]
        ends = np.cumsum(sizes)
        ends[-1] -= 1
        return text, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    return text, ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def token_counts(spark: SparkSession, docs: DataFrame, fields: tuple = ("text",), by: str = "lines", rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs with n_tokens (long) and section_tokens (a count for each section, in
    order); a column of docs with such a name is renamed with a leading
    underscore.  A null field counts as empty.  An empty document has no tokens
    and no sections; an empty line has the tokens that start with its line feed.
    """
    require(docs, *fields)
    if by not in ("lines", "fields") or rule not in ("first", "most"):
        raise ValueError("by is lines or fields, rule is first or most")
    names = ("n_tokens", "section_tokens")
    clash = {c: n for c, n in zip(names, fresh(docs, *names), strict=True) if c != n}
    docs = docs.withColumnsRenamed({c: clash[c.lower()] for c in docs.columns if c.lower() in clash})
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @pandas_udf("n_tokens long, section_tokens array<long>")
    def counted(columns: pd.DataFrame) -> pd.DataFrame:
        own, out = _tokenizer(shared, pattern), []
        for row in zip(*(columns[c] for c in columns.columns), strict=True):
            text, borders = sections([x if isinstance(x, str) else "" for x in row], by)
            ends = own.spans(text) if text else np.zeros(0, np.int64)
            out.append((len(ends), attribute(ends, borders, rule) if len(ends) else np.zeros(len(borders), np.int64)))
        return pd.DataFrame(out, columns=["n_tokens", "section_tokens"])

    col = fresh(docs, "counted_")[0]
    given = F.struct(*[F.col(clash.get(c.lower(), c)).alias(f"f{k}") for k, c in enumerate(fields)])
    out = docs.withColumn(col, counted(given))
    return out.select("*", *[F.col(col)[n].alias(n) for n in names]).drop(col)
