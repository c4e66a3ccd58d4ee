"""What the operators share: scratch tables, text kernels, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python kernel works on at a time.
CHUNK_BYTES = 1 << 18

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or one of our own
    where that is unset and the master is local."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if found := spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


#: While a table is written: its shuffle files go when it is whole, as nothing reads
#: them again, and Python kernels get batches of bounded bytes.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


@contextlib.contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts lineage and outlives executors.  Tables that the lazy
    result still reads stay until the interpreter ends; drop() removes others.
    Spark drops the broadcasts and shuffles of past queries only as the driver's JVM
    collects its garbage, and its heap grows meanwhile; so it is asked to after every
    COLLECT tables.
    """

    COLLECT = 8
    written = 0

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        self.rows: dict[str, int] = {}
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; the folder is temporary anyway
            pass

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _set(self.spark, _WRITING):
            df.write.mode("overwrite").parquet(path)
        Scratch.written += 1
        if Scratch.written % self.COLLECT == 0:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, where: str = "true") -> DataFrame:
        """table(), with its rows of a kind counted while it is written, into
        rows[name]: each query more stays in the driver's memory for long."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count(F.when(F.expr(where), 1)).alias("n")), name)
        n = seen.get.get("n")
        self.rows[name] = out.where(where).count() if n is None else n
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, one for each given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def originals(out: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """The columns of docs, from out, where those that clash with the added
    names have given way as fresh() says."""
    clash = dict(zip(names, fresh(docs, *names), strict=True))
    return out.select(*[F.col(clash.get(c.lower(), c)).alias(c) for c in docs.columns])


def keyed(spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a long that tells its rows apart, and that column's name: the id
    where all differ and none is null, else numbers in the order of the ids, nulls
    last, equal ones in an order that a rerun repeats."""
    key = fresh(docs, "row_")[0]
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long")), key
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(*docs.columns))
    return scratch.table(ordered.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def literal_rows(rows: list, ddl: str) -> Column:
    """A constant array of structs, for lookups without a join."""
    import json

    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), f"array<{ddl}>")


def position_in(splitters: Column, n: int, key: Column) -> Column:
    """How many of the n ascending splitters are <= key, by binary search."""
    steps = max(1, int(n).bit_length())
    powers = F.array(*[F.lit(1 << i) for i in range(steps - 1, -1, -1)])
    return F.aggregate(
        powers,
        F.lit(0),
        lambda at, step: F.when((at + step <= F.lit(n)) & (F.get(splitters, at + step - 1) <= key), at + step).otherwise(at),
    )


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel of a partition that then gives its free memory back: the worker
    waits for its next task beside the JVM."""

    @functools.wraps(kernel)
    def run(frames: Iterator) -> Iterator:
        yield from kernel(frames)
        release()

    return run


def release() -> None:
    """Returns what numpy and Arrow have freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


# -- text kernels over UTF-8 bytes (executors, numpy) ---------------------------

_P = np.uint64(0x9E3779B97F4A7C55)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INV_P = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18) + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a sequence of small integers."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_P, n, "p"), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_INV_P, n + 1, "inv")[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64)))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def chunks(texts, most: int = CHUNK_BYTES):
    """Cuts a list of UTF-8 byte strings (or None) into runs of about `most`
    bytes; a longer text is a run of its own.  Yields (first, last, buffer,
    offsets), texts being separated by a line feed in the buffer."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > most:
            yield (first, i, *_joined(held))
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield (first, len(texts), *_joined(held))


def _joined(held):
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in held], out=offsets[1:])
    return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), offsets


def encoded(series) -> list:
    """UTF-8 bytes of a pandas series of texts; what is not a text is None."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else None for t in series]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; of positions 0 .. len - n."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n))
    for i in range(n):
        out = mix(out * _P + words[i : i + m])
    return out


# -- connected components -------------------------------------------------------


def components(spark: SparkSession, links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node in
    links(a, b); rows of scratch counts them, as {name}-labels.  Hooking to the
    smallest neighbouring label and one pointer jump a round; rounds grow with the
    logarithm of the diameter.  Links that lie inside a component leave the table, so
    rounds shrink.  A node's label is where the hooks of all rounds lead it, followed
    once at the end."""
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = f"{name}-edges"
    roots = scratch.counted(edges, last)  # links between components, by their labels
    hooks: list[tuple[str, DataFrame]] = []

    def labels() -> DataFrame:
        out = hooks[0][1].withColumnsRenamed({"a": "node", "to": "component"})
        for _, hook in hooks[1:]:
            out = out.join(hook.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return out

    for i in range(1, 200):
        if not scratch.rows[last]:
            break
        both = roots.select("a", "b").unionByName(roots.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        # follow the pointers of this round's roots to their ends
        hook = scratch.table(hook, at := f"{name}-hook-{i}-0")
        for j in range(1, 64):
            nxt = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
            jumped = hook.join(nxt, "to", "left").select("a", F.coalesce("further", "to").alias("new"), "to")
            jumped = scratch.counted(jumped.select("a", F.col("new").alias("to"), (F.col("new") != F.col("to")).alias("moved")), f"{name}-hook-{i}-{j}", "moved")
            scratch.drop(at)
            at, hook = f"{name}-hook-{i}-{j}", jumped.select("a", "to")
            if not scratch.rows[at]:
                break
        hooks.append((at, hook))
        left = hook.select("a", F.col("to").alias("ra"))
        right = hook.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        roots = roots.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        roots = scratch.counted(roots, f"{name}-roots-{i}")
        scratch.drop(last)
        last = f"{name}-roots-{i}"
        if len(hooks) == 8:  # else the last query would grow with the rounds
            hook = scratch.table(labels(), at := f"{name}-labels-{i}").withColumnsRenamed({"node": "a", "component": "to"})
            scratch.drop(*[x for x, _ in hooks])
            hooks = [(at, hook)]
    if not hooks:
        scratch.rows[f"{name}-labels"] = 0
        return roots.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = scratch.counted(labels(), f"{name}-labels")
    scratch.drop(last, *[x for x, _ in hooks])
    return out
