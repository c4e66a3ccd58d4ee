"""Line dedup by MinHash (DataFrame operations only).

A line's set is its distinct shingles of `k` characters (UTF-16 units).  Its
signature: the 64-bit hashes of shingles fall into BANDS ranges of equal width, and
the least ROWS of a range, a sample of the line without order, are the key of its band
(one-permutation hashing).  A range with fewer, as short lines have, gives those it
has; an empty one the next hash above.  At similarity 0.8, about 0.8 percent of pairs of
lines that fill the ranges share no key.

In each key's bucket every line first meets two centres, the member that occurs most
often, of which near copies mostly are copies, and that of greatest hash.  Pairs are
verified by exact Jaccard similarity of whole sets and union-find joins them.  Members of a bucket that are no centres and that this leaves
apart then meet each other: bitmaps of their shingles bound what a pair can share,
and pairs that may reach the threshold are verified.  So every pair of a bucket is
compared, ruled out by a sound bound or joined already.  Of each component the first
line (by row, then position) stays.

Line texts cross an exchange only where their line has a candidate.  Pairs with
centres grow with a bucket's size; those of bitmaps with the square of the members
that no link joins, which meet in blocks.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, _set, components, fresh, keyed, require

ROWS = 5
BANDS = 12
#: Where the bands begin, ascending.
STARTS = [-(1 << 63) + (b << 64) // BANDS for b in range(BANDS)]
#: Words of 64 bits in the bitmap of a line's shingles.
WORDS = 32
#: The minima of all bins in one method would be more than the JVM compiles.
_SIGNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: At most so many lines are told apart as very frequent, and go to all executors.
OFTEN = 100_000
#: Blanks at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _hashes(line: Column, k: int) -> Column:
    """The hash of every shingle of a line, repeats included."""
    def of(u: Column) -> Column:
        last = F.greatest(F.octet_length(u) - (2 * k - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last, F.lit(2)), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * k))))

    # a variable of its own, or each shingle would encode the line anew
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), of), F.lit(0))


def _set_of(line: str, k: int) -> Column:
    return F.array_distinct(_hashes(F.col(line), k))


def sign(lines: DataFrame, k: int) -> DataFrame:
    """lines(line, ...) with keys, one for each band, in place of line."""
    others = [c for c in lines.columns if c != "line"]
    hashed = lines.select(*others, F.sort_array(_hashes(F.col("line"), k)).alias("s"))
    merged = hashed.select("*", F.sort_array(F.concat("s", F.array(*[F.lit(x) for x in STARTS]))).alias("m"))
    # where in s each band begins: its place among hashes and beginnings, less those
    begins = [(F.array_position("m", F.lit(STARTS[b])).cast("int") - (1 + b)).alias(f"p{b}") for b in range(BANDS)]
    placed = merged.select(*others, "s", *begins, F.size("s").alias(f"p{BANDS}"))

    def key(b: int) -> Column:
        p, end = F.col(f"p{b}"), F.col(f"p{b + 1}")
        at = F.when(p < F.col(f"p{BANDS}"), p + 1).otherwise(1)
        least = F.slice("s", at, F.greatest(F.lit(1), F.least(F.lit(ROWS), end - p)))
        # only a range that repeats a shingle pays for telling its hashes apart
        again = [(p + i < end) & (F.get("s", p + i) == F.get("s", p + (i - 1))) for i in range(1, ROWS)]
        apart = F.slice(F.array_distinct(F.slice("s", at, end - p)), 1, ROWS)
        return F.xxhash64(F.lit(b), F.when(functools.reduce(Column.__or__, again), apart).otherwise(least))

    return placed.select(*others, F.array(*[key(b) for b in range(BANDS)]).alias("keys"))


def lines_of(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(row, pos, line, l) of lines that aren't blank, without outer blanks; l
    stands for the line."""
    text = F.col(text_col)
    out = rows.where(text.isNotNull()).select(F.col(key).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
    return out.withColumn("l", F.xxhash64("line"))


def _at(rows: DataFrame, key: str, text_col: str, places: DataFrame) -> DataFrame:
    """(l, line): the lines of lines_of() at places(l, r, p)."""
    every = rows.select(F.col(key).alias("r"), F.posexplode(F.split(text_col, "\n", -1)).alias("p", "line"))
    return every.join(places, ["r", "p"]).select("l", F.btrim("line", F.lit(BLANKS)).alias("line"))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): the pairs(l, c) whose Jaccard similarity reaches the threshold."""
    both = pairs.join(texts, "l").join(texts.select(F.col("l").alias("c"), F.col("line").alias("other")), "c")
    sets = both.select("l", "c", _set_of("line", k).alias("x"), _set_of("other", k).alias("y"))
    shared = sets.select("l", "c", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("n"))
    return shared.where(F.col("shared") >= F.lit(similarity) * (F.col("n") - F.col("shared"))).select(F.col("l").alias("a"), F.col("c").alias("b"))


def _apart(others: DataFrame, families: DataFrame) -> DataFrame:
    """(key, l, component, of): the others(key, l) of buckets whose members are of
    several components, with the number of the bucket's others."""
    named = families.withColumnRenamed("node", "l")
    own = others.join(named, "l", "left").withColumn("component", F.coalesce("component", "l"))
    several = own.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("of")).where("a <> b")
    return own.join(several.select("key", "of"), "key").select("key", "l", "component", "of")


def _marks(texts: DataFrame, k: int) -> DataFrame:
    """(l, n, m0 .. m31, spare): the size of each line's set, its bitmap, and how
    many shingles fell on a bit that another had set."""
    each = texts.select("l", F.explode(_set_of("line", k)).alias("h"))
    word, bit = F.shiftrightunsigned("h", 59), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    maps = [F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"m{i}") for i in range(WORDS)]
    marks = each.select("l", word.alias("word"), bit.alias("bit")).groupBy("l").agg(F.count("*").cast("int").alias("n"), *maps)
    return marks.withColumn("spare", F.col("n") - _sum([F.bit_count(f"m{i}") for i in range(WORDS)]))


def _sum(terms: list[Column]) -> Column:
    return functools.reduce(Column.__add__, terms)


def _may_link(apart: DataFrame, marks: DataFrame, similarity: float, block: int) -> DataFrame:
    """(l, c): all pairs of a bucket of apart(key, l, component, of), of different
    components, that marks doesn't rule out, each in the first bucket of both.  A bit of one line that the other
    lacks is at least one shingle that it lacks; so two lines share at most as many
    shingles as bits, and what is spare in either.  Large buckets are cut into
    blocks of about `block` lines that meet pairwise."""
    each = apart.withColumn("blocks", F.ceil(F.col("of") / block)).withColumn("own", F.pmod(F.xxhash64("l"), "blocks"))
    buckets = apart.groupBy("l").agg(F.collect_set("key").alias("keys"))
    each = each.join(marks, "l").join(buckets, "l").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = each.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("of", "blocks", "other")
    a, b = dealt.alias("a"), dealt.alias("b")
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("key", "lo", "hi")]
    once = (F.col("a.l") < F.col("b.l")) & (F.col("a.component") != F.col("b.component")) & ((F.col("a.own") != F.col("b.own")) | (F.col("a.lo") == F.col("a.hi")))
    sizes = F.least("a.n", "b.n") >= F.lit(similarity) * F.greatest("a.n", "b.n") - 1e-6
    common = _sum([F.bit_count(F.col(f"a.m{i}").bitwiseAND(F.col(f"b.m{i}"))) for i in range(WORDS)])
    enough = (common + F.least("a.spare", "b.spare")) * (1 + similarity) >= F.lit(similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6
    first = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    return a.join(b, [*same, once, sizes, enough, first]).select("a.l", F.col("b.l").alias("c"))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, similarity: float = 0.8, broadcast_rows: int = 300_000, block: int = 512) -> DataFrame:
    """docs with n_lines, of the text (null: 0), and removed: the positions,
    ascending, of lines that repeat an earlier one nearly; a column of docs with
    such a name is renamed with a leading underscore.

    Blank lines, and null or empty texts, take no part.  Rows come in the order of
    their ids; those that repeat an id, or have none (these come last), are rows of
    their own, equal ones in any order.  A tie can't occur: places differ.  Lines
    of fewer than k characters are one shingle.  A line of any length is one row.
    An empty table gives no rows.  Tables of at most broadcast_rows ids go to all
    executors, larger ones are shuffled."""
    require(docs, id_col, text_col)
    scratch = Scratch(spark, "lines")
    names = ("n_lines", "removed")
    clash = {c: n for c, n in zip(names, fresh(docs, *names), strict=True) if c != n}
    docs = docs.withColumnsRenamed({c: clash[c.lower()] for c in docs.columns if c.lower() in clash})
    id_col, text_col = clash.get(id_col.lower(), id_col), clash.get(text_col.lower(), text_col)
    rows, key = keyed(spark, docs, scratch, id_col)
    lines = lines_of(rows, key, text_col)

    def shared_by(df: DataFrame, n: int | None = None) -> DataFrame:
        return F.broadcast(df) if (df.count() if n is None else n) <= broadcast_rows else df

    places = scratch.table(lines.select("row", "pos", "l"), "lines")
    seen = scratch.table(places.groupBy("l").agg(F.min(F.struct("row", "pos")).alias("first"), F.count("*").alias("n")), "seen")

    # a line that occurs very often is signed once, at its first place
    total = seen.agg(F.sum("n")).first()[0] or 0
    often = seen.where(F.col("n") > total / OFTEN).select("l", "first", F.col("n").alias("often"))
    once = lines.join(F.broadcast(often), "l", "left").where("often IS NULL OR (row = first.row AND pos = first.pos)").select("l", "line")
    # keys go from the lines to one exchange, which both the buckets of several lines and
    # their members read (of a semi join the optimizer makes two)
    # (outer, or a filter on the size of keys would sign each line once more)
    banded = sign(once, k).select("l", F.explode_outer("keys").alias("key")).repartition("key")
    several = banded.groupBy("key").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b").select("key")
    met = banded.join(several.hint("shuffle_hash"), "key").groupBy("key", "l").agg(F.count("*").alias("times"))
    with _set(spark, _SIGNING):
        met = scratch.table(met, "met")
    members = met.join(F.broadcast(often.select("l", "often")), "l", "left").select("key", "l", F.coalesce("often", "times").alias("n")).repartition("key")
    ends = members.groupBy("key").agg(F.max(F.struct("n", "l")).alias("top"), F.min("l").alias("least"), F.max("l").alias("most"))
    centres = ends.select("key", F.col("top.l").alias("a"), F.when(F.col("top.l") == F.col("most"), F.col("least")).otherwise(F.col("most")).alias("b"))
    meets = scratch.table(members.join(centres.hint("shuffle_hash"), "key").select("key", "l", "a", "b"), "meets")
    # of two members: one pair; of more, each with both centres
    pairs = meets.select("l", F.explode(F.array("a", "b")).alias("c")).where("l <> c").select(F.least("l", "c").alias("l"), F.greatest("l", "c").alias("c"))
    pairs = scratch.table(pairs.distinct(), "pairs")
    others = scratch.table(meets.where("l <> a and l <> b").select("key", "l"), "others")

    wanted = scratch.table(pairs.select(F.explode(F.array("l", "c")).alias("l")).distinct(), "wanted")
    n_wanted = wanted.count()
    # each wanted line once: at its first place
    first = scratch.table(seen.join(shared_by(wanted, n_wanted), "l").select("l", F.col("first.row").alias("r"), F.col("first.pos").alias("p")), "first")
    texts = scratch.table(_at(rows, key, text_col, shared_by(first, n_wanted)), "texts")
    families = components(spark, _verified(pairs, texts, k, similarity), scratch, "families")

    # members that are no centres, where a bucket has several, against each other
    if not others.isEmpty():
        apart = scratch.table(_apart(others, families), "apart")
        if not apart.isEmpty():
            own = texts.join(apart.select("l").distinct(), "l", "left_semi")
            marks = scratch.table(_marks(own, k), "marks")
            with _set(spark, _SIGNING):
                more = scratch.table(_may_link(apart, marks, similarity, block), "more")
            links = _verified(more, texts, k, similarity).unionByName(families.select(F.col("node").alias("a"), F.col("component").alias("b")))
            families = components(spark, links, scratch, "joined")

    # the first place of each family and of each other line with several occurrences
    place = scratch.table(seen.join(shared_by(families.withColumnRenamed("node", "l")), "l").select("l", "first", "component"), "places")
    keep = place.groupBy("component").agg(F.min("first").alias("keep"))
    alone = seen.where("n > 1").join(place.select("l"), "l", "left_anti").select("l", F.col("first").alias("keep"))
    repeated = scratch.table(place.join(keep, "component").select("l", "keep").unionByName(alone), "repeated")
    again = places.join(repeated, "l").where(~((F.col("row") == F.col("keep.row")) & (F.col("pos") == F.col("keep.pos"))))
    gone = scratch.table(again.groupBy(F.col("row").alias(key)).agg(F.array_sort(F.collect_list("pos")).alias("gone_")), "gone")
    counted = rows.withColumn("n_lines", F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0)))
    return counted.join(gone, key, "left").select(*docs.columns, "n_lines", F.coalesce("gone_", F.array().cast("array<int>")).alias("removed"))


def without(text: Column, removed: Column) -> Column:
    """A text without the lines at the positions removed; null stays null."""
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) > 0, F.array_join(left, "\n")).otherwise(text)
