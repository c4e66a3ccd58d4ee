"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word shingles.  Shingles fall into groups by
hash, as many groups as keep about eight shingles in each; the counts of a set in
the groups are a point.  Two sets share at most the sum over groups of the smaller
count, so an R-tree over points prunes a node if the summed minima with its upper
corner stay below the overlap that the threshold asks for.  (With a fixed number of
groups the minima of long unrelated sets would come near their sizes and prune
nothing.)  Pairs that survive are verified on the sets.

The points meet in many small trees rather than one: sets at the threshold must
share one of the first n - ceil(t n) + 1 shingles of any common order, so each
set goes to the trees of these, apart by bands of set size; a tree of one leaf is
that leaf.  The order puts shingles of rare words first and those last that a bounded
sample finds in several documents; any order gives the same result.  Equal sets are
one point, and trees of the same sets one tree: two near copies share hundreds of
shingles, and meet once.  With l - 1 shingles more in each prefix, sets at the
threshold share l; so a pair that meets in leaves only must meet l times before its
points do.  (Unrelated sets that share a shingle or two grow with the square of the
input, and long ones have large points.)  Trees of nearly the same sets are one, too.

Where more than a block of sets share a shingle, they first meet their centre, the
one with most such shingles, and links found bear one label.  Only sets with
another label than most then meet the rest, block by block.  Trees give a forest of
possible links between labels, its components (near-duplicate families) are
verified each in one place, or in blocks of bounded bytes, and links grow into
components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, components, encoded, grams, lower_ascii, mix, partitions, require, span_hashes, tidy, word_spans
from .grouping import blocks_of, dealt, forest, grow

#: Groups of a short set, and shingles a group of a long one.
GROUPS, FILL = 64, 8
LEAF = 8
_MANY = 255  # a count that stands for itself or more
#: Words are counted by so many last bits of their hash.
WORD_BITS = 18
#: Shingles that two long sets at the threshold must share in their prefixes; a key's
#: last bits hold the number that its band asks for, less 1.
SHARED = 8


def _words(texts, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of runs of texts, and where in them each text begins and ends."""
    for _, _, buf, offsets in chunks(texts):
        if lower:
            buf = lower_ascii(buf)
        starts, ends = word_spans(buf)
        yield span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def shingle_sets(texts, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  With fewer than n words, but
    some, the whole sequence is one shingle."""
    for words, at in _words(texts, lower):
        every = grams(words, n)
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s >= n:
                yield np.unique(every[s : e - n + 1])
            elif e > s:
                yield grams(words[s:e], int(e - s))
            else:
                yield np.zeros(0, np.uint64)


def ranked_sets(texts, n: int, weights: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of shingle_sets, with the summed weights of each shingle's words."""
    for words, at in _words(texts, lower):
        every = grams(words, n)
        sums = np.concatenate(([0], np.cumsum(weights[_slots(words)], dtype=np.int64)))
        sums = sums[n:] - sums[:-n]
        for s, e in zip(at[:-1], at[1:], strict=True):
            if e - s >= n:
                found, where = np.unique(every[s : e - n + 1], return_index=True)
                yield found, sums[s : e - n + 1][where]
            elif e > s:
                yield grams(words[s:e], int(e - s)), np.zeros(1, np.int64)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def in_order(s: np.ndarray, sums: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A set in the common order: by the weight of its words, then by hash; those of
    the sorted `late` last."""
    last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
    rank = np.where(last, 32767, np.minimum(sums, 32766)).astype(np.int16)
    return s[np.argsort(rank, kind="stable")]


def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set in its groups, whose number is a power of two."""
    groups = max(GROUPS, 1 << max(0, (len(s) // FILL).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups), _MANY).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def size_bands(n: int, percent: int) -> list[int]:
    """Bands of set sizes, such that any two sizes that may link share one: a
    size's own, and the next if a partner may lie there."""
    if not n:
        return []
    step = 4 * math.log(100 / percent) if percent < 100 else 1.0
    own, high = int(math.log(n) / step + 1e-9), int(math.log(n * 100 / percent) / step + 1e-6)
    return list(range(own, high + 1))


def asked(band: int, percent: int) -> int:
    """How many shingles of their prefixes two sets at the threshold share at least in
    the band that is the larger one's own: more in bands of larger sets."""
    step = 4 * math.log(100 / percent) if percent < 100 else 1.0
    least = int(math.exp(min(band * step, 40.0)) * (1 - 1e-6))
    return max(1, min(SHARED, least // 16 + 1, percent * least // 100))


def keys_of(ordered: np.ndarray, percent: int) -> np.ndarray:
    """The trees of a set in the common order: its prefix in each of its bands."""
    n, out = len(ordered), [np.zeros(0, np.uint64)]
    for band in size_bands(n, percent):
        most = asked(band, percent)
        first = mix(ordered[: prefix_length(n, percent) + most - 1] ^ np.uint64(band))
        out.append(first & ~np.uint64(SHARED - 1) | np.uint64(most - 1))
    return np.concatenate(out)


def folded(points: list[bytes], sizes: np.ndarray, groups: int) -> np.ndarray:
    """Points as rows of counts in so many groups, at most as many as each has."""
    out = np.empty((len(points), groups), np.int64)
    lengths = np.array([len(p) for p in points])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        p = np.frombuffer(b"".join([points[i] for i in at]), np.uint8).reshape(len(at), length).astype(np.int64)
        p = np.where(p == _MANY, sizes[at][:, None], p)
        out[at] = p.reshape(len(at), length // groups, groups).sum(axis=1)
    return out


def may_link(pa, na, pb, nb, percent: int) -> np.ndarray:
    """Whether the summed minima leave room for the threshold."""
    most = np.minimum(np.minimum(pa, pb).sum(axis=-1), np.minimum(na, nb))
    return (100 + percent) * most >= percent * (na + nb)


class CountTree:
    """R-tree over count vectors, bulk-loaded by halving on the widest group."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            ids = todo.pop()
            if len(ids) <= LEAF:
                leaves.append(ids)
                continue
            cut = points[ids]
            g = np.argmax(cut.max(axis=0) - cut.min(axis=0))
            ids = ids[np.argsort(cut[:, g], kind="stable")]
            todo += [ids[len(ids) // 2 :], ids[: len(ids) // 2]]
        self.leaves = leaves
        self.levels = []  # from the leaves up: upper corners, least sizes
        top = np.array([points[x].max(axis=0) for x in leaves])
        low = np.array([sizes[x].min() for x in leaves])
        self.levels.append((top, low))
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            top, low = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(low, cuts)
            self.levels.append((top, low))

    def search(self, point: np.ndarray, size: int, percent: int, free: np.ndarray) -> np.ndarray:
        """Points marked free that may link with the given one."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            most = np.minimum(np.minimum(top[nodes], point).sum(axis=1), size)
            nodes = nodes[(100 + percent) * most >= percent * (size + low[nodes])]
            if depth and len(nodes):
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        if not len(nodes):
            return nodes
        ids = np.concatenate([self.leaves[k] for k in nodes])
        ids = ids[free[ids]]
        return ids[may_link(self.points[ids], self.sizes[ids], point, size, percent)]


def linked(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sorted sets of several labels, verified."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    points = [point(s).tobytes() for s in sets]
    tree = CountTree(folded(points, size, min(map(len, points))), size)

    def near(i: int, free: np.ndarray) -> np.ndarray:
        ids = tree.search(tree.points[i], size[i], percent, free)
        ids = ids[(100 * np.minimum(size[ids], size[i]) >= percent * np.maximum(size[ids], size[i]))]
        if not len(ids):
            return ids
        at = np.repeat(start[ids], size[ids]) + np.arange(size[ids].sum()) - np.repeat(np.cumsum(size[ids]) - size[ids], size[ids])
        values = flat[at]
        where = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
        shared = np.add.reduceat((sets[i][where] == values).astype(np.int64), np.cumsum(size[ids]) - size[ids])
        return ids[(100 + percent) * shared >= percent * (size[ids] + size[i])]

    return grow(labels, near)


def _reach(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[bool]:
    """Whether each two sets link."""
    out = []
    for a, b in zip(left, right, strict=True):
        small, large = min(len(a), len(b)), max(len(a), len(b))
        shared = len(np.intersect1d(a, b, assume_unique=True)) if small and 100 * small >= percent * large else 0
        out.append(shared > 0 and (100 + percent) * shared >= percent * (small + large))
    return out


def _possible(percent: int):
    def links(frame: pd.DataFrame) -> list[tuple[int, int]]:
        payload, sizes = frame["payload"].tolist(), frame["n"].to_numpy()
        points = folded(payload, sizes, min(map(len, payload)))
        tree = CountTree(points, sizes)
        return grow(frame["label"].to_numpy(), lambda i, free: tree.search(points[i], sizes[i], percent, free))

    def pairs(frame: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n, label, payload = frame["n"].to_numpy(), frame["label"].to_numpy(), frame["payload"]
        ok = (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])) & (label[left] != label[right])
        length = payload.map(len).to_numpy()
        least = np.minimum(length[left], length[right])
        for groups in np.unique(least[ok]):
            at = np.flatnonzero(ok & (least == groups))
            most = max(1, (4 << 20) // int(groups))
            for k in range(0, len(at), most // 8 + 1):
                part = at[k : k + most // 8 + 1]
                rows, where = np.unique(np.concatenate([left[part], right[part]]), return_inverse=True)
                points = folded(payload.iloc[rows].tolist(), n[rows], int(groups))
                half = len(part)
                ok[part] = may_link(points[where[:half]], n[left[part]], points[where[half:]], n[right[part]], percent)
        return ok

    return links, pairs


def once(members: DataFrame) -> DataFrame:
    """members(group, node) of one group of those that have the same nodes, which are
    known by their number and 128 bits of hashes; with their number n, times, how
    many such groups there are by the number that they ask for, and wide, which
    groups of nearly the same nodes mostly have in common (two minima of hashes)."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))) for seed in (3, 7)]
    least = F.xxhash64(*[F.min(F.xxhash64("node", F.lit(seed))) for seed in (11, 13)])
    groups = members.groupBy("group").agg(F.count("*").alias("n"), marks[0].alias("x"), marks[1].alias("y"), least.alias("wide"))
    by_asked = groups.groupBy("n", "x", "y", "wide", (F.col("group").bitwiseAND(SHARED - 1) + 1).alias("asked")).agg(F.min("group").alias("group"), F.count("*").alias("times"))
    kept = by_asked.groupBy("n", "x", "y", "wide").agg(F.min("group").alias("group"), F.map_from_entries(F.collect_list(F.struct("asked", "times"))).alias("times"))
    return members.join(kept.select("group", "n", "times", "wide"), "group")


def met_enough(members: DataFrame, few: int, block: int) -> DataFrame:
    """(group, node): the members of once(), of which groups with one `wide` are one
    where that has at most `block` nodes.  (A family of near copies has a group of
    nearly all for every shingle that some lack.)  Of groups of at most `few`, instead,
    each pair that meets in them as often as asked, as a group of its own."""
    small = members.where(F.col("n") <= few)
    a = small.select("group", "times", F.col("node").alias("a"))
    pairs = a.join(small.select("group", F.col("node").alias("b")), "group").where("a < b")
    pairs = pairs.select("a", "b", F.explode("times").alias("asked", "times"))
    pairs = pairs.groupBy("a", "b", "asked").agg(F.sum("times").alias("times")).where("times >= asked").select("a", "b").distinct()
    own = pairs.select(F.xxhash64("a", "b").alias("group"), F.explode(F.array("a", "b")).alias("node"))
    large = members.where(F.col("n") > few)
    joint = large.where(F.col("n") <= block).select(F.col("wide").alias("group"), "node").distinct()
    fit = joint.groupBy("group").agg(F.count("*").alias("of")).where(F.col("of") <= block).select("group")
    rest = large.join(fit.select(F.col("group").alias("wide"), F.lit(True).alias("fits")), "wide", "left").where((F.col("n") > block) | F.col("fits").isNull())
    return rest.select("group", "node").unionByName(joint.join(fit, "group")).unionByName(own)


def _digest(s: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def similar(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    percent: int = 90,
    lower: bool = True,
    sample: int = 6000,
    block: int = 1024,
    family_block: int = 128,
    family_bytes: int = 4 << 20,
    broadcast_rows: int = 300_000,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: the size of its
    set, and the smallest id that links reach.  Two rows link if 100 * shared >=
    percent * all shingles of both.  Other columns of docs are not returned.

    A null or wordless text has no shingles and links with nothing.  A null id
    takes part in no link and has a null component.  Rows that repeat an id are
    one node, with the links of all.  An empty table gives no rows.  Ties can't
    occur: links don't depend on an order.  A text is held whole, however long.

    sample only steers the common order, as do the million shingles most frequent
    in it and the counts of its words; block bounds the points, family_block and family_bytes the sets that a
    task holds at a time (half of them; a longer set is a block of its own); a
    table of at most broadcast_rows ids, or of broadcast_bytes of text, goes to all
    executors, a larger one is shuffled.
    """
    require(docs, id_col, text_col)
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1 to 100")
    scratch = Scratch(spark, "ngram")
    tasks = partitions(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def shared_by(df: DataFrame, name: str) -> DataFrame:
        """The table of that name, which was counted."""
        return F.broadcast(df) if scratch.rows[name] <= broadcast_rows else df

    # the words of sampled documents are counted; shingles of more than one class of
    # them go to the end of the order
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for words, _ in _words(encoded(frame["text"]), lower):
                slot, times = np.unique(_slots(words), return_counts=True)
                yield pd.DataFrame({"slot": slot, "times": times})

    def of_sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = {s.tobytes(): s for s in shingle_sets(encoded(frame["text"]), n, lower)}
            for s in seen.values():
                yield pd.DataFrame({"h": s.view(np.int64), "of": s[:1].view(np.int64).repeat(len(s))})

    picked = given.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sampled = scratch.table(given.join(F.broadcast(picked.distinct()), "doc_id"), "sampled")
    often = sampled.mapInPandas(tidy(of_sample), "h long, of long").groupBy("h").agg(F.min("of").alias("a"), F.max("of").alias("b"), F.count("*").alias("of")).where("a <> b")
    often = scratch.table(often.orderBy(F.col("of").desc(), "h").limit(1 << 20).select("h"), "often")
    known = scratch.table(sampled.mapInPandas(tidy(counted), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")), "words").toArrow()
    scratch.drop("sampled")
    weights = np.zeros(1 << WORD_BITS, np.uint8)
    weights[known["slot"].to_numpy()] = np.minimum(np.rint(8 * np.log2(1 + known["times"].to_numpy())), 255)
    order = spark.sparkContext.broadcast((np.sort(often.toArrow()["h"].to_numpy().view(np.uint64)), weights))

    def to_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, weights = order.value
        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            out = []
            for s, sums in ranked_sets(encoded(frame["text"]), n, weights, lower):
                first = keys_of(in_order(s, sums, late), percent)
                out.append((len(s), *_digest(s), point(s).tobytes(), first.view(np.int64)))
            yield pd.DataFrame(out, columns=["n", "d1", "d2", "payload", "prefix"]).assign(doc_id=frame["doc_id"].array, row=np.arange(row, row + len(frame)))
            row += len(frame)

    schema = "n long, d1 long, d2 long, payload binary, prefix array<long>, doc_id string, row long"
    named = given.select(F.col("doc_id").cast("string"), "text")  # a long with nulls would come as a double
    sets = scratch.table(named.mapInPandas(tidy(to_sets), schema).withColumn("doc_id", F.col("doc_id").cast("long")), "sets")
    some = sets.where("n > 0 and doc_id is not null")
    classes = scratch.counted(some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row"), "classes")
    reps = some.join(shared_by(classes, "classes"), "row", "left_semi")
    reps = scratch.table(reps.select(F.xxhash64("d1", "d2").alias("node"), "doc_id", "d1", "d2", "n", "payload", "prefix"), "reps")
    rows_of = scratch.table(sets.select("doc_id", "n", "d1", "d2"), "classed")
    scratch.drop("sets")
    points = scratch.table(reps.drop("prefix"), "points")
    own = points.select("node", "doc_id", "d1", "d2", "n")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        """nodes(node, ...) with d1, d2 and their text; a repeated id may bring others."""
        wanted = scratch.counted(nodes.join(own.select("node", "doc_id", "d1", "d2"), "node"), name)
        return given.join(shared_by(wanted, name), "doc_id").drop("doc_id")

    def sets_of(frame: pd.DataFrame, text: str = "text", d1: str = "d1", d2: str = "d2") -> list[np.ndarray | None]:
        found = shingle_sets(encoded(frame[text]), n, lower)
        return [s if _digest(s) == key else None for s, key in zip(found, zip(frame[d1], frame[d2], strict=True), strict=True)]

    def star(mine: DataFrame) -> DataFrame:
        """(node, component) of the links that mine(node, group, keys) have with
        the centre of their group, the member with most keys."""
        centres = mine.groupBy("group").agg(F.max(F.struct("keys", "node")).alias("c")).select("group", F.col("c.node").alias("centre"))
        texts = scratch.table(texts_of(mine.select("node", "group"), "mine-ids"), "hot-texts")
        centres = texts.join(F.broadcast(centres), "group").where("node = centre")
        centres = scratch.table(centres.select("group", "centre", F.col("text").alias("ct"), F.col("d1").alias("c1"), F.col("d2").alias("c2")), "centres")
        held = centres.agg(F.coalesce(F.sum(F.octet_length("ct") + 64), F.lit(0))).first()[0]
        rows = texts.join(F.broadcast(centres) if held <= broadcast_bytes else centres, "group").where("node <> centre")

        def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                once = frame.drop_duplicates("centre")
                sets = dict(zip(once["centre"], sets_of(once, "ct", "c1", "c2"), strict=True))
                none = np.zeros(0, np.uint64)
                left = [none if s is None else s for s in sets_of(frame)]
                right = [none if sets[c] is None else sets[c] for c in frame["centre"]]
                ok = _reach(left, right, percent)
                yield pd.DataFrame({"a": frame["node"][ok], "b": frame["centre"][ok]})

        return components(spark, rows.mapInPandas(tidy(reached), "a long, b long"), scratch, "star")

    def labelled(labels: DataFrame) -> DataFrame:
        """The representatives with their label, by default their node."""
        return points.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    keys = reps.select(F.explode("prefix").alias("group"), "node")
    shared = scratch.table(keys.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    crowded = scratch.counted(shared.where(F.col("n") > block).select("group"), "crowded")
    labels = points.select("node", F.col("node").alias("component")).where("false")
    if n_crowded := scratch.rows["crowded"]:
        crowd = scratch.table(keys.join(F.broadcast(crowded) if n_crowded <= broadcast_rows else crowded, "group"), "crowd")
        labels = star(scratch.table(crowd.groupBy("node").agg(F.min("group").alias("group"), F.count("*").alias("keys")), "mine"))
        scratch.drop("hot-texts", "centres")
        cut = scratch.table(blocks_of(crowd.join(labelled(labels).select("node", "label"), "node"), block), "cut")
        shared = shared.where(F.col("n") <= block).select("group").unionByName(cut.select("group"))
    else:
        cut = shared.where("false").select("group", F.col("group").alias("major"), F.lit(0).alias("blocks"), F.lit(0).alias("rest"))
    every = scratch.table(keys.join(shared.select("group"), "group"), "every")
    scratch.drop("reps")
    met = scratch.table(once(every), "met")
    scratch.drop("every")
    members = scratch.table(met_enough(met, min(LEAF, block), block), "members")
    scratch.drop("met")
    rows = members.join(labelled(labels).select("node", "n", "payload", "label"), "node")
    links, pairs = _possible(percent)
    maybe = forest(dealt(rows, cut.where("blocks > 1"), tasks), links, pairs, LEAF)
    alike = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    families = components(spark, maybe.unionByName(alike), scratch, "families")
    scratch.drop("members")

    # each family's sets in one place, or in blocks
    home = families.select("node", F.col("component").alias("group")).join(labelled(labels).select("node", (F.col("n") * 8).alias("held"), "label"), "node")
    home = scratch.table(home.select("node", "group", "held", "label"), "home")
    cut = scratch.counted(blocks_of(home, family_block, "held", family_bytes), "family-cut")
    mixed = home.join(shared_by(cut.select("group"), "family-cut"), "group").select("node", "group", "label")

    def verified(frame: pd.DataFrame) -> list[tuple[int, int]]:
        sets = sets_of(frame)
        first = ~frame["node"].duplicated().to_numpy()
        at = [i for i, s in enumerate(sets) if s is not None and first[i]]
        if len(at) < len(sets):  # of a repeated id, the first that has the text
            seen: dict[int, int] = {}
            for i, (s, node) in enumerate(zip(sets, frame["node"], strict=True)):
                if s is not None:
                    seen.setdefault(node, i)
            at = sorted(seen.values())
        if len(at) < 2:
            return []
        found = linked([sets[i] for i in at], frame["label"].to_numpy()[at], percent)
        return [(at[i], at[j]) for i, j in found]

    real = forest(dealt(texts_of(mixed, "family-ids"), cut.where("blocks > 1"), tasks), verified)
    node_of = components(spark, real.unionByName(alike), scratch, "links")

    # rows of a class are one node each by id; an id with several texts joins its classes
    linked_reps = points.select("node", "d1", "d2").join(shared_by(node_of, "links-labels"), "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    rows = rows_of.join(linked_reps, ["d1", "d2"], "left")
    rows = scratch.table(rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component")), "rows")
    named = rows.where("component is not null")
    least = scratch.table(named.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    twice = named.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    twice = scratch.counted(twice, "twice")
    if scratch.rows["twice"]:
        more = named.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("component").alias("b"))
        wide = components(spark, more, scratch, "ids").select(F.col("node").alias("component"), F.col("component").alias("wide"))
        least = least.join(wide, "component", "left").withColumn("wide", F.coalesce("wide", "component"))
        low = least.groupBy("wide").agg(F.min("least").alias("low"))
        least = scratch.table(least.join(low, "wide").select("component", F.col("low").alias("least")), "least-wide")
    out = rows.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
