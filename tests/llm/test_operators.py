"""Operators against brute force on small tables with nulls, ties and clashes."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, fingerprints, html_text, line_dedup, mixing, ngram_join, repeats, sharding, token_counts, toxicity
from tessera.llm.common import Scratch, components

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, size string, score string"


def rows():
    base = [f"w{i % 37} v{i} x{i % 11}" for i in range(60)]
    out = []
    for i in range(30):
        t = " ".join(base[i : i + 20])
        out.append((i, t, f"s{i % 3}", "1", "a"))
    out += [(30 + i, out[3][1], "s0", "1", "a") for i in range(5)]
    out += [(40, out[3][1] + " one more", None, "1", None), (41, None, None, None, None), (42, "", "s1", "", ""), (43, "  \n\t ", "s2", "", ""), (44, "only two", "s2", "", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, t or "")


def test_shards(spark, docs, empty):
    got = sharding.shard(spark, docs, 3).collect()
    assert len(got) == len(rows()) and "_size" in got[0].asDict()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in got)
    assert sharding.shard(spark, empty, 3).count() == 0


def test_mix(spark, docs, empty):
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows())
    total = sum(len(words(r[1])) for r in rows())
    by = {}
    for r in got:
        assert r["size"] == len(words(r.text)) and r.taken == r["size"] * r.copies and r.copies <= 3
        t, n = by.get(r.source, (r.target, 0))
        by[r.source] = (t, n + r.taken)
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6
    assert all(abs(t - n) <= 70 for t, n in by.values())
    assert mixing.mix(spark, empty).count() == 0


def test_similar(spark, docs, empty):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.similar(spark, docs).collect()}
    sets = {}
    for i, t, *_ in rows():
        w = words((t or "").lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if v == old else v for k, v in part.items()}
    assert got == {i: (len(sets[i]), part[i]) for i in sets}
    assert ngram_join.similar(spark, empty).count() == 0


def test_repeats(spark, docs, empty):
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(spark, docs).collect()}
    first, want = {}, {}
    for i, t, *_ in rows():
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert got == want
    assert repeats.remove_repeats(spark, empty).count() == 0


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark, docs).collect()}
    given = sorted((r[0], r[1] or "") for r in rows())
    for k, (i, t) in enumerate(given):
        q = len(t) // 4
        edited = t[: len(t) - q] + given[(k + 1) % len(given)][1][:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[30].fingerprint == got[31].fingerprint == got[3].fingerprint and got[30].near_next == 1
    assert fingerprints.fingerprints(spark, empty).count() == 0


def test_scores_and_pages(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and "_score" in got[0].asDict()
    assert html_text.extract(docs.withColumn("html", F.col("text"))).count() == len(rows())


def test_lines(spark, empty):
    long = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = spark.createDataFrame([(1, f"{long}\nA\n\n"), (2, f"B\n{long}!\nA"), (3, None), (4, "")], "doc_id long, text string")
    got = line_dedup.dedup(spark, docs.withColumn("removed", F.lit("x")))
    assert {r.doc_id: (r.n_lines, r.removed, r._removed) for r in got.collect()} == {1: (4, [], "x"), 2: (3, [1, 2], "x"), 3: (0, [], "x"), 4: (1, [], "x")}
    texts = got.select("doc_id", line_dedup.without(F.col("text"), F.col("removed")).alias("text")).collect()
    assert {r.doc_id: r.text for r in texts} == {1: f"{long}\nA\n\n", 2: "B", 3: None, 4: ""}
    assert line_dedup.dedup(spark, empty).count() == 0
    # repeated and null ids are rows of their own
    again = spark.createDataFrame([(1, "A\nB"), (1, "C\nA"), (None, "C\nD"), (None, "D")], "doc_id long, text string")
    left = [r.t for r in line_dedup.dedup(spark, again).select(line_dedup.without(F.col("text"), F.col("removed")).alias("t")).collect()]
    assert sorted(x for t in left for x in t.split("\n") if x) == list("ABCD")


def test_lines_of_a_template(spark):
    """Far more different lines in a bucket than it has centres, against all pairs."""
    rng = random.Random(5)
    stem = "".join(rng.choices("abcdefgh", k=106))
    lines = []
    for _ in range(600):
        own = "".join(rng.choices("ijklmnop", k=4))
        lines += [f"x{stem}{own}" + "".join(rng.choices("ijklmnop", k=10)) for _ in range(2)]
    rng.shuffle(lines)
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    part = list(range(len(lines)))
    for b in range(len(lines)):
        for a in range(b):
            if part[a] != part[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    want = {i: [k for k in range(30) if part[30 * i + k] != 30 * i + k] for i in range(40)}
    assert sum(map(len, want.values())) == 1137
    docs = spark.createDataFrame([(i, "\n".join(lines[30 * i : 30 * i + 30])) for i in range(40)], "doc_id long, text string")
    for block in (512, 7):
        got = {r.doc_id: r.removed for r in line_dedup.dedup(spark, docs, block=block).collect()}
        same = sum(len(set(got[i]) & set(want[i])) for i in want)
        assert same >= 0.98 * 1137 and sum(map(len, got.values())) == same


def test_near_copies_of_repeated_and_null_ids(spark):
    a, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "acd")
    given = [(3, c), (5, a), (5, c + " more"), (None, "one " + c), (None, d), (None, d), (7, None), (None, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, c), (5, a), (None, d), (7, None), (None, "")], key=str)


def test_token_counts(spark, docs, empty, tmp_path):
    """Of a vocabulary of single bytes, tokens are bytes."""
    names = tmp_path / "bytes.tiktoken"
    names.write_text("".join(f"{base64.b64encode(bytes([k])).decode()} {k}\n" for k in range(256)))
    own = docs.withColumn("n_tokens", F.lit("x")).unionByName(spark.createDataFrame([(90, "a\n\n\u00e9 b\n", "s", "1", "a", "x")], f"{SCHEMA}, n_tokens string"))
    got = token_counts.token_counts(spark, own, vocabulary=str(names)).collect()
    assert len(got) == len(rows()) + 1
    for r in got:
        raw = (r.text or "").encode()
        assert r.n_tokens == len(raw) and r["_n_tokens"] == "x"
        assert r.section_tokens == [len(x) for x in raw.splitlines(keepends=True)]
    assert token_counts.token_counts(spark, empty, vocabulary=str(names)).count() == 0


def test_leaks_and_mix(spark, docs, empty, tmp_path):
    item = " ".join(f"i{k}" for k in range(10))
    benchmark = spark.createDataFrame([(1, item), (2, "a b"), (None, "w3 v3 x3 w4"), (3, None)], "item_id long, text string")
    given = spark.createDataFrame([(1, f"x {item}", "a"), (2, "i0 i1 i2 I3, i4 z", "a"), (3, "i0 i1 i2 i3 z", "a"), (4, None, "a"), (5, "", "a")], "doc_id long, text string, item_id string")
    for block_bytes in (1 << 20, 10):
        got = {r.doc_id: (r.item_id, r.coverage, r.tiles, r["items"], r["_item_id"]) for r in decontamination.coverage(spark, given, benchmark, block_bytes=block_bytes).collect()}
        assert got == {1: (1, 1.0, 1, 1, "a"), 2: (1, 0.5, 1, 1, "a"), 3: (1, 0.4, 1, 0, "a"), 4: (None, 0.0, 0, 0, "a"), 5: (None, 0.0, 0, 0, "a")}
    assert decontamination.coverage(spark, empty, benchmark).count() == 0
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.drop_leaks(spark, given, str(tmp_path))
    assert left.columns == given.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark, docs).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    ids = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and {i: ids.count(i) for i in copies} == copies


def test_groups_of_the_same_sets_are_one(spark, monkeypatch):
    """Near copies share hundreds of shingles; their trees hold each once (F1)."""
    held, dealt = [], ngram_join.dealt

    def counted(members, cut, tasks):
        held.append(members.count())
        return dealt(members, cut, tasks)

    monkeypatch.setattr(ngram_join, "dealt", counted)
    given = []
    for i in range(20):
        w = [f"t{i}w{k}" for k in range(1000)]
        given += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(["new", *w])), (3 * i + 2, " ".join([*w, "end"]))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar(spark, docs, n=5, percent=80).collect()}
    assert got == {i: i - i % 3 for i in got} and len(got) == 60
    assert held[0] <= 60 * 8


def test_rare_words_come_first_in_the_order():
    """Unrelated texts of few common words meet by none of their first shingles."""
    rng = random.Random(3)
    texts = [" ".join(f"r{rng.randrange(10**6)}" if rng.random() < 0.4 else rng.choice("abcd") for _ in range(300)).encode() for _ in range(200)]
    words = [h for found, _ in ngram_join._words(texts, True) for h in ngram_join._slots(found).tolist()]
    weights = np.minimum(8 * np.log2(1 + np.bincount(words, minlength=1 << ngram_join.WORD_BITS)), 255).astype(np.uint8)
    none = np.zeros(0, np.uint64)
    firsts = [ngram_join.in_order(s, sums, none)[: ngram_join.prefix_length(len(s), 90)] for s, sums in ngram_join.ranked_sets(texts, 3, weights)]
    assert all(set(s) == set(ngram_join.in_order(s, sums, none)) for s, (s2, sums) in zip(ngram_join.shingle_sets(texts, 3), ngram_join.ranked_sets(texts, 3, weights), strict=True))
    every = np.concatenate(firsts)
    assert len(np.unique(every)) == len(every)


def test_near_copies_of_a_common_line_meet_it_first(spark, monkeypatch):
    """Variants that only the commonest line joins leave no pairs to compare (F2)."""
    rng = random.Random(8)
    line = [f"{x}word{k}" for k, x in enumerate(rng.choices("abcdefgh", k=22))]
    lines = [" ".join(line)] * 50
    for i in range(60):
        w = list(line)
        w[rng.randrange(22)] = "".join(rng.choices("qrstuvwxyz", k=9))
        lines.append(" ".join(w))
    left, may_link = [], line_dedup._may_link

    def counted(apart, *given):
        left.append(apart.count())
        return may_link(apart, *given)

    monkeypatch.setattr(line_dedup, "_may_link", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup(spark, docs).collect()}
    assert got == {i: [0] if i else [] for i in range(110)} and sum(left) == 0


def test_lines_sign_once_and_as_sets(spark):
    """Lines of 24 to 31 words signed twice; what a shingle repeats doesn't count (F1)."""
    texts = [" ".join(f"w{i}" for i in range(28)), "ha " * 40 + "ha", "ha " * 60 + "ha", "the same words again, " * 3 + "the", "the same words again, " * 9 + "the"]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "row_ long, text string")
    keys = {r.pos: r["keys"] for r in line_dedup.sign(line_dedup.lines_of(docs, "row_", "text"), 8).collect()}
    assert line_dedup.sign(line_dedup.lines_of(docs, "row_", "text"), 8).count() == len(keys) == 5
    assert keys[1] == keys[2] and keys[3] == keys[4] and keys[0] != keys[1] != keys[3]


def test_lines_cross_one_exchange_to_their_buckets(spark, monkeypatch):
    """Buckets of several lines and their members read the same shuffle (F1)."""
    plans, table = [], line_dedup.Scratch.table

    def shown(self, df, name):
        if name == "met":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(line_dedup.Scratch, "table", shown)
    line = "some line of words that many documents hold"
    docs = spark.createDataFrame([(i, f"{line} {i % 7}\nof its own {i}") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup(spark, docs).collect()}
    assert got[0] == [] and all(0 in got[i] for i in range(1, 40))
    assert "ReusedExchange" in plans[0]


def test_sets_that_share_few_shingles_do_not_meet(spark, monkeypatch):
    """Points of long unrelated sets that share a shingle or two stay out of the trees;
    near copies stay in, at the threshold too (F1)."""
    held, dealt = [], ngram_join.dealt

    def counted(members, cut, tasks):
        held.append(members.count())
        return dealt(members, cut, tasks)

    monkeypatch.setattr(ngram_join, "dealt", counted)
    rng, given = random.Random(4), []
    for i in range(40):
        w = [f"t{i}w{k}" for k in range(400)]
        for j in range(40):  # a run of seven words with each other text: three shingles
            low, high = sorted((i, j))
            w[10 * j : 10 * j + 7] = [f"p{low}q{high}r{k}" for k in range(7)]
        given.append((i, " ".join(w)))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar(spark, docs, n=5, percent=80).collect()}
    assert got == {i: i for i in range(40)} and held[0] == 0
    for size in (9, 30, 100, 300):  # a run of new words at the end or within: 80 percent and less
        for i in range(30):
            w = [f"s{size}t{i}w{k}" for k in range(size + 4)]
            new = rng.randrange(0, size // 4 + 2)
            at = rng.choice([0, rng.randrange(size + 4 - new), size + 4 - new])
            given += [(len(given), " ".join(w)), (len(given) + 1, " ".join([*w[:at], *[f"n{k}" for k in range(new)], *w[at + new :]]))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in given]
    want = {i: i for i in range(len(given))}
    for i in range(40, len(given), 2):
        if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]):
            want[i + 1] = i
    assert 40 < sum(k != v for k, v in want.items()) < 115
    assert {r.doc_id: r.component_id for r in ngram_join.similar(spark, docs, n=5, percent=80).collect()} == want


def test_groups_of_nearly_the_same_nodes_are_one(spark, monkeypatch):
    """A family of near copies has as many groups as shingles that some lack (F1)."""
    held, dealt = [], ngram_join.dealt

    def counted(members, cut, tasks):
        held.append(members.count())
        return dealt(members, cut, tasks)

    monkeypatch.setattr(ngram_join, "dealt", counted)
    rng, given = random.Random(6), []
    for i in range(4):
        w = [f"t{i}w{k}" for k in range(500)]
        for _ in range(24):
            given.append((len(given), " ".join("new" if rng.random() < 0.005 else x for x in w)))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for block in (1024, 10):  # blocks of fewer nodes than a group, too
        got = {r.doc_id: r.component_id for r in ngram_join.similar(spark, docs, n=5, percent=80, block=block).collect()}
        assert got == {i: i - i % 24 for i in range(96)}
    assert held[0] <= 96 * 12


def test_keys_of_lines_are_held_once(spark, monkeypatch):
    """No table has the keys beside the exchange, and a line that occurs very often is
    signed at its first place only (F2)."""
    tables, signed, table, sign = {}, [], line_dedup.Scratch.table, line_dedup.sign

    def shown(self, df, name):
        tables[name] = df.columns
        return table(self, df, name)

    def counted(lines, k):
        signed.append(lines.count())
        return sign(lines, k)

    monkeypatch.setattr(line_dedup.Scratch, "table", shown)
    monkeypatch.setattr(line_dedup, "sign", counted)
    monkeypatch.setattr(line_dedup, "OFTEN", 10)
    line = "some line of words that many documents hold"
    docs = spark.createDataFrame([(i, f"{line}\nof its own {i} {'abcdefgh'[i % 8] * 30}") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup(spark, docs).collect()}
    assert got[0] == [] and all(0 in got[i] for i in range(1, 40))
    assert signed == [41] and not any("keys" in c for c in tables.values())


def test_components_of_long_chains_in_few_queries(spark):
    """Each query stays in the driver's memory, with its plan and the figures of its tasks."""
    nodes = list(range(120))
    random.Random(5).shuffle(nodes)
    links = [*zip(nodes[:59], nodes[1:60], strict=True), *[(nodes[60], x) for x in nodes[61:90]], (nodes[90], nodes[90])]
    done = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = done.executionsCount()
    scratch = Scratch(spark, "test")
    out = components(spark, spark.createDataFrame(links, "a long, b long"), scratch, "cc")
    bus.waitUntilEmpty(30_000)
    queries = done.executionsCount() - before
    want = {x: min(nodes[:60]) for x in nodes[:60]} | {x: min(nodes[60:90]) for x in nodes[60:90]}
    assert {r.node: r.component for r in out.collect()} == want
    assert out.count() == scratch.rows["cc-labels"] == 90
    assert queries <= 24
    assert components(spark, out.where("false").toDF("a", "b"), scratch, "none").count() == scratch.rows["none-labels"] == 0
