"""The registered queries and the pipeline against brute force, on a folder of
tables with nulls, repeated ids and texts, empty and long texts, and ties."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import fingerprints, mixing, ngram_join, queries, repeats, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(900)]
RUDE = ["vilescum", "hatefool", "idiotrat"]
ITEMS = [" ".join(f"q{i}x{k}" for k in range(12)) for i in range(6)] + ["a b c"]


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def edited(text, n):
    w = text.split(" ")
    for k in RNG.sample(range(len(w)), n):
        w[k] = f"e{RNG.randrange(10**6)}"
    return " ".join(w)


def documents():
    out = []
    for i in range(90):
        out.append(prose(RNG.randint(20, 120)))
    for i in range(20):
        out.append(edited(out[i], 1))
    base = prose(200)
    out += [base] + [edited(base, RNG.randint(1, 12)) for _ in range(40)]
    for i in range(30):
        out.append(f"{prose(20)} {RNG.choice(RUDE)} {RNG.choice(RUDE)} {prose(5)}")
    for i in range(6):
        w = ITEMS[i].split()
        out.append(f"{prose(10)} {' '.join(w[6:])}\n{prose(3)} {' '.join(w[:6])}")
        out.append(f"{prose(10)} {' '.join(w[:5])} {prose(4)}")
    out += [out[4], out[4], "", "  \n", "two words", "é ü\tñ " * 9, prose(6000)]
    return [(k, t, f"s{k % 4}" if k % 9 else None) for k, t in enumerate(out)]


GIVEN = documents()
TOXIC = {k: int(any(x in t for x in RUDE)) for k, t, _ in GIVEN}
MORE = [(None, "null id", "s1"), (1000, None, "s1")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in [*GIVEN, MORE[1]]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in TOXIC.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


ALL = [*GIVEN, MORE[1]]


def run(spark, folder, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, folder).collect()}


def components(nodes, links):
    part = {i: i for i in nodes}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        part[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def shingles(text, n):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, links)


def tiled(item, text, least=4):
    """Coverage of an item by greedy string tiling, as it is defined."""
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())
    a, b = split(item), split(text or "")
    used_a, used_b, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered / len(a)
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        covered += n


def test_op1(spark, folder):
    got = run(spark, folder, "op1_sharding")
    size = {k: len((t or "").encode()) + 1 for k, t, _ in ALL}
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for k, t, _ in ALL:
        r = got[k]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (size[k], None if t is None else zlib.crc32(t.encode()), "bytes", None)
        load[r.shard] += size[k]
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(8))
    assert all(len(s) == 1 for s in where.values())
    fair = sum(size.values()) / 8
    light = [s for s in range(8) if s not in where[max((t for _, t, _ in GIVEN), key=len)]]
    assert all(load[s] <= fair + 5000 for s in light)


def test_op2_on_held_out_rows(spark, folder):
    got = run(spark, folder, "op2_toxicity")
    assert set(got) == {k for k, *_ in ALL}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [k for k in TOXIC if got[k].held_out]
    pairs = [(got[a].score > got[b].score) + 0.5 * (got[a].score == got[b].score) for a in held if TOXIC[a] for b in held if not TOXIC[b]]
    assert pairs and sum(pairs) / len(pairs) >= 0.95
    assert not any(got[k].predicted for k in held if not TOXIC[k])
    alone = toxicity.train(spark, spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(spark.createDataFrame([(None,), ("x",)], "text string"), alone).agg(F.max("score")).first()[0] == 0.5


def test_op3(spark, folder):
    got, first = run(spark, folder, "op3_substring_dedup"), {}
    for k, t, _ in ALL:
        w, gone = WORDS.findall(t or ""), set()
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), k) < k:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert tuple(got[k]) == (k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    again = spark.createDataFrame([(1, ITEMS[0] + " z"), (1, ITEMS[0] + " z"), (None, ITEMS[0] + " z"), (None, None), (9007199254740993, "")], "doc_id long, text string")
    rows = repeats.remove_repeats(spark, again, block_bytes=1, bucket_bytes=64).collect()
    assert Counter((r.doc_id, r.n_removed) for r in rows) == Counter([(1, 0), (1, 13), (None, 13), (None, 0), (9007199254740993, 0)])


def targets(sizes):
    """Water-filling by source, in plain steps."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        got = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if got[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return got
        full |= over


def test_op5(spark, folder):
    got, sizes, taken = run(spark, folder, "op5_mixing"), Counter(), Counter()
    n = {k: len(WORDS.findall(t or "")) for k, t, _ in ALL}
    for k, _, s in ALL:
        sizes[s] += n[k]
    want = targets(sizes)
    for k, _, s in ALL:
        r = got[k]
        assert r["size"] == n[k] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-3 and r.taken <= 3 * n[k]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(v for k, v in n.items() if ALL[k if k < 1000 else -1][2] == s) for s in want)
    assert {k: r.taken for k, r in run(spark, folder, "op5_mixing").items()} == {k: r.taken for k, r in got.items()}


def test_op7(spark, folder):
    sets, part = near([(k, t) for k, t, _ in ALL], 3, 90)
    got = run(spark, folder, "op7_ngram_join")
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), part[k]) for k in sets}
    # small blocks: crowded shingles meet their centre, families are cut
    docs = spark.createDataFrame([(k, t) for k, t, _ in [*ALL, MORE[0], (None, GIVEN[5][1], "")]], "doc_id long, text string")
    for percent, options in ((90, dict(block=6, family_block=4)), (80, dict(block=9, family_block=1000, family_bytes=4000, broadcast_rows=0, broadcast_bytes=0))):
        sets, part = near([(k, t) for k, t, _ in ALL], 3, percent)
        rows = ngram_join.similar(spark, docs, n=3, percent=percent, **options).collect()
        assert {r.doc_id: r.component_id for r in rows} == {**part, None: None} and len(rows) == len(ALL) + 2


def test_op8(spark, folder):
    want = {}
    for k, t, _ in ALL:
        found = [(tiled(x, t), -i) for i, x in enumerate(ITEMS[:6])] if t and "q" in t else []
        if found and max(found)[0] >= 0.5:
            want[k] = (-max(found)[1], max(found)[0], sum(c >= 0.5 for c, _ in found))
    got = {k: (r.item_id, r.coverage, r["items"]) for k, r in run(spark, folder, "op8_decontamination").items()}
    assert len(want) == 6 and got == want


def phrases(text):
    known, start = set(), 0
    ends = []
    for j in range(1, len(text) + 1):
        if text[start:j] not in known:
            known.add(text[start:j])
            ends.append(j)
            start = j
    return fingerprints.sketch(text, ends)


def test_op10(spark, folder):
    got = run(spark, folder, "op10_fingerprints")
    rows = sorted((k, t or "") for k, t, _ in ALL)
    for at, (k, t) in enumerate(rows):
        q, after = len(t) // 4, rows[(at + 1) % len(rows)][1]
        new = t[: len(t) - q] + after[:q]
        own, other = phrases(t), phrases(new)
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.written(own), fingerprints.written(other))
        assert r.near_edited == fingerprints.likeness(own, other) and r.near_next == fingerprints.likeness(own, phrases(after))


def test_pipeline(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    score = run(spark, folder, "op2_toxicity")
    clean = {k: t for k, t, _ in ALL if score[k].score < 0.7}
    _, part = near(clean.items(), 5, 80)
    left = [k for k in clean if part[k] == k]
    left = [k for k in left if not any("q" in (clean[k] or "") and tiled(x, clean[k]) >= 0.5 for x in ITEMS[:6])]
    source = {k: s for k, _, s in ALL}
    docs = spark.createDataFrame([(k, clean[k], source[k]) for k in left], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(spark, docs).collect()}
    assert Counter(r.doc_id for r in rows) == Counter({k: n for k, n in copies.items() if n})
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r["size"] == len((r.text or "").encode()) + 1 and r.text == clean[r.doc_id] for r in rows)


def test_pipeline_stages_on_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0).withColumn("score", F.lit("x")).withColumn("copies", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "sharding" or out.columns == none.columns)
