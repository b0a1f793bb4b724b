"""N-gram Jaccard join and connected components."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import documents

from pyspark.sql import functions as F

from maskflow.llm import op3_ngram_jaccard as op3
from maskflow.llm.common import hash_words, materialize
from maskflow.llm.components import components, with_least

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, percent=90, n=3):
    """(doc_id, number of shingles, smallest linked doc_id) of each row."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for other in by[x]:
                shared[other] += 1
        for other, both in shared.items():
            if other < k and 100 * both >= percent * (len(s) + len(sets[other][1]) - both):
                up[find(k)] = find(other)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            r = find(k)
            least[r] = i if least[r] is None else min(least[r], i)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed, bases=6, each=14):
    """Bases of many sizes with copies that drift, a passage that many texts share, and exact copies."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(50)]
    rows = []
    for b in range(bases):
        size = rng.choice([4, 9, 11, 12, 20, 40, 75, 150, 400])
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for c in range(each):
            rows.append(edited(rng, words, rng.randint(0, max(1, size // 25))))
            if c % 4 == 0:
                words = edited(rng, words, 1).split()
    rows += [" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(3, 200)))]) for _ in range(30)]
    rows += [rows[3]] * 5 + ["one", "one two", "One TWO", ""]
    return [(k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("chunk", [4096, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, chunk):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op3.ngram_jaccard(docs, chunk=chunk).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_five_words_and_other_threshold(spark):
    rows = families(3, bases=4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op3.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect()]
    assert sorted(got, key=str) == brute(rows, 80, 5)


def test_cases(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = op3.ngram_jaccard(docs)
    known = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is not None]
    assert sorted(known, key=str) == [x for x in brute(rows) if x[0] is not None]
    assert got.where("doc_id is null").count() == 2
    kept = op3.one_of_each(docs, got)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and ids.count(10) == 1 and ids.count(11) == 0 and ids.count(None) == 2
    assert kept.select("node").distinct().first()[0] == "old node"


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (5, "other text of the same id"), (6, "a b c d e")], "doc_id long, text string")
    kept = op3.one_of_each(docs, op3.ngram_jaccard(docs))
    assert sorted(r.text for r in kept.collect()) == ["a b c d e", "other text of the same id"]


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = b + " end"
    rows = [(5, a), (9, a), (5, b), (3, b), (7, c), (7, c), (None, c), (None, "no id at all"), (None, "no id at all"), (2, b + " end of it"), (2, near), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text[:2]) for r in op3.one_of_each(docs, op3.ngram_jaccard(docs)).collect()), key=str)
    assert kept == sorted([(5, "a0"), (2, "b0"), (7, "c0"), (None, "no"), (None, " ")], key=str)


def test_rows_without_id_carry_links(spark):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join([*words[a:], *(f"e{k}" for k in range(a))]) for a in (0, 4, 8)]  # the ends are linked by the middle only
    docs = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2])], "doc_id long, text string")
    assert len({c for _, _, c in brute([(1, texts[0]), (3, texts[2])])}) == 2
    got = op3.ngram_jaccard(docs)
    assert sorted((r.doc_id, r.component_id) for r in got.collect() if r.doc_id) == [(1, 1), (3, 1)]
    assert [r.component_id for r in got.where("doc_id is null").collect()] == [1, 1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op3.ngram_jaccard(docs).collect() == []
    assert op3.one_of_each(docs, op3.ngram_jaccard(docs)).collect() == []


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_signatures_meet(percent):
    """Linked sets have a signature in common, however weak their segments."""
    rule, rng = op3.Threshold(percent), np.random.default_rng(0)
    for _ in range(400):
        size = int(rng.integers(1, 200))
        a = rng.integers(0, 2**63, size, dtype=np.uint64) >> np.uint64(int(rng.integers(0, 50)))
        a = np.unique(a)
        b = a[rng.random(len(a)) > 0.05]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        if len(b) and rule.linked(len(np.intersect1d(a, b)), len(a), len(b)) and len(a) != len(np.intersect1d(a, b)):
            flat, off = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            sign, row = op3.signatures(flat, off, rule)
            assert set(sign[row == 0]) & set(sign[row == 1])


def test_t_occurrence_search_equals_scan():
    rng = np.random.default_rng(4)
    rule = op3.Threshold(60)
    base = rng.integers(0, 2**60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(5, 50)), replace=False), rng.integers(0, 2**60, int(rng.integers(0, 12)), dtype=np.uint64)])) for _ in range(120)]
    index = op3.InvertedLists(sets, list(range(len(sets))))
    for k, s in enumerate(sets):
        want = {j for j, o in enumerate(sets) if rule.linked(len(np.intersect1d(s, o)), len(s), len(o))}
        assert set(index.search(s, rule, lambda i: False)) == want, k


def thue_morse(a, b, k=11):
    """Two different words that a polynomial modulo a power of two can't tell apart."""
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse("a", "b")
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    at = np.arange(4) * len(a)
    h = hash_words(data, at[:-1], at[1:])
    assert h[0] == h[2] != h[1]
    short = [thue_morse("a", "b", k) for k in (1, 2, 3, 4, 5, 6)]
    words = [w for pair in short for w in pair] + ["a", "a\0", "a\0\0", "\0", ""]
    ends = np.cumsum([len(w) for w in words])
    assert len(set(hash_words(np.frombuffer("".join(words).encode(), np.uint8), ends - [len(w) for w in words], ends).tolist())) == len(words)
    docs = spark.createDataFrame([(1, f"one {a} two"), (2, f"one {b} two"), (3, f"one {a} two")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in op3.ngram_jaccard(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(1)
    for percent in (90, 80, 50):
        rule, sets = op3.Threshold(percent), []
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 700)), dtype=np.uint64))
            sets.append(a)
            for _ in range(3):
                sets.append(np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 9)), dtype=np.uint64)])))
        sets = [x for x in sets if len(x)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        words, begin = op3.sketches(np.concatenate(sets), off)
        a, b = np.triu_indices(len(sets), 1)
        near = set(zip(*(x.tolist() for x in op3.alike(np.diff(off), words, begin, a, b, rule)), strict=True))
        linked = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if rule.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        assert linked and linked <= near
        assert len(near) < len(a) / 2 or percent == 50


@pytest.mark.parametrize(("group", "hot"), [(2, (64, 512)), (4096, (1, 3))])
def test_large_groups_and_hot_signatures_lose_no_link(spark, group, hot):
    rows = families(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op3.ngram_jaccard(docs, group=group, hot=hot).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_hot_signatures_are_found_and_kept_out_of_the_exchange(spark):
    """Half of all rows share most of their signatures: none of these is dealt by its key."""
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words, f"end{k}"])) for k in range(200)] + [(1000 + k, " ".join(f"r{k}x{j}" for j in range(60))) for k in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rule = op3.Threshold(90)
    hot = op3._hot_signatures(texts, 3, rule, 1, 100)
    assert len(hot)
    cold = op3._signed(texts, 3, rule, hot).groupBy("sig").count().agg({"count": "max"}).first()[0]
    assert cold < 100
    assert op3._signed(texts, 3, rule, hot, wanted=True).select("sig").distinct().count() == len(hot)


def test_edges_of_one_node_are_dealt_to_many_tasks(spark):
    edges = spark.range(20_000).select(F.lit(-1).cast("long").alias("u"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        least = edges.groupBy("u").agg(F.min("v").alias("low"))
        sizes = [r["count"] for r in with_least(edges, least).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
    assert sum(sizes) == 20_000 and len(sizes) >= 8 and max(sizes) < 8_000


def test_rows_of_one_node_are_split(spark):
    """The shape of the join that gives each row its component: an aggregate that is written, and plain exchanges."""
    rows = spark.range(60_000).select(F.lit(5).cast("long").alias("node"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    least = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("component_id")), "test-least")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        some = materialize(rows.repartition(8), "test-rows")
        joined = materialize(some.join(least, "node", "left").select("doc_id", "component_id", "more", F.spark_partition_id().alias("p")), "test-joined")
        sizes = [r["count"] for r in joined.groupBy("p").count().collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(sizes) == 60_000 and len(sizes) >= 4


def test_chunks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(op3, "CHUNK_BYTES", 20_000)
    rows = families(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op3.ngram_jaccard(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    got = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {(r.node, r.label) for r in got.collect()} == {(x, find(x)) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
