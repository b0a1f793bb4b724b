"""Quality rules, chat formatting, mixing: built-in functions only."""

import json
import random
import re
from collections import Counter

import pytest
from cases import documents
from pyspark.sql import functions as F

from maskflow.llm import op4_quality as op4
from maskflow.llm import op5_chat as op5
from maskflow.llm import op8_mixing as op8

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# --- quality ---------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    repeated = len(lines) - len(set(lines))
    names = set(op4.STOP_WORDS) | {w.capitalize() for w in op4.STOP_WORDS}
    stop = sum(w in names for w in words)
    base_failed = n < 50 or 100 * len(covered) > 50 * n
    good = 200 * n <= 100 * chars <= 1600 * n and 100 * symbols <= 25 * n and 100 * stop >= 5 * n and 100 * repeated <= 50 * len(lines)
    return n, chars, symbols, repeated, len(covered), base_failed, not base_failed and good


def test_quality_equals_plain_loops(spark):
    docs = documents(spark)
    got = op4.judge(docs)
    assert native(got)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = [(r.doc_id, *(r[c] for c in columns)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(((r.doc_id, *brute_quality(r.text)) for r in docs.collect()), key=str)
    assert op4.judge(docs.limit(0)).collect() == []


def test_rules_name_what_failed(spark):
    docs = spark.createDataFrame([(1, "### $$$ " * 30)], "doc_id long, text string")
    row = op4.judge(docs).first()
    assert not row.kept and {"few_symbols", "stop_words", "few_repeated_windows"} <= set(row.failed_rules)


def test_other_thresholds(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert op4.judge(docs, (op4.Rule("three", "n_words", 300, "1", True),), (op4.Rule("short", "word_chars", 100, "n_words"),)).first().kept


def test_junk_with_some_stop_words_is_not_kept(spark):
    junk = " ".join(f"xq{k}zt" for k in range(400)) + " the of and"
    prose = " ".join(f"xq{k}zt The" if k % 15 == 0 else f"xq{k}zt" for k in range(400))
    docs = spark.createDataFrame([(1, junk), (2, prose)], "doc_id long, text string")
    assert {r.doc_id: (r.kept, r.failed_rules) for r in op4.judge(docs).collect()} == {1: (False, ["stop_words"]), 2: (True, [])}


def test_kept_columns_never_clash(spark):
    docs = documents(spark)
    assert op4.judge(docs, keep=["doc_id", "lang", "part"]).columns[:3] == ["doc_id", "lang", "part"]
    with pytest.raises(ValueError, match="n_words"):
        op4.judge(docs, keep=["doc_id", "n_words"])


@pytest.mark.parametrize("module", [op4, op5, op8])
def test_sql_gives_the_same(spark, module):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in module.ORACLE.items():
        got = module.QUERIES[name](spark, sf)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# --- chat ------------------------------------------------------------------------------------------------------


def test_chat_links_orders_and_serialises(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", 'hi "you"\n'), (1, 2, "assistant", "ho/é"), (1, 3, "user", "more"), (1, 4, "assistant", None), (1, 5, "user", "last")]
    rows += [(2, 0, "user", ""), (2, 1, "assistant", "x"), (3, 1, "assistant", "who asked"), (4, 0, "user", None), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (5, 1, "assistant", "re")]
    rows += [(None, 1, "user", "no conversation"), (6, None, "user", "no turn"), (7, 0, None, "no role"), (7, 1, "narrator", "odd role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("old")).withColumn("call_id", F.lit("old"))
    out = op5.format_turns(df)
    assert native(out) and out.count() == len(rows)
    by = {(r.conv_id, r.turn): r for r in out.collect()}
    assert [by[1, t].depth for t in (1, 3, 5)] == [0, 1, 2]
    assert {k: by[k].status for k in [(1, 0), (1, 1), (1, 2), (1, 5), (2, 0), (3, 1), (4, 0), (5, 0), (5, 1), (None, 1), (6, None), (7, 1)]} == {
        (1, 0): "message", (1, 1): "linked", (1, 2): "linked", (1, 5): "pending", (2, 0): "invalid least:prompt", (3, 1): "orphan", (4, 0): "invalid missing:prompt",
        (5, 0): "duplicate_call", (5, 1): "linked", (None, 1): "message", (6, None): "message", (7, 1): "message",
    }
    for r in by.values():
        value = json.loads(r.message)
        assert json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    assert json.loads(by[1, 3].message)["depends_on"] == "1:1"
    assert op5.format_turns(df.limit(0)).collect() == []


def test_depths_of_chains_graphs_and_cycles(spark):
    rng = random.Random(6)
    rows = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(100)]
    rows += [(f"t{k}", f"t{(k - 1) // 3}" if k else None) for k in range(40)]
    rows += [("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), ("stray", "nobody"), ("known", "nobody"), ("known", "c4")]
    rows += [(f"g{k}", f"g{j}") for k in range(1, 60) for j in sorted(rng.sample(range(k), min(k, rng.randint(1, 3))))] + [("g0", None)]
    rows += [("late", "c99"), ("late", "t39"), ("after", "late"), ("after", "late"), ("both", "x"), ("both", "c1")]
    parents = {}
    for c, p in rows:
        parents.setdefault(c, set()).add(p)
    for c in parents:
        parents[c] = {p for p in parents[c] if p in parents}
    depth, moved = {}, True
    while moved:
        more = {c: max((depth[p] + 1 for p in ps), default=0) for c, ps in parents.items() if c not in depth and ps <= depth.keys()}
        moved = bool(more)
        depth |= more
    calls = spark.createDataFrame([(c,) for c in parents], "call_id string")
    edges = spark.createDataFrame(rows, "call_id string, parent_id string")
    got = op5.depths(calls, edges)
    assert native(got) and dict(got.dtypes)["depth"] == "bigint"
    assert {r.call_id: r.depth for r in got.collect()} == {c: depth.get(c) for c in parents}
    linked = {r.call_id: r for r in op5.link(edges, calls.limit(0)).collect()}
    assert linked["after"].n_calls == 2 and linked["late"].n_calls == 1 and linked["late"].depth == 100


def test_long_texts_are_formatted_whole(spark):
    text = "long \"text\" " * 40_000
    out = op5.format_turns(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r.status for r in out] == ["linked", "linked"]
    assert json.loads(out[0].message)["arguments"]["prompt"] == text and json.loads(out[1].message)["content"] == text


def test_arguments_are_checked(spark):
    schema = (op5.Argument("city", "string", least=2, most=5), op5.Argument("days", "integer", required=False, least=1, most=9), op5.Argument("ratio", "number", required=False), op5.Argument("on", "boolean", required=False), op5.Argument("tags", "array", required=False), op5.Argument("at", "object", required=False))
    cases = {
        '{"city": "Rome"}': "", '{"city": "R"}': "least:city", '{"city": "Rome and more"}': "most:city", "{}": "missing:city", '{"city": null}': "missing:city", '{"city": 3}': "type:city",
        '{"city": "Rome", "days": 10}': "most:days", '{"city": "Rome", "days": 0}': "least:days", '{"city": "Rome", "days": 2.5}': "type:days", '{"city": "Rome", "days": 3, "ratio": 0.5, "on": true, "tags": [1], "at": {"x": 1}}': "",
        '{"city": "Rome", "zip": 1, "area": 2}': "unknown:area+zip", '{"city": "Rome", "city": "Oslo"}': "json", "[1]": "json", "no": "json", '{"city": "Rome", "on": "yes"}': "type:on",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.f for r in df.select("a", F.array_join(op5.faults(F.col("a"), schema), ",").alias("f")).collect()}
    assert got == cases


def test_canonical_json(spark):
    df = spark.createDataFrame([('{ "b" : [1, 2.50, "x\\u0041"], "a": {"d": null, "c": true}}',), ("{bad",)], "a string")
    assert [r[0] for r in df.select(op5.canonical(F.col("a"))).collect()] == ['{"a":{"c":true,"d":null},"b":[1,2.5,"xA"]}', None]


# --- mixing ----------------------------------------------------------------------------------------------------


def fill(children, budget):
    """Water level by repeated rounds: {name: (supply, weight)} -> {name: budget}."""
    out, left, rest = {}, budget, dict(children)
    while rest:
        total = sum(w for _, w in rest.values())
        full = {k for k, (s, w) in rest.items() if s * total <= left * w}
        if not full:
            return out | {k: left * w // total for k, (s, w) in rest.items()}
        for k in full:
            out[k] = rest[k][0]
        left -= sum(rest.pop(k)[0] for k in full)
    return out


def brute_budgets(supply, mix):
    def weight(level, name):
        return mix.weights.get(level, {}).get(name, 1)

    def down(rows, budget, levels):
        if not levels:
            return {(): budget}
        names = {k[0] for k in rows}
        children = {n: (mix.epochs * sum(v for k, v in rows.items() if k[0] == n), weight(levels[0], n)) for n in names}
        shares = fill(children, budget)
        return {(n, *k): v for n in names for k, v in down({k[1:]: v for k, v in rows.items() if k[0] == n}, shares[n], levels[1:]).items()}

    return down(supply, sum(supply.values()) * mix.percent // 100, list(op8.LEVELS))


@pytest.mark.parametrize(("percent", "epochs"), [(30, 1), (90, 1), (150, 3), (300, 2), (0, 1)])
def test_budgets_flow_to_siblings_first(spark, percent, epochs):
    supply = {("d0", "en", "a"): 100, ("d0", "en", "b"): 7, ("d0", "de", "c"): 3, ("d1", "fr", "d"): 1000, ("d1", "en", "e"): 0, ("d2", "xx", "f"): 12, ("d2", "en", "a"): 450}
    mix = op8.Mix(weights={"domain": {"d0": 5, "d1": 3}, "lang": {"en": 4, "de": 2}, "source": {"b": 3}}, percent=percent, epochs=epochs)
    df = spark.createDataFrame([(*k, v) for k, v in supply.items()], "_domain string, _lang string, _source string, tokens long")
    got = {(r._domain, r._lang, r._source): r.budget for r in op8.budgets(df, mix).collect()}
    assert got == brute_budgets(supply, mix)


def test_weight_zero_leaves_a_node_out(spark):
    supply = {("d0", "en", "a"): 100, ("d0", "de", "c"): 300, ("d1", "de", "d"): 1000, ("d1", "fr", "e"): 50}
    mix = op8.Mix(weights={"domain": {"d0": 5}, "lang": {"de": 0}}, percent=8, epochs=1)
    df = spark.createDataFrame([(*k, v) for k, v in supply.items()], "_domain string, _lang string, _source string, tokens long")
    assert {(r._domain, r._lang, r._source): r.budget for r in op8.budgets(df, mix).collect()} == {("d0", "en", "a"): 96, ("d0", "de", "c"): 0, ("d1", "de", "d"): 0, ("d1", "fr", "e"): 19}
    docs = documents(spark)
    taken = op8.mix_documents(docs, op8.Mix(weights={"lang": {"de": 0, "en": 2}}, percent=100, epochs=2))
    assert taken.where("_lang = 'de'").isEmpty() and not taken.where("_lang = 'en'").isEmpty()
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("docs", docs.select("doc_id", "text", "lang", "source").toArrow())
    query = f"WITH {op8.mixing_sql(op8.Mix(weights={'lang': {'de': 0, 'en': 2}}, percent=100, epochs=2), 'docs', '$$all$$')} SELECT doc_id, lang, source, epoch FROM taken WHERE doc_id IS NOT NULL"
    same = op8.mix_documents(docs, op8.Mix(weights={"lang": {"de": 0, "en": 2}}, percent=100, epochs=2, domain="'all'"))
    have = [(r.doc_id, r._lang, r._source, r._epoch) for r in same.select("_row.doc_id", "_lang", "_source", "_epoch").where("doc_id is not null").collect()]
    assert sorted(con.execute(query).fetchall(), key=str) == sorted(have, key=str)
    for bad in ({"weights": {"lang": {"de": -1}}}, {"percent": -1}, {"epochs": -1}):
        with pytest.raises(ValueError, match="negative"):
            op8.Mix(**bad)


def test_last_range_of_each_leaf(spark):
    rng = random.Random(3)
    rows = {(leaf, f"{k:03x}"): rng.choice([0, 1, 50]) for leaf in range(40) for k in sorted(rng.sample(range(4096), rng.choice([1, 5, 300])))}
    total = Counter()
    for (leaf, _), n in rows.items():
        total[leaf] += n
    rest = {leaf: rng.choice([1, max(1, n // 2), max(1, n), n + 1]) for leaf, n in total.items()}
    want, upto = {}, Counter()
    for (leaf, at), n in sorted(rows.items()):
        if upto[leaf] < rest[leaf] <= upto[leaf] + n:
            want[leaf] = (at, upto[leaf])
        upto[leaf] += n
    df = spark.createDataFrame([(str(leaf), rest[leaf], at, n) for (leaf, at), n in rows.items()], "leaf string, rest long, range string, n long")
    got = op8.last_ranges(df, ["leaf"]).collect()
    assert {int(r.leaf): (r.range, r.before) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("mix", [op8.Mix(), op8.Mix(percent=80, epochs=1), op8.Mix(percent=170, epochs=3, seed=1)])
def test_prefix_of_each_leaf(spark, mix):
    docs = documents(spark)
    taken = op8.mix_documents(docs, mix)
    assert native(taken) and taken.select("_row.*").columns == docs.columns
    rows = taken.select("_row.doc_id", "_row.text", "_domain", "_lang", "_source", "_epoch", "_n", "_taken").collect()
    leaf = op8.mix_documents(docs, op8.Mix(mix.weights, 100, 1, mix.seed)).select("_row.doc_id", "_row.text", "_domain", "_lang", "_source", "_n").collect()
    supply = Counter()
    for r in leaf:
        supply[r._domain, r._lang, r._source] += r._n
    assert sum(supply.values()) == sum(len(WORDS.findall(r.text or "")) for r in docs.collect())
    want = brute_budgets(dict(supply), mix)
    got = Counter()
    for r in rows:
        got[r._domain, r._lang, r._source] += r._taken
        assert 0 <= r._taken <= r._n and r._epoch < mix.epochs
    for k, b in want.items():
        most = max((r._n for r in leaf if (r._domain, r._lang, r._source) == k), default=0)
        assert b <= got[k] <= b + most or got[k] == b, k  # above it only where repeated rows are taken together
    again = op8.mix_documents(docs.repartition(7), mix).select("_row.doc_id", "_epoch", "_taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, ((r.doc_id, r._epoch, r._taken) for r in rows))) or sorted(tuple(r) for r in again if r[0] is not None) == sorted((r.doc_id, r._epoch, r._taken) for r in rows if r.doc_id is not None)
    assert op8.mix_documents(docs.limit(0), mix).collect() == []
