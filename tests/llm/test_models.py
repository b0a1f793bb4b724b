"""Toxicity, language identification, nearest neighbours, sampling."""

import random
import re
import zlib

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F

from maskflow.llm import op7_toxicity as op7
from maskflow.llm import op9_ann as op9
from maskflow.llm import op10_language as op10
from maskflow.llm.sampling import bounded, by_class, fold

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "embeddings")}


def test_fold_is_crc32(spark):
    got = spark.range(200).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert spark.createDataFrame([(None,)], "id long").select(fold("id", 5)).first()[0] is None


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"))
    got = {r.k: r["count"] for r in by_class(rows, "k", 300, 5).groupBy("k").count().collect()}
    assert set(got) == {"a", "b"} and all(200 < n < 400 for n in got.values())
    assert by_class(rows, "k", 300, 1).select("k").distinct().count() == 1
    assert by_class(rows.limit(0), "k", 300, 5).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    x = rng.random((500, 30)) * (rng.random((500, 30)) < 0.2)
    x[:, 29] += 0.1
    x[200:230] = x[200]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = op7.BlockMaxIndex.of(x)
    for k in range(0, 500, 7):
        query = {int(t): float(x[k, t]) for t in np.flatnonzero(x[k])}
        near = index.nearest(query, 15, without=k)
        score = (x @ x[k]).round(12)
        score[k] = -1
        best = np.lexsort((np.arange(500), -score))[:15]
        assert [i for _, i in near] == best.tolist()
        assert np.allclose([s for s, _ in near], score[best])


def test_toxicity_on_held_out_labels(spark, tables):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")
    model = op7.fit(docs, labels.where(fold("doc_id", 5) != 0))
    got = op7.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(fold("doc_id", 5) == 0).toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = np.mean(bad[:, None] > good) + 0.5 * np.mean(bad[:, None] == good)
    assert auc > 0.95 and (good >= 0.5).mean() < 0.02
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_no_term_that_passes_is_left_out():
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(500)]
    toxic = [f" {w} " for w in words for _ in range(6)]
    terms = op7.choose_terms([*toxic, *[" fine "] * 9000], np.array([1] * len(toxic) + [0] * 9000))
    assert set(terms) == {f" {w} " for w in words}


def test_scores_use_the_text_only(tables):
    docs, labels = tables["documents"], tables["labels"]
    model = op7.fit(docs, labels)
    some = docs.limit(50)
    shifted = some.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    assert sorted(r.score for r in op7.score(some, model).collect()) == sorted(r.score for r in op7.score(shifted, model).collect())


def test_toxicity_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(20, 60)] + [(20, 0), (None, 1)], "doc_id long, toxic int")
    model = op7.fit(docs, labels)
    got = op7.score(docs, model, keep=True, prefix="_t_")
    assert got.columns == [*docs.columns, "_t_score", "_t_predicted", "_t_evidence"] and got.count() == docs.count()
    by = {r.doc_id: r._t_score for r in got.collect()}
    share = 13 / 41  # of toxic rows among the labels with an id
    assert by[4] == by[5] == by[6] == by[12] == pytest.approx(share)
    assert all(r._t_evidence == [] and r._t_predicted == 0 for r in got.where("doc_id in (4, 5, 6, 12)").collect())
    for nothing in (labels.limit(0), labels.where("toxic = 1")):
        assert op7.fit(docs, nothing) is None
    assert {r.score for r in op7.score(docs, None).collect()} == {0.0}
    assert op7.score(docs.limit(0), model).collect() == []


def test_empty_texts_score_the_base_rate(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    model = op7.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "12 34 !!")], "doc_id long, text string")
    got = op7.score(odd, model).collect()
    base = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    assert 0 < base < 0.5 and {(round(r.score, 9), r.predicted, tuple(r.evidence)) for r in got} == {(round(base, 9), 0, ())}


def test_scores_equal_brute_force(tables):
    """Counts, idf, cosine, votes and curve in plain loops over the same terms."""
    docs, labels = tables["documents"], tables["labels"]
    model = op7.fit(docs, labels)
    texts = {r.doc_id: op7.plain(r.text) for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.collect()}
    holds = [sum(t in text for text in texts.values()) for t in model.terms]
    assert np.allclose(model.weight[:-1], np.log((1 + len(texts)) / (1 + np.array(holds))))

    def vector(text):
        words = text.split()
        x = [sum(f" {w} ".startswith(t) for w in words) / len(words) * k for t, k in zip(model.terms, model.weight, strict=False)]
        x = np.array([*x, model.weight[-1]])
        return x / np.linalg.norm(x)

    examples = np.array([vector(texts[i]) for i in model.doc_ids])
    got = {r.doc_id: (r.score, r.evidence) for r in op7.score(docs, model).collect()}
    for i in sorted(texts)[:60]:
        if not texts[i].strip():
            continue
        cosine = (examples @ vector(texts[i])).round(12)
        near = np.argsort(-cosine, kind="stable")[: op7.K]
        w = 1 / (0.02 + np.maximum(0, 1 - cosine[near]))
        vote = (w * [label[model.doc_ids[j]] for j in near]).sum() / w.sum()
        score = 1 / (1 + np.exp(-(model.curve[0] * vote + model.curve[1])))
        assert got[i][0] == pytest.approx(score, abs=1e-6), i


def test_samples_are_bounded_whatever_repeats(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    others = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("b").alias("lang"), F.lit("other").alias("text"))
    both = rows.union(others)
    got = by_class(both.select("doc_id", "lang"), "lang", 100, 4)
    assert got.where("lang = 'a'").count() == 1 and 50 <= got.where("lang = 'b'").count() <= 200
    assert by_class(both, "lang", 100, 4, "text").count() <= 400
    narrow = bounded(both.withColumn("_at", F.xxhash64("doc_id", "text")), "_at", 10_000, "text", 1_000)
    assert 50 <= narrow.count() <= 200 and narrow.agg(F.sum(F.octet_length("text"))).first()[0] <= 1_000
    model = op7.fit(both.select("doc_id", "text"), both.select("doc_id", F.when(F.col("lang") == "a", 1).otherwise(0).alias("toxic")))
    assert model is None or len(model.doc_ids) <= 2 * sum(op7.PER_CLASS)


# --- languages -------------------------------------------------------------------------------------------------


def test_language_on_held_out_texts(tables):
    docs = tables["documents"]
    model = op10.fit(docs.where(fold("doc_id", 3) != 1), per_language=100)
    got = op10.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 3) == 1).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and not got.rejected.any()
    assert got.score.between(0, 1).all()


def test_language_features_equal_plain_loops():
    texts = ["Ab  c1d\nÉ", "", "12", "x\n\ny", "é" * 5]
    counts, letters = op10.features(texts)
    assert letters.tolist() == [5, 0, 0, 2, 5]
    for t, c in zip(texts, counts, strict=True):
        joined, _ = op10.features([t])
        assert (joined[0] == c).all()
    again, _ = op10.features(["ab c d é"])
    assert (again[0] == counts[0]).all()


def test_verdict_and_rejection_equal_brute_force(tables):
    docs = tables["documents"]
    model = op10.fit(docs, per_language=60)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    some = {i: c for i, t in texts.items() if len(c := set(grams(t)))}
    places = {g: int(np.flatnonzero(place_of(g))[0]) for g in ("e", "th", "the", " th")}
    df = {g: sum(any(places[g] == p for p in map(hashed, c)) for c in some.values()) for g in ("the",)}
    assert model.idf[places["the"]] == pytest.approx(np.log((1 + len(some)) / (1 + df["the"])) + 0.1)
    for r in op10.predict(docs.limit(80), model).collect():
        counts = np.zeros(op10.DIM)
        for g in grams(texts[r.doc_id]):
            counts[hashed(g)] += 1
        x = np.log1p(counts) * model.idf
        if not counts.any():
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        cosine = [float(x @ c / np.linalg.norm(x) / np.linalg.norm(c)) for c in model.centroids]
        letters = sum(map(str.isalpha, texts[r.doc_id].lower()))
        at = [np.log(k) for k, _ in model.bounds]
        bound = np.interp(np.log(letters), at, [b for _, b in model.bounds])
        assert r.score == pytest.approx(max(cosine), abs=1e-4)
        assert r.lang_pred == model.languages[int(np.argmax(cosine))] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-5
        assert r.rejected == (r.score < bound)


def grams(text):
    """Runs of other characters are one space; n-grams of one to three characters, single spaces left out."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    line = re.sub(" +", " ", line)
    return [line[k : k + n] for n in (1, 2, 3) for k in range(len(line) - n + 1) if line[k : k + n] != " "] if line.strip() else []


def hashed(gram):
    h = 0
    for n, c in enumerate(gram):
        h = (h * 0x100000001B3 + ord(c) + n + 1) % 2**64 if n else ord(c) + 1
    return (h * 0x9E3779B97F4A7C15) % 2**64 >> 52


def place_of(gram):
    x = np.zeros(op10.DIM)
    x[hashed(gram)] = 1
    return x


def test_language_cases(spark):
    docs = documents(spark)
    model = op10.fit(docs)
    got = {r.doc_id: r for r in op10.predict(docs, model).collect()}
    for k in (4, 5, 6, 12):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[9].lang_pred in {"en", "de", "fr", "es"}
    kept = op10.predict(docs, model, keep=True, prefix="_l_")
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == docs.count()
    assert op10.fit(docs.limit(0)) is None and op10.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in op10.predict(docs, None).collect()} == {"und"}
    assert op10.predict(docs.limit(0), model).collect() == []


def test_no_language_is_left_out_silently(spark):
    docs = spark.createDataFrame([(k, f"text of language {k}", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    assert set(op10.fit(docs, max_languages=4).languages) == {"l0", "l1", "l2", "l3"}
    with pytest.raises(ValueError, match="max_languages"):
        op10.fit(docs, max_languages=3)


def test_language_is_fitted_on_all_texts(tables):
    docs = tables["documents"].select("doc_id", "text", "lang")
    model, again = op10.fit(docs), op10.fit(docs.repartition(3), per_language=5)
    assert model.languages == again.languages and (model.centroids == again.centroids).all() and model.bounds == again.bounds
    rows = [r for r in docs.collect() if r.lang == "en" and any(map(str.isalpha, r.text or ""))]
    x = op10.weigh(op10.features([r.text for r in rows])[0], model.idf)
    own = model.centroids[[k == "en" for k in model.languages]]
    near = (x @ own.T).argmax(1)
    for j, c in enumerate(own):  # each centroid is nearly the direction of all texts nearest to it, as passes are bounded
        total = x[near == j].sum(0)
        assert c @ total > 0.998 * np.linalg.norm(total)


def test_bounds_are_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    values = {k: rng.random(n).astype(np.float32) for k, n in ((3, 5000), (5, 1001), (10, 40))}
    rows = [(k, int(b), 2) for k, v in values.items() for b in v.view(np.int32)]
    got = op10._quantiles(spark.createDataFrame(rows, "letters int, bits int, n long"))
    assert got == [(k, pytest.approx(np.quantile(np.repeat(values[k], 2).astype(float), op10.QUANTILE))) for k in (3, 5)]


def test_noise_is_rejected(tables):
    model = op10.fit(tables["documents"], per_language=100)
    spark = tables["documents"].sparkSession
    rng = random.Random(3)
    noise = spark.createDataFrame([(1, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)))], "doc_id long, text string")
    assert op10.predict(noise, model).first().rejected


def test_rejection_is_no_matter_of_one_outlier(spark, tables):
    docs = tables["documents"].select("doc_id", "text", "lang")
    junk = [(10**6 + k, " ".join(chr(0x4E00 + 97 * k + j) for j in range(60)), "en") for k in range(3)]
    model = op10.fit(docs.union(spark.createDataFrame(junk, docs.schema)))
    foreign = [
        "De regering heeft vandaag besloten dat de nieuwe wet volgend jaar in werking zal treden voor alle burgers",
        "Regeringen beslutade idag att den nya lagen ska börja gälla från och med nästa år för alla medborgare",
        "Hükümet bugün yeni yasanın gelecek yıl bütün vatandaşlar için yürürlüğe gireceğine karar verdi",
        "A kormány ma úgy döntött hogy az új törvény jövőre lép hatályba minden polgár számára",
        "漢字仮名交文章短文例",  # fewer than 40 letters
    ]
    asked = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert all(r.rejected for r in op10.predict(asked, model).collect())
    assert op10.predict(docs, model).where("rejected").count() <= 0.01 * docs.count()


# --- nearest neighbours ----------------------------------------------------------------------------------------


def brute(rows, ask, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for j in np.flatnonzero([ask(i) for i in ids]):
        s = np.einsum("d,nd->n", x[j], x)
        s[j] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[j])] = [(int(ids[b]), s[b]) for b in best]
    return out


def test_recall_and_scores(tables):
    vectors = tables["embeddings"]
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in op9.nearest(vectors, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    x = dict(rows)
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - np.dot(np.array(x[q], float), np.array(x[i], float))) < 1e-9 for i, s in found)


def test_small_tables_are_exact_and_ties_go_to_small_ids(spark, monkeypatch):
    monkeypatch.setattr(op9, "SHARD", 30)
    monkeypatch.setattr(op9, "TOGETHER", 5)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(60)]
    rows += [(k, rows[7][1]) for k in range(100, 200)]
    got = {}
    for r in op9.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), "vec_id % 20 = 0", k=5, probe=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert got == {q: [(i, round(s, 9)) for i, s in v] for q, v in brute(rows, lambda i: i % 20 == 0, 5).items()}


def test_cells_grow_and_recall_holds(spark):
    """Two sizes of clustered vectors: more cells, a smaller share of them visited, the same recall."""
    rng = np.random.default_rng(3)
    shares = []
    for n in (2_000, 16_000):
        centers = rng.normal(size=(n // 100, 16))
        x = centers[rng.integers(0, len(centers), n)] + 0.2 * rng.normal(size=(n, 16))
        rows = list(enumerate(x.astype(np.float32).tolist()))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
        seen = []
        real = op9._trials
        op9._trials = lambda *a: seen.append((real(*a), len(a[-1].coarse))) or seen[0][0]
        try:
            got = {}
            for r in op9.nearest(df, "vec_id % 200 = 0").collect():
                got.setdefault(r.query_id, set()).add(r.vec_id)
        finally:
            op9._trials = real
        want = brute(rows, lambda i: i % 200 == 0, 20)
        assert sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) >= 0.9 * 20 * len(want)
        shares.append(seen[0])
    assert shares[1][1] > 2 * shares[0][1] and shares[1][0] / shares[1][1] < shares[0][0] / shares[0][1]


def test_hot_cells_are_split_and_rows_move_once():
    counts = np.array([10, 0, 500, 30, 30, 30])
    first, parts, n = op9._shards(counts)
    assert n >= 20 and parts[2] > 10 and parts[0] == 1
    spans = sorted((f, f + p) for f, p, c in zip(first.tolist(), parts.tolist(), counts.tolist(), strict=True) if c)
    assert all(b <= c or (a, b) == (c, d) for (a, b), (c, d) in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= n


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.1, 0.9]), (7, [0.1, 0.9]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("old"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in op9.nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]
    assert op9.nearest(df.limit(0), "vec_id % 20 = 0").collect() == []
