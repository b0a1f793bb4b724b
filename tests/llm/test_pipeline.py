"""Each stage of the pipeline against a brute-force version, and the whole."""

import os

import pytest
from cases import documents
from pyspark.sql import functions as F
from test_join import brute

import corpus_pipeline as cp
from maskflow.llm import op7_toxicity, op8_mixing, op10_language

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns_and_filter(spark, docs):
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_toxicity_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(cp.fold("doc_id", 5) != 0)
    scored = op7_toxicity.score(docs, op7_toxicity.fit(docs, labels)).collect()
    assert sorted(r.doc_id for r in cp.toxicity(spark, docs, SF).collect()) == sorted(r.doc_id for r in scored if r.score < 0.5)


def test_language_stage(spark, docs):
    odd = docs.limit(3).withColumn("text", F.lit("12 34 !!")).withColumn("doc_id", F.col("doc_id") + 10**6)
    both = docs.union(odd)
    rejected = {r.doc_id for r in op10_language.predict(both, op10_language.fit(both)).collect() if r.rejected}
    kept = {r.doc_id for r in cp.language(spark, both, SF).collect()}
    assert rejected >= {r.doc_id for r in odd.collect()} and kept == {r.doc_id for r in both.collect()} - rejected


def test_near_copies_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in cp.near_copies(spark, docs, SF).collect()) == sorted(i for i, _, c in brute(rows, 80, 5) if i == c)


def test_toxicity_stage_keeps_texts_without_a_word(spark, docs):
    odd = docs.limit(4).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "12 34 !!").when(F.col("doc_id") % 3 == 0, "")).withColumn("doc_id", F.col("doc_id") + 10**6)
    assert cp.toxicity(spark, docs.union(odd), SF).where("doc_id >= 1000000").count() == 4


def test_mixing_stage(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("docs", docs.toArrow())
    domain = "'d' || (nullif(regexp_extract(doc_source, '[0-9]+'), '')::INT % 4)"
    want = con.execute(f"WITH {op8_mixing.mixing_sql(cp.MIX, 'docs', domain)} SELECT doc_id, epoch FROM taken").fetchall()
    got = cp.mixing(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in want) and 0 < len(want) < docs.count()


def test_encoding_stage(spark, docs):
    import hashlib

    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in cp.encoding(spark, docs, SF).join(docs, "doc_id").collect():
        ids = library.encode(r.text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)


def test_near_copies_are_those_of_five_words_and_80_percent(spark):
    words = [f"w{k}" for k in range(500)]
    appended = [*words, *(f"p{k}" for k in range(110))]  # 496 of 606 five-word shingles in common, 498 of 608 three-word ones
    other = [f"v{k}" for k in range(400)]
    scattered = [f"e{k}" if k % 40 == 20 and k < 360 else w for k, w in enumerate(other)]  # 351 of 441, 371 of 425
    rows = [(k + 1, " ".join(x)) for k, x in enumerate((words, appended, other, scattered))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in cp.near_copies(spark, docs, SF).collect())
    assert kept == sorted(i for i, _, c in brute(rows, 80, 5) if i == c) == [1, 3, 4]


def test_whole_pipeline(spark, docs):
    ids = [r.doc_id for r in cp.run(spark, SF).collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()


def test_stages_cope_with_every_case(spark, tmp_path):
    spark.createDataFrame([(20, 0), (21, 1), (22, 0), (23, 1), (None, 1), (24, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = documents(spark)
    for name, stage in cp.STAGES:
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        assert stage(spark, rows.limit(0), str(tmp_path)).collect() == []
    rows.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
