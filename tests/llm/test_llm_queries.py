"""Registered queries against their SQL, and the pipeline, stage by stage, against plain programs."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheafwork.llm import quality, tokens
from sheafwork.llm.mixing import mixing_sql
from sheafwork.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_names():
    import __spark_entry__

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert {"pipeline", *QUERIES} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mix_sources", "bpe_encode"]


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarities(rows):
    sets, inside = {r.doc_id: shingles(r.text) for r in rows}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inside[g].append(i)
    met = defaultdict(int)
    for ids in inside.values():
        for a in ids:
            for b in ids:
                if a < b:
                    met[a, b] += 1
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in met.items()}


def test_pipeline_by_stages(spark, sf_dir, duck, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("_id", F.lit(1))
    before, columns = docs.collect(), docs.columns
    assert docs.count() == len(before)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if k < 4:
            assert docs.columns == columns and len(ids) == len(after)
        if name == "quality_rules":
            good = {r.doc_id for r in before if (c := quality.counts(r.text or "")[0])[0] >= 50 and 2 * c[4] <= c[0]}
            assert ids <= good and len(ids) > 0.7 * len(good)
            labels = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
            assert ids >= good & labels
        elif name == "exact_dedup":
            least = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                least[key] = min(r.doc_id, least.get(key, r.doc_id))
            assert ids == set(least.values())
        elif name == "simhash_near_dedup":
            pairs = similarities(before)
            gone = {r.doc_id for r in before} - ids
            assert not [p for p, j in pairs.items() if j >= 0.85 and p[0] in ids and p[1] in ids]
            assert all(any(j >= 0.6 and i in p and min(p) < i for p, j in pairs.items()) for i in gone)
        elif name == "mix_sources":
            duck.execute(f"CREATE OR REPLACE TEMP VIEW kept_docs AS SELECT doc_id, text, lang, source FROM '{tmp_path}/simhash_near_dedup/*.parquet'")
            want = duck.execute("WITH " + mixing_sql("kept_docs", corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, corpus_pipeline.SEED) + " SELECT doc_id FROM mixed").fetchall()
            assert ids == {r[0] for r in want} and len(after) < len(before)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.ids for r in after} == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
        before = after
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(whole.columns) == sorted(docs.columns) and whole.count() == len(before)


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_nulls(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(None, None, None, None, None), (1, text, None, None, None), (None, text + " x", None, "src1", 3), (2, "", "en", None, 0)], schema)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= docs.count()
