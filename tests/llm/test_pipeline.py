import pytest

import corpus_pipeline as P


@pytest.fixture
def folder(spark, tmp_path, docs, nasty):
    docs = docs.withColumn("doc_id", docs.doc_id + 100)
    items = [(1, "a question of the benchmark about words and things. the answer is that.")]
    leak = [(900, "some abc dead beef head cage fade bead " * 4 + items[0][1] + " and a bag of beads", "en", "src3", 1)]
    df = docs.unionByName(nasty.select(docs.columns)).unionByName(spark.createDataFrame(leak, docs.schema))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder, docs, tmp_path):
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, kept, folder)
        assert out.columns == (docs.columns if k < len(P.STAGES) - 1 else [*docs.columns, "shard"])
        out.write.parquet(f"{folder}/{k}")
        kept = spark.read.parquet(f"{folder}/{k}")
        seen[name] = [r.doc_id for r in kept.collect()]
    assert not {1, 2, 3, 11} & set(seen["language_id"]) and 900 in seen["ngram_jaccard_join"] and 900 not in seen["benchmark_decontamination"]
    assert 9 not in seen["ngram_jaccard_join"] or 8 not in seen["ngram_jaccard_join"]
    assert 0 < len(seen["source_mixing"]) <= len(seen["benchmark_decontamination"]) and sorted(seen["sharding"], key=str) == sorted(seen["source_mixing"], key=str)
    whole = P.run(spark, folder).collect()
    assert sorted((r.doc_id for r in whole), key=str) == sorted(seen["sharding"], key=str)


def test_empty_and_clashing_tables(spark, nasty, folder):
    for name, stage in P.STAGES:
        assert stage(spark, nasty.limit(0), folder).count() == 0, name
        out = stage(spark, nasty, folder)
        assert out.columns == nasty.columns and out.count() <= nasty.count(), name
