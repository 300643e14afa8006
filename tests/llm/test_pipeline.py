import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    counts = [before]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out.cache()
        counts.append(docs.count())
    assert 0.9 * before > counts[1] - 50 and counts[2] <= counts[1] and counts[3] < counts[2]
    assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    placed = corpus_pipeline.shard(spark, docs, folder)
    assert placed.count() == counts[4] and placed.select("shard").distinct().count() == corpus_pipeline.SHARDS


def test_odd_documents_pass_the_filters(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, "plain words of no harm", "en", None, 5)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, odd.withColumn("score", F.lit(1)).withColumn("component_id", F.lit(2)), folder).count() == 3
        assert stage(spark, odd.limit(0), folder).count() == 0


def test_mixing_deals_copies_to_rows_without_an_id(spark):
    """Rows without an id count for their own source, each by its text."""
    rows = [(i, "word " * 40 + str(i), "en", "big", 0) for i in range(300)] + [(None, "word " * 40 + str(i), "en", "none" if i % 2 else "big", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    sizes = {"big": 330 * 41, "none": 30 * 41}
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    targets = {"big": 1.5 * 360 * 41 - 2 * sizes["none"], "none": 2 * sizes["none"]}  # the small source reaches its cap
    assert all(abs(words[s] - min(targets[s], 2 * sizes[s])) <= 41 for s in sizes)
    assert mixed.groupBy("text", "doc_id", "source").count().where("count > 2").count() == 0
