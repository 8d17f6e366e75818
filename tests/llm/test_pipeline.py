"""The pipeline on the smallest tables: each stage on what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import decontamination, jaccard_join, line_dedup, ordinal_classifier, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns and after.count() <= before.count(), name
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if stage is corpus_pipeline.quality_stage:
            graded = ordinal_classifier.grade_documents(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert kept == {r["doc_id"] for r in graded.where("kept").collect()}
        elif stage is corpus_pipeline.line_stage:
            assert kept == {r["doc_id"] for r in line_dedup.clean_documents(before).collect()}
        elif stage is corpus_pipeline.jaccard_stage:
            assert kept == {r["component_id"] for r in jaccard_join.jaccard_components(before, 5, 80, 100).collect()}
        elif stage is corpus_pipeline.decontamination_stage:
            leaks = decontamination.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert kept == ids - {r["doc_id"] for r in leaks.collect()}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert set(columns) < set(last.columns) and last.count() > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 20 and out.select("doc_id").distinct().count() == out.count()


def test_run_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, and columns with the names that stages make; then no rows at all."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id < 3"))
    odd = docs.where("doc_id >= 20").unionByName(odd).unionByName(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    odd = odd.withColumns({"repeats": F.lit(9), "Kept": F.lit("x"), "component_id": F.lit(1), "row": F.lit(2)})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*odd.columns, "repeats_"] and out.count() > 20 and out.agg(F.max("repeats")).first()[0] == 9
    assert out.groupBy("text").count().where("count > 1").count() == 0
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
