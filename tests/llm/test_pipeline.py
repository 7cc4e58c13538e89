import corpus_pipeline
from bracketry.llm import quality_crf

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA)
        assert at.columns == docs.columns, name
        at = spark.createDataFrame(at.collect(), docs.schema)
        kept.append({r["doc_id"] for r in at.collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:]))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r["doc_id"] for r in quality_crf.apply(docs, quality_crf.train(docs, labels)).where("score >= 0.3").collect()}
    assert kept[0] == good
    out = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept[-1]
