from weft.llm.near_dedup import keep_representatives, near_duplicates
from weft.llm.toxicity import drop_toxic, toxicity_scores


def test_drop_toxic_follows_the_scores(spark, edge, empty, no_labels):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r.doc_id for r in toxicity_scores(docs, labels).where("predicted = 0").collect()}
    got = drop_toxic(docs, labels)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want and 0 < len(want) < docs.count()
    assert drop_toxic(edge, no_labels).columns == edge.columns and drop_toxic(edge, no_labels).count() == edge.count()
    assert drop_toxic(empty, labels).count() == 0


def test_keep_representatives(spark, edge, empty):
    kept = keep_representatives(edge)
    assert kept.columns == edge.columns
    want = sorted(str(r.doc_id) for r in near_duplicates(edge).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert keep_representatives(empty).count() == 0
