"""The pipeline on small tables: what each stage must drop goes, the rest stays."""

import corpus_pipeline


def test_pipeline(spark, documents, sentence, tmp_path):
    bad = ["grumblot", "vexnard", "slimewort"]
    rows = [(i, sentence(i, 60) + (f" {bad[i % 3]} x {bad[(i + 1) % 3]}" if i % 4 == 0 else ""), f"s{i % 2}") for i in range(240)]
    rows += [(1000, rows[1][1], "s0"), (1001, sentence(77, 40) + " " + sentence(5555, 20), "s1"), (1002, "mail jo@x.org " + sentence(8, 30), "s0"), (1003, None, "s1")]
    rows += [(1010 + i, "mail " + sentence(3000 + i, 40), "s0") for i in range(12)]  # else the word would disclose the one address
    documents(rows).drop("h").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, sentence(5555, 20))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in left.items()}
    clean = {i for i, _, _ in rows if i >= 240 or i % 4}
    assert ids["toxicity"] == clean and ids["near-dedup"] == clean - {1000} and ids["decontamination"] == clean - {1000, 1001}
    texts = {r.doc_id: r.text for r in left["sanitisation"]}
    assert texts[1002].startswith("mail <EMAIL> ") and texts[1] == rows[1][1] and texts[1003] is None
    assert ids["mixing"] <= ids["sanitisation"]
