import random

import corpus_pipeline


def test_runs_end_to_end(spark, tmp_path):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage, leak = prose(60), prose(25)
    rows = [(i, prose(150), "en", f"s{i % 2}", 0) for i in range(40)]
    rows += [(40, rows[3][1], "en", "s0", 0), (41, rows[4][1] + " x", "en", "s0", 0), (42, prose(50) + " " + passage + " " + prose(50), "en", "s1", 0), (43, prose(40) + " " + passage, None, None, 0), (44, prose(30) + " " + leak, "en", "s0", 0), (45, None, "en", "s0", 0)]
    rows += [(50 + i, prose(30) + " scumbag " + prose(30) + " scumbag", "en", "s0", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(i >= 50)) for i in range(80) if not 40 <= i < 50]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {x.doc_id: x for x in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["toxicity"]) == set(range(46))
    assert set(seen["near dedup"]) == set(range(46)) - {40, 41}
    assert passage not in seen["suffix dedup"][42].text and passage not in (seen["suffix dedup"][43].text or "")
    assert seen["suffix dedup"][7].text == rows[7][1]
    assert set(seen["decontamination"]) == set(seen["suffix dedup"]) - {44}
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).selectExpr("sum(length)").first() == docs.selectExpr("sum(length)").first()
