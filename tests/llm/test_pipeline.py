import random

from conftest import prose

import __spark_entry__
import corpus_pipeline


def test_stages_in_order_on_what_the_one_before_kept(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, prose(rng, 120), "en", f"s{k % 3}") for k in range(30)]
    item = prose(rng, 30)
    rows += [(100, rows[4][1], "en", "s"), (101, rows[5][1].replace(" ", "  ") + " end", "en", "s"), (102, "42 - 17", "en", "s"), (103, None, None, None), (104, prose(rng, 40) + " " + item, "en", "s")]
    shared = prose(rng, 60)
    rows += [(200 + k, prose(rng, 90) + " " + shared + " " + prose(rng, 90), "en", "s") for k in range(2)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]
    kept, frame = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r for r in frame.collect()})
        if k < 4:
            assert frame.columns == docs.columns
    clean = set(range(30)) | {200, 201}
    assert set(kept[0]) == clean | {100, 101, 104}
    assert set(kept[1]) == clean | {104}
    assert set(kept[2]) == clean | {104} and shared in kept[2][200]["text"] and shared not in kept[2][201]["text"]
    assert kept[2][201]["n_chars"] == len(kept[2][201]["text"]) and all(kept[2][k]["text"] == rows[k][1] for k in range(30))
    assert set(kept[3]) == clean == set(kept[4])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, frame.select("doc_id", "start", "ids_crc32").collect()))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
