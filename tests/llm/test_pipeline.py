import zlib

import corpus_pipeline
from sparquill.llm import decontamination, secret_scan

from .conftest import make, words


def test_stages_filter_what_they_should_and_no_more(spark, rnd, tmp_path):
    vile = ("vile", "foul", "nasty")
    rows, labels = [], []
    for i in range(400):
        w = words(rnd, 60, 4000).split()
        if i % 5 == 0:
            for _ in range(5):
                w.insert(rnd.randrange(len(w)), rnd.choice(vile))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    item = words(rnd, 30, 4000)
    rows += [(1000, rows[1][1]), (1001, "x " + item + " y"), (1002, 'see token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + words(rnd, 50)), (1003, None), (None, words(rnd, 20))]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == before.columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic, unique, clean, masked = kept
    assert sum(i in toxic for i in range(0, 400, 5)) <= 4 and sum(i not in toxic for i in range(400) if i % 5) <= 3
    assert 1000 not in unique and 1 in unique and len(unique) == len(toxic) - 1
    assert set(unique) - set(clean) == {1001}
    assert set(masked) == set(clean) and "<secret:assign>" in masked[1002] and masked[1002] == secret_scan.redact(dict(rows)[1002])
    assert all(masked[i] == t for i, t in clean.items() if i != 1002)
    out = docs.collect()
    assert {r.doc_id for r in out} == set(masked)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in whole) == sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in out)
    assert decontamination.plain(" A  b\n") == "a b" and zlib.crc32(b"1") > 0
