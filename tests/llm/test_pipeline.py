import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graniteflow.llm.common import fresh_path


@pytest.fixture(scope="module")
def folder(spark):
    from test_langid import corpus

    docs = [(i, t, lang, "s", len(t)) for i, t, lang, *_ in corpus(300)]
    docs += [(1000 + i, docs[i][1], docs[i][2], "s", docs[i][4]) for i in range(0, 60, 3)]
    bad = {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 0}
    docs = [(i, t + " scoundrel villain" if i in bad else t, *rest) for i, t, *rest in docs]
    docs += [(2000, "12 34", None, None, 5), (2001, None, "aa", None, None), (2002, "", "aa", "s", 0)]
    path = fresh_path(spark, "pipeline-test")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(d[0] in bad)) for d in docs[:320]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, bad


def test_stages_decide(spark, folder):
    path, docs, bad = folder
    left = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, left, path)
        assert nxt.columns == left.columns
        left = corpus_pipeline.written(nxt)
        kept.append({r["doc_id"] for r in left.select("doc_id").collect()})
    assert kept[0] == {d[0] for d in docs} - {2000, 2001, 2002}
    assert len(kept[0] - kept[1] - bad) <= 3 and len((kept[0] & bad) - kept[1]) >= 0.97 * len(bad)
    texts = {d[0]: d[1] for d in docs}
    assert {texts[i] for i in kept[1]} >= {texts[i] for i in kept[2]} and len({texts[i] for i in kept[2]}) == len(kept[2])
    pieces = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == kept[2]


def test_columns_of_clashing_names_stay(spark, folder):
    path, docs, _ = folder
    own = {c: f"own {c}" for c in ("score", "lang_pred", "predicted", "spans", "node", "class_id")}
    left = spark.read.parquet(f"{path}/documents.parquet").withColumns({k: F.lit(v) for k, v in own.items()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, left, path)
        assert nxt.columns == left.columns
        left = corpus_pipeline.written(nxt)
    assert left.count() > 100 and left.select(*own).distinct().collect() == [tuple(own.values())]
