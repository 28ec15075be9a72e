"""Corrections by dictionary, packed keys and tile look-ups on small cases with nulls, ties and empty texts."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graniteflow.functions import correction as c
from graniteflow.functions.keys import falling, packed, unpacked
from graniteflow.plans.regions import context_corrections, correction_statistics, corrected_texts, kind_statistics, respelt_texts


CASES = [
    ("KLL3", "KL-3", ["component_code"], 0.7), ("KL3", "KL3", [], 0.5), ("200 x 300mm", "200×300", ["dimension"], 0.725), ("c30", "CL-30", ["component_code"], 0.7), ("HRB401", "HRB400", ["steel_grade"], 0.65), ("", "", [], 0.5),
    ("施工图", "施工图", [], 0.5), ("99 ~", "99 ~", [], 0.5), (None, None, [], 0.5), ("300*400*50 9×9m KLL1 KLL1", "300×400×50 9×9 KL-1 KL-1", ["component_code", "component_code", "dimension", "dimension"], 0.7125),
    ("钢筯混凝土", "钢筋混凝土", ["professional_term"], 0.65), ("x机械联接 机械联接", "x机械连接 机械联接", ["professional_term"], 0.625),
]


def test_corrections(spark):
    rows = spark.createDataFrame([(i, text, 0.5, "own") for i, (text, *_) in enumerate(CASES)], "id int, text string, confidence double, kinds_ string")
    found = {r["id"]: r for r in c.with_corrections(rows, steps=c.STEPS[:4]).collect()}
    for i, (text, want, kinds, sure) in enumerate(CASES):
        kept = [k for k in found[i]["kinds"]]
        assert (found[i]["corrected"], kept) == (want, kinds), text
        assert abs(found[i]["corrected_confidence"] - sure) < 1e-9, text
    assert c.with_corrections(rows.limit(0)).count() == 0


def test_all_steps(spark):
    rows = spark.createDataFrame([("粱", 0.5), ("c30", 0.5), ("1O0", 0.5)], "text string, confidence double")
    found = [tuple(r) for r in c.with_corrections(rows).select("corrected", "kinds").collect()]
    assert found == [("梁", ["character_error"]), ("GL-30", ["component_code", "character_error"]), ("100", ["character_error"])]


def test_steps_alone(spark):
    rows = spark.createDataFrame([("c30 Q2355", 0.9), ("C305 hrb400", 1.0)], "text string, confidence double")
    found = [tuple(r) for r in c.with_corrections(rows, steps=(c._grades,)).select("corrected", "kinds").collect()]
    assert found == [("C30 Q235", ["concrete_grade", "steel_grade"]), ("C30 HRB400", ["concrete_grade", "steel_grade"])]


def test_near_misses_are_those_of_the_ratio():
    rnd = random.Random(5)
    for term in (t for t in c.TERMS if len(t) > 3):
        pattern = re.compile(c.near_miss(term))
        for _ in range(3000):
            window = "".join(rnd.choice(term + "甲乙") if rnd.random() < 0.3 else term[min(i, len(term) - 1)] for i in range(len(term)))
            if rnd.random() < 0.3:
                window = (rnd.choice("甲乙") + term)[: len(term)] if rnd.random() < 0.5 else term[1:] + rnd.choice("甲乙")
            if len(set(window)) == len(window):
                assert bool(pattern.fullmatch(window)) == (c.TERM_LEAST < SequenceMatcher(None, window, term).ratio() < 1), (term, window)


def test_respelt(spark):
    cases = {"XZ12": "KZ-2", "I": "1", "AI": "AI", "rnm": "mm", "φ12a200": "Φ12@200", "G30": "C30", "3x4": "3×4", "": "", "G": "C", "none": "none"}
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", c.respelt(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == cases | {None: None}


def test_nearest_takes_the_first_of_the_best():
    for word in ("KLL", "C3", "HRB40", "Q34", "ZK"):
        for table, least in ((c.PREFIXES, 0.6), (c.CONCRETE, 0.7), (c.STEEL, 0.7)):
            scores = [(SequenceMatcher(None, word, t).ratio(), t) for t in table]
            best = next(t for s, t in scores if s == max(x for x, _ in scores))
            assert c.nearest(word, tuple(table), least) == (word if word in table else best if max(scores)[0] > least else None)


def test_columns(spark):
    rows = spark.createDataFrame([("KLL3", 0.2), (None, 0.4), ("", 0.6)], "t string, c double")
    out = rows.select(c.matching_ratio("t", F.lit("KL3")).alias("r"), c.nearest_entry(c.STEEL, 0.7)("t").alias("n")).collect()
    assert abs(out[0]["r"] - SequenceMatcher(None, "KLL3", "KL3").ratio()) < 1e-12 and out[1]["r"] is None and [r["n"] for r in out] == [None] * 3


def test_packed_keys_keep_order_and_values(spark):
    rows = [(7, 10**15, 3), (7, 0, 9), (0, 5, 0), (99, 10**16 - 1, 1)]
    df = spark.createDataFrame(rows, "a long, b long, d long").withColumn("k", packed((F.col("a"), 2), (F.col("b"), 16), (falling(F.col("d"), 1), 1)))
    a, b, d = unpacked(F.col("k"), 2, 16, 1)
    out = df.orderBy("k").select("a", "b", "d", a.alias("x"), b.alias("y"), falling(d, 1).alias("z")).collect()
    assert [tuple(r)[:3] for r in out] == sorted(rows, key=lambda r: (r[0], r[1], -r[2])) and all(tuple(r)[:3] == tuple(r)[3:] for r in out)


def test_keys_that_run_over_are_errors(spark):
    df = spark.createDataFrame([(10**11 + 5,)], "a long")
    with pytest.raises(Exception, match="key part not below"):
        df.select(packed((F.col("a"), 11), (F.lit(1), 1)).alias("k")).collect()
    assert df.select(packed((F.lit(None).cast("long"), 3)).alias("k")).first()["k"] is None
    with pytest.raises(ValueError, match="37 digits"):
        packed((F.col("a"), 30), (F.col("a"), 8))


def test_each_distinct_text_is_corrected_once_over_all_tasks(spark):
    rows = spark.createDataFrame([(i, t, i / 10) for i, t in enumerate(["KLL3", None, "KLL3", "", "c301", "KLL3"])], "id int, text string, confidence double")
    found = c.with_corrections(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "HashAggregate" in plan
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == 6 and got[1]["corrected"] is None and got[1]["kinds"] == [] and got[1]["corrected_confidence"] == 0.1 and got[3]["corrected"] == "" and got[3]["kinds"] == []
    assert len({got[i]["corrected"] for i in (0, 2, 5)}) == 1 and len({got[i]["corrected_confidence"] for i in (0, 2, 5)}) == 3


def test_statistics_are_of_texts_corrected_over_all_tasks(spark):
    plan = correction_statistics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_statistics_count_texts_first_and_join_nothing(spark):
    rows = [("KLL3",)] * 3 + [(None,), ("",), ("KL3",), ("KL3",), ("300*400*50 9×9m KLL1 KLL1",)]
    found = kind_statistics(spark.createDataFrame(rows, "text string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("character_error", 1, 1.0), ("component_code", 5, 1.0), ("dimension", 2, 1.0), (None, 4, 0.0), (None, 12, round(8 / 12, 6))]))
    assert kind_statistics(spark.createDataFrame([], "text string")).count() == 0
    sf_dir = "/root/testdata/sf0.001"
    got = correction_statistics(spark, sf_dir)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    each = corrected_texts(spark, sf_dir).select(F.explode_outer(F.when(F.col("kinds") != "", F.split("kinds", ","))).alias("kind"))
    plain = each.rollup("kind").agg(F.count("*").alias("n"), F.round(F.count("kind") / F.count("*"), 6).alias("rate"))
    assert got.schema == plain.schema and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_context_and_spellings_are_looked_at_once_for_each_text(spark):
    for query in (context_corrections, respelt_texts):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "HashAggregate" in plan, query
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["1O0", None, "1O0", "", "粱"])], "id int, text string")
    found = c.once(rows, "text", lambda texts: texts.withColumn("c", c.in_context(F.col("_whole"))["text"]))
    assert found.columns == ["id", "text", "c"] and sorted((r["id"], r["c"]) for r in found.collect()) == [(0, "100"), (1, None), (2, "100"), (3, ""), (4, "梁")]
