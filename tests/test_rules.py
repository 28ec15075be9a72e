"""Formulas against Python's own arithmetic, what isn't taken, and rules from a table."""

import random

import pytest
from graniteflow.functions.formulas import FormulaError, formula
from graniteflow.plans.rules import SCHEMA, TEMPLATES, rule_quantities
from pyspark.sql import functions as F

NAMES = {"a": 2.0, "b": -3.5, "c_1": 0.25}


def drawn(rnd, depth=0):
    kind = rnd.randrange(6 if depth < 5 else 2)
    if kind == 0:
        return rnd.choice(["1", "2.5", ".5", "10."])
    if kind == 1:
        return rnd.choice(list(NAMES))
    if kind == 2:
        return f"({drawn(rnd, depth + 1)})"
    if kind == 3:
        return f"-{drawn(rnd, depth + 1)}" if rnd.random() < 0.5 else f" {drawn(rnd, depth + 1)} "
    return f"{drawn(rnd, depth + 1)} {rnd.choice('+-*')} {drawn(rnd, depth + 1)}"


def test_values_are_those_of_arithmetic(spark):
    rnd = random.Random(4)
    texts = [drawn(rnd) for _ in range(80)] + ["2 - 3 - 4", "2 * (a + b) * 3 / 4 / 2", "8 / 2 * 4", "- a * - b"]
    columns = {n: F.lit(v) for n, v in NAMES.items()}
    row = spark.range(1).select(*[formula(t, columns).alias(f"v{i}") for i, t in enumerate(texts)]).first()
    for t, v in zip(texts, row, strict=True):
        assert v == pytest.approx(eval(t, {"__builtins__": {}}, NAMES)), t  # drawn above, from a grammar of numbers and names
    assert spark.range(1).select(formula("1 / (a - a)", columns), formula("1 / x", {"x": F.lit(None)})).first()[:] == (None, None)


@pytest.mark.parametrize("text", ["", "  ", "1 +", "(1", "1)", "a b", "unknown", "a ** 2", "a; b", "a.b", "f(a)", "'a'", "a % 2", "()", "--", "1 2", "(" * 60 + "1" + ")" * 60, "1+" * 600 + "1"])
def test_what_is_no_formula(text):
    with pytest.raises(FormulaError):
        formula(text, {"a": F.lit(1.0), "f": F.lit(1.0)})


def test_rules_of_a_table(spark):
    rules = [("x", "m", "u", "p * k", {"p_default": 4.0, "k": 2.0}), ("x", "n", "u", "p +", None), ("y", "m", "v", None, None), ("x", "m", "late", "q * 9", {}), (None, "m", "u", "p", {})]
    rows = spark.createDataFrame([(1, "x", None), (2, "x", 3.0), (3, "y", 1.0), (4, None, 1.0), (5, "z", 1.0)], "id int, kind string, p double")
    found = rule_quantities(rows, spark.createDataFrame(rules, SCHEMA), ["p"]).select("id", "measure", "unit", "quantity", "error").collect()
    want = [(1, "m", "u", 8.0, None), (1, "n", "u", None, "ends too early"), (2, "m", "u", 6.0, None), (2, "n", "u", None, "ends too early"), (3, "m", "v", None, "ends too early"), (4, None, "个", 0.0, None), (5, None, "个", 0.0, None)]
    assert sorted(tuple(r) for r in found) == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert rule_quantities(rows.limit(0), spark.createDataFrame(rules, SCHEMA), ["p"]).count() == 0
    many = spark.range(2500).select(F.concat(F.lit("k"), "id").alias("kind"), F.lit("m").alias("measure"), F.lit("u").alias("unit"), F.lit("p").alias("formula"), F.lit(None).cast("map<string,double>").alias("parameters"))
    with pytest.raises(ValueError, match="over 2000 rules"):
        rule_quantities(rows, many, ["p"])


def test_templates_by_hand(spark):
    rows = spark.createDataFrame([("beam", 300.0, 600.0, 6000.0)], "kind string, width double, height double, length double").withColumns({n: F.lit(None).cast("double") for n in ("depth", "thickness", "area")})
    found = {r["measure"]: r["quantity"] for r in rule_quantities(rows, spark.createDataFrame(TEMPLATES, SCHEMA), ["length", "width", "height", "depth", "thickness", "area"]).collect()}
    assert found == {"volume": pytest.approx(1.08), "area": pytest.approx(10.8)}
