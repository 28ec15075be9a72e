"""Correction of recognised texts by dictionaries and context, in column functions.

What a step finds is an array of hits; the text is folded over them. Only the matching ratio of words, which no
built-in gives, runs in Python: on the words that stand in a text, each looked up once in a task's bounded memo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteflow.session import spread

#: Prefixes of component codes, grades of concrete and steel, terms of the trade.
PREFIXES = (
    "KZ GZ XZ KZZ QZ YZ JKZ KL LL JL GL XL WKL LWL TL AL CL KB WB YJB LTB PB ZGB Q QQ FQ WQ DQ JC DJ TJ FJ ZJ CFG LT LTD XD FT DP YT"
).split()
CONCRETE = [f"C{n}" for n in range(10, 85, 5)]
STEEL = "HPB300 HRB335 HRB400 HRB500 HRBF335 HRBF400 HRBF500 Q235 Q345 Q390 Q420 Q460".split()
TERMS = (
    "建筑结构 结构设计 施工图 平面图 立面图 剖面图 详图 节点详图 配筋图 布置图 模板图 现浇 预制 装配式 钢筋混凝土 预应力 抗震 抗风 荷载 承载力 刚度 稳定性 "
    "基础 地基 桩基 承台 地梁 防水 保温 隔热 防火 防腐 耐久性 施工缝 后浇带 伸缩缝 沉降缝 抗震缝 钢筋 箍筋 主筋 分布筋 构造筋 锚固 "
    "搭接 连接 焊接 机械连接 绑扎 混凝土 水泥 砂浆 外加剂 掺合料 模板 支撑 脚手架 安全网 防护栏 质量 检验 验收 监理 试验 检测"
).split()
#: Characters and what they are misread as, in this order.
CONFUSED = {
    "0": "Oo○", "1": "Il|", "2": "Z", "3": "8", "5": "Ss", "6": "G", "8": "B", "9": "g", "B": "86", "D": "0O", "G": "6C", "I": "1l", "O": "0Q", "Q": "0O", "S": "5", "Z": "2", "梁": "粱", "柱": "住", "板": "扳", "墙": "强",
}
#: Right spellings and wrong ones, in this order; wrong ones of one character count only as the whole text.
SPELLINGS = {
    "KZ": "XZ KJ K2 KZ1 K乙", "GL": "CL G1 OL 6L GL1", "JC": "JO IC JG J0 JC1", "WQ": "MQ W0 VQ WO", "LT": "L7 LI 17 LT1", "SZ": "52 S2 SZ1 SJ", "Φ": "φ O 0 @ θ Ф", "@": "a A & α о", "C": "G c ℃ C2", "1": "I l | !", "0": "O o °",
    "2": "Z z", "5": "S s", "6": "G b", "8": "B", "9": "g q", "mm": "mm MM rnm nn", "m": "rn nn M", "MPa": "MPA Mpa mpa Mfa",
}
#: Patterns of codes, rebar, sizes and concrete, and how they are written.
FORMATS = (
    (r"([KGJLWSZBC])([Z|L|C|Q|T])[-\s]*([0-9]+)", r"$1$2-$3"), (r"[ΦφO0]([0-9]+)[@aA&]([0-9]+)", r"Φ$1@$2"), (r"([0-9]+)[x×*]([0-9]+)", r"$1×$2"), (r"[CcGg]([0-9]+)", r"C$1"),
)
CODE, SIZE = "([A-Za-z]{1,4})[-_]?([0-9]+)[A-Za-z]?", r"(?i)([0-9]+)\s*[×x*]\s*([0-9]+)(?:\s*[×x*]\s*([0-9]+))?(?:mm|cm|m)?"
GRADES = (("concrete_grade", "(?i)C[0-9]{2,3}", CONCRETE), ("steel_grade", "(?i)(?:HPB|HRB|HRBF|Q)[0-9]{3,4}", STEEL))
PREFIX_LEAST, GRADE_LEAST, TERM_LEAST = 0.6, 0.7, 0.7
_FOUND = "array<struct<kind:string,confidence:double>>"


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=100_000)
def nearest(word: str, table: tuple[str, ...], least: float) -> str | None:
    """The entry that is word or, first of the best, alike by over ``least``."""
    if word in table:
        return word
    best = max(table, key=lambda entry: ratio(word, entry))
    return best if ratio(word, best) > least else None


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over both lengths, by longest matching blocks; null for a null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def nearest_entry(table: list[str], least: float) -> Callable[[Column], Column]:
    """A column function: the entry of a table nearest to a word, null if none is alike by over ``least``."""
    return lambda word: F.get(nearest_entries(table, least)(F.array(word)), F.lit(0))


def nearest_entries(table: list[str], least: float) -> Callable[[Column], Column]:
    """A column function on arrays of words: of each word the nearest entry of a table, or null."""
    entries = tuple(table)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in words:
            yield batch.map(lambda row: None if row is None else [None if w is None else nearest(w, entries, least) for w in row])

    return find


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _folded(text: Column, edits: Column) -> Column:
    """text with each edit's ``wrong`` replaced by ``right`` wherever it stands, one edit after the other."""
    return F.aggregate(edits, text, lambda t, e: F.replace(t, e["wrong"], e["right"]))


def _noted(edits: Column, kind: str) -> Column:
    return F.transform(edits, lambda e: F.struct(F.lit(kind).alias("kind"), e["confidence"].alias("confidence"))).cast(_FOUND)


def _codes(df: DataFrame) -> DataFrame:
    """Codes whose prefix isn't known get the nearest one, a hyphen and their number."""
    df = df.withColumns({"_hits": hits(F.col("_text"), CODE), "_words": F.transform(hits(F.col("_text"), CODE, 1), F.upper), "_numbers": hits(F.col("_text"), CODE, 2)})
    df = df.withColumn("_right", nearest_entries(PREFIXES, PREFIX_LEAST)("_words"))
    parts = F.arrays_zip("_hits", "_words", "_numbers", "_right")
    wrong = F.filter(parts, lambda p: p["_right"].isNotNull() & (p["_right"] != p["_words"]))
    edits = F.transform(wrong, lambda p: F.struct(p["_hits"].alias("wrong"), F.concat(p["_right"], F.lit("-"), p["_numbers"]).alias("right"), F.lit(0.9).alias("confidence")))
    df = df.withColumn("_edits", edits)
    return df.withColumns({"_text": _folded(F.col("_text"), F.col("_edits")), "_found": F.concat("_found", _noted(F.col("_edits"), "component_code"))})


def _sizes(df: DataFrame) -> DataFrame:
    """Sizes are written with × and without spaces and units: what stands between them is joined again."""
    text = F.col("_text")
    plain = F.transform(F.arrays_zip(hits(text, SIZE, 1).alias("a"), hits(text, SIZE, 2).alias("b"), hits(text, SIZE, 3).alias("c")), lambda x: F.concat_ws("×", x["a"], x["b"], F.when(x["c"] != "", x["c"])))
    df = df.withColumns({"_hits": hits(text, SIZE), "_right": plain, "_parts": F.split(text, SIZE, -1)})
    edited = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.get("_right", i), F.lit("")))), "")
    edits = F.transform(F.filter(F.arrays_zip("_hits", "_right"), lambda p: p["_hits"] != p["_right"]), lambda p: F.struct(F.lit(0.95).alias("confidence")))
    return df.withColumns({"_text": F.when(F.size("_hits") > 0, edited).otherwise(text), "_found": F.concat("_found", _noted(edits, "dimension"))})


def _grades(df: DataFrame) -> DataFrame:
    """Grades of concrete and steel become the nearest known one; both are looked for in the text before either is changed."""
    df = df.withColumns({f"_hits{i}": hits(F.col("_text"), pattern) for i, (_, pattern, _) in enumerate(GRADES)})
    for i, (kind, _, table) in enumerate(GRADES):
        df = df.withColumn("_right", nearest_entries(table, GRADE_LEAST)(F.transform(f"_hits{i}", F.upper)))
        wrong = F.filter(F.arrays_zip(F.col(f"_hits{i}").alias("wrong"), F.col("_right").alias("right")), lambda p: p["right"].isNotNull() & (p["right"] != p["wrong"]))
        edits = F.transform(wrong, lambda p: F.struct(p["wrong"].alias("wrong"), p["right"].alias("right"), F.when(p["right"] == F.upper(p["wrong"]), 0.9).otherwise(0.8).alias("confidence")))
        df = df.withColumn("_edits", edits)
        df = df.withColumns({"_text": _folded(F.col("_text"), F.col("_edits")), "_found": F.concat("_found", _noted(F.col("_edits"), kind))})
    return df


def near_miss(term: str) -> str:
    """A pattern of the stretches as long as a term that have all its characters but one, in its order, and another character anywhere."""
    n = len(term)
    shapes = {rest[:at] + "." + rest[at:] for rest in (term[:i] + term[i + 1 :] for i in range(n)) for at in range(n)}
    return f"(?s)(?!{term})(?:{'|'.join(sorted(shapes))})"


def _terms(df: DataFrame) -> DataFrame:
    """The first near miss of each term becomes the term. Of terms under four characters a miss by one is alike by 0.67 at most, so it isn't near."""
    for term in TERMS:
        alike = (len(term) - 1) / len(term)
        if alike > TERM_LEAST:
            df = df.withColumn("_parts", F.split("_text", near_miss(term), 2))
            missed = F.size("_parts") == 2
            noted = F.when(missed, F.array(F.struct(F.lit("professional_term").alias("kind"), F.lit(alike).alias("confidence")))).otherwise(F.array()).cast(_FOUND)
            df = df.withColumns({"_text": F.when(missed, F.concat(F.col("_parts")[0], F.lit(term), F.col("_parts")[1])).otherwise(F.col("_text")), "_found": F.concat("_found", noted)})
    return df


def in_context(text: Column) -> Column:
    """(text, n) after confusable characters: one is put right, wherever it stands, if at least half of the two characters on either side
    of its first place are digits (for a digit) or letters (for a letter). n: how many kinds were."""
    pairs = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right"), F.lit("[0-9]" if r.isdigit() else r"\p{L}").alias("like")) for r, wrong in CONFUSED.items() for w in wrong])

    def step(state: Column, pair: Column) -> Column:
        def around(at: Column) -> Column:
            context = F.concat(F.substring(state["text"], F.greatest(at - 2, F.lit(1)), at - F.greatest(at - 2, F.lit(1))), F.substring(state["text"], at + 1, F.lit(2)))
            return (at > 0) & let(context, lambda c: F.char_length(F.regexp_replace(c, pair["like"], "")) * 2 <= F.char_length(c))

        return let(
            let(F.instr(state["text"], pair["wrong"]), around),
            lambda ok: F.struct(F.when(ok, F.replace(state["text"], pair["wrong"], pair["right"])).otherwise(state["text"]).alias("text"), (state["n"] + ok.cast("int")).alias("n")),
        )

    return F.aggregate(pairs, F.struct(text.alias("text"), F.lit(0).alias("n")), step)


def _context(df: DataFrame) -> DataFrame:
    df = df.withColumn("_seen", in_context(F.col("_text")))
    noted = F.array_repeat(F.struct(F.lit("character_error").alias("kind"), F.lit(0.8).alias("confidence")), F.col("_seen")["n"]).cast(_FOUND)
    return df.withColumns({"_text": F.col("_seen")["text"], "_found": F.concat("_found", noted)})


STEPS: tuple[Callable[[DataFrame], DataFrame], ...] = (_codes, _sizes, _grades, _terms, _context)


def dealt(texts: DataFrame, text: str = "text") -> DataFrame:
    """Grouped texts dealt out over all tasks: by a hash, as a second dealing by the texts themselves would be left out."""
    return spread(texts, F.xxhash64(text))


def once(df: DataFrame, text: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that ``found`` adds to its distinct texts (_whole); null for a null text.

    The distinct ones are dealt out anew, as the table that they come from may be read in one task.
    """
    texts = df.select(F.col(text).alias("_whole")).where("_whole IS NOT NULL").distinct()
    return df.join(found(dealt(texts, "_whole")), df[text] == F.col("_whole"), "left").drop("_whole")


def with_found(texts: DataFrame, text: str = "text", steps: tuple = STEPS) -> DataFrame:
    """texts, each of which should stand there once, with _text (corrected; a null one stays null) and _found: what was corrected, in order."""
    rows = texts.withColumns({"_text": F.col(text), "_found": F.array().cast(_FOUND)})
    for step in steps:
        rows = step(rows)
    return rows.select(*texts.columns, "_text", F.coalesce("_found", F.array().cast(_FOUND)).alias("_found"))


def with_corrections(df: DataFrame, text: str = "text", confidence: str = "confidence", steps: tuple = STEPS) -> DataFrame:
    """df with corrected, kinds (of what was corrected, in order) and corrected_confidence.

    The confidence is the mean of the row's own and that of what was corrected, between 0.1 and 0.99; the row's own
    where nothing was. A null text stays null with no kinds; an empty one stays empty. Every distinct text is corrected once.
    """
    named = once(df, text, lambda texts: with_found(texts, "_whole", steps))
    found, own = F.coalesce("_found", F.array().cast(_FOUND)), F.col(confidence)
    mean = F.aggregate(found, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(found)
    sure = F.when(F.size(found) == 0, own).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.1), (own + mean) / 2)))
    return named.select(*[F.col(c) for c in df.columns], F.col("_text").alias("corrected"), F.transform(found, lambda x: x["kind"]).alias("kinds"), sure.alias("corrected_confidence"))


def respelt(text: Column) -> Column:
    """A text after the table of spellings and the formats, in their order.

    A spelling of two characters or more is put right wherever it stands, a single character only as the whole text. Texts that hold no
    wrong spelling are passed over by one search for all of them.
    """
    pairs = [(w, r) for r, wrong in SPELLINGS.items() for w in wrong.split()]
    table = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right")) for w, r in pairs])
    any_wrong = "|".join(rf"\Q{w}\E" for w, _ in pairs if len(w) > 1)
    rule = lambda t, e: F.when((t == e["wrong"]) | (F.char_length(e["wrong"]) > 1), F.replace(t, e["wrong"], e["right"])).otherwise(t)
    out = let(text, lambda t: F.when((F.char_length(t) <= 1) | t.rlike(any_wrong), F.aggregate(table, t, rule)).otherwise(t))
    for pattern, written in FORMATS:
        out = F.regexp_replace(out, pattern, written)
    return out
