"""Metadata suggested from a file's name and the beginning of its text, and its merge with what users confirm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import stem

# Rules in order of precedence, with the words that trigger them.
DOC_TYPES = (
    ("维修记录", ("维修", "报修", "工单", "故障")),
    ("采购合同", ("采购", "合同", "招标", "报价")),
    ("规章制度", ("制度", "规章", "管理办法", "第", "条")),
    ("设备手册", ("手册", "操作", "说明书", "培训")),
)
DEPARTMENTS = (("医工", ("医工", "设备科")), ("后勤", ("后勤", "运维", "保洁", "医废")))
OTHER = "其他"
MODEL = r"([A-Z]{1,6}[-_ ]?\d{2,6}[A-Z0-9-]*)"
DATE = r"(20\d{2})[-年./](\d{1,2})(?:[-月./](\d{1,2}))?"
SAMPLE_CHARS = 3000


def _first_rule(text: Column, rules: tuple, otherwise: str | None) -> Column:
    out = F.lit(otherwise).cast("string")
    for name, words in reversed(rules):
        out = F.when(F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False)), name).otherwise(out)
    return out


def suggest(file_name: Column, sample: Column) -> Column:
    """struct(title, doc_type, department, equipment_model, effective_date, source)."""
    text = F.concat(file_name, F.lit("\n"), F.substring(F.coalesce(sample, F.lit("")), 1, SAMPLE_CHARS))
    model = F.replace(F.regexp_extract(text, MODEL, 1), F.lit(" "), F.lit(""))
    year, month, day = (F.regexp_extract(text, DATE, k) for k in (1, 2, 3))
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.coalesce(F.nullif(day, F.lit("")), F.lit("01")), 2, "0"))
    return F.struct(
        stem(file_name).alias("title"), _first_rule(text, DOC_TYPES, OTHER).alias("doc_type"), _first_rule(text, DEPARTMENTS, None).alias("department"),
        F.nullif(model, F.lit("")).alias("equipment_model"), F.when(year != "", date).alias("effective_date"), F.lit("heuristic").alias("source"),
    )


def confirmed_or(confirmed: Column, suggested: Column) -> Column:
    """What was confirmed, unless it is empty."""
    return F.coalesce(F.nullif(confirmed, F.lit("")), suggested)
