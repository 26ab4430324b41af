"""Bundles of JSON rows whose fields are known in part: declared fields become columns, all others are kept as one VARIANT column.

Nothing is lost on the way in and out: an import tells good rows from rejected ones with a reason, and an export writes declared and other fields together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EXTRA = "extra"
REASON = "reason"
_FIELDS = "map<string,variant>"


def _schema(df: DataFrame, schema: str) -> StructType:
    return df.sparkSession.createDataFrame([], schema).schema


def parsed(lines: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema``, extra (VARIANT: all fields that ``schema`` does not name, null if there are none) and reason of each row of ``lines`` (value: a JSON text).

    The reason is null for a good row. Other rows say why they are none: no JSON, no object, a required field that is missing or null, or a value that does not fit the
    declared type. A field that is missing and not required is null. Blank lines are passed over; of a field given twice JSON text is no good.
    """
    fields = _schema(lines, schema).fields
    known = [f.name for f in fields]
    rows = lines.filter(F.col("value").rlike(r"\S")).select(F.try_parse_json("value").alias("v"), "value")
    kind = F.schema_of_variant("v")
    opened = rows.select("value", "v", F.when(kind.startswith("OBJECT"), F.col("v").cast(_FIELDS)).alias("fields"))
    there = lambda f: F.coalesce(F.map_contains_key("fields", F.lit(f.name)) & ~F.is_variant_null(F.element_at("fields", f.name)), F.lit(False))
    value = lambda f: F.try_variant_get(F.element_at("fields", f.name), "$", f.dataType.simpleString())
    reason = F.when(F.col("v").isNull(), "not JSON").when(F.col("fields").isNull(), "not an object")
    for f in fields:
        if f.name in required:
            reason = reason.when(~there(f), f"missing {f.name}")
    for f in fields:
        reason = reason.when(there(f) & value(f).isNull(), f"{f.name} is no {f.dataType.simpleString()}")
    others = F.map_filter("fields", lambda k, _: ~k.isin(known))
    extra = F.when(F.cardinality(others) > 0, F.to_variant_object(others))
    return opened.select(*(value(f).alias(f.name) for f in fields), extra.alias(EXTRA), reason.alias(REASON))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without their reason, and how many were rejected for which reason."""
    return rows.filter(F.col(REASON).isNull()).drop(REASON), rows.filter(F.col(REASON).isNotNull()).groupBy(REASON).agg(F.count(F.lit(1)).alias("n"))


def lines_of(rows: DataFrame) -> DataFrame:
    """value: each row as JSON text, its columns and the fields of extra side by side; null columns are left out."""
    known = [c for c in rows.columns if c != EXTRA]
    own = F.map_filter(F.to_variant_object(F.struct(*known)).cast(_FIELDS), lambda _, v: ~F.is_variant_null(v))
    more = F.coalesce(F.col(EXTRA).cast(_FIELDS), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    return rows.select(F.to_json(F.to_variant_object(F.map_concat(own, more))).alias("value"))


def discovered(lines: DataFrame) -> str:
    """The schema that holds all readable rows of ``lines`` (value), as Spark writes it: what a first import can declare."""
    return lines.select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL").agg(F.schema_of_variant_agg("v")).first()[0]


def field(path: str, kind: str) -> Column:
    """A value inside the fields that were not declared, null where it is missing or of another kind."""
    return F.try_variant_get(F.col(EXTRA), path, kind)
