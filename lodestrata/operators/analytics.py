"""Typed table analytics: checks before any job, single metrics, groups, several aggregates, description, sorts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
ALIAS = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")


class InvalidOperation(ValueError):
    """An operation that does not fit the table's columns."""


def kind(field: T.StructField) -> str:
    return "number" if isinstance(field.dataType, T.NumericType) else "boolean" if isinstance(field.dataType, T.BooleanType) else "string"


def validate_op(schema: T.StructType, op: dict, max_limit: int = 1000) -> None:
    """FIL6: raise unless columns exist, targets are numeric, and key, aggregate and row limits hold."""
    kinds = {f.name: kind(f) for f in schema.fields}
    aggs = op.get("aggs", [])
    keys = list(op.get("keys", []))
    named = keys + [a["field"] for a in aggs if a.get("field")] + [f for f, *_ in op.get("sort", [])] + list(op.get("columns") or [])
    if unknown := [c for c in named if c not in kinds]:
        raise InvalidOperation(f"unknown columns: {', '.join(unknown)}")
    if op.get("grouped") and not 1 <= len(keys) <= 3 or len(keys) > 3:
        raise InvalidOperation("one to three group columns are allowed")
    if not len(aggs) <= 10:
        raise InvalidOperation("at most ten aggregates are allowed")
    for a in aggs:
        if a["fn"] != "count" and not a.get("field"):
            raise InvalidOperation(f"{a['fn']} needs a column")
        if a["fn"] != "count" and kinds[a["field"]] != "number":
            raise InvalidOperation(f"{a['field']} is not numeric")
        if not ALIAS.fullmatch(a.get("alias", "x")):
            raise InvalidOperation(f"bad alias: {a['alias']}")
    if not 1 <= op.get("limit", 1) <= max_limit:
        raise InvalidOperation(f"limit must be 1 to {max_limit}")


OPERATION = "op_id string, grouped boolean, keys array<string>, aggs array<struct<fn: string, field: string, alias: string>>, sort array<string>, columns array<string>, `limit` int"


def check_operations(operations: DataFrame, schema: DataFrame, max_limit: int = 1000) -> DataFrame:
    """FIL6 over rows: op_id, reason (null if the operation fits), detail (the columns that do not, sorted).

    operations: rows of OPERATION, whose lists may be null; schema: name, data_type of one table, as infer_schema gives them. The first rule
    that is broken is the reason: names, numbers of keys and aggregates, aggregates without a column, numeric columns, aliases, limit.
    """
    kinds = schema.agg(F.map_from_entries(F.collect_list(F.struct("name", "data_type"))).alias("_kinds"))  # one row, of a table's columns
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    aggs = F.coalesce(F.col("aggs"), F.array().cast("array<struct<fn: string, field: string, alias: string>>"))
    ready = operations.crossJoin(F.broadcast(kinds)).withColumns({"_keys": listed("keys"), "_aggs": aggs})
    kind = lambda name: F.try_element_at("_kinds", name)
    fields = F.filter(F.transform("_aggs", lambda a: a["field"]), lambda f: f.isNotNull())
    named = F.concat("_keys", fields, listed("sort"), listed("columns"))
    unknown = F.array_sort(F.array_distinct(F.filter(named, lambda c: kind(c).isNull())))
    summed = F.filter("_aggs", lambda a: (a["fn"] != "count") & a["field"].isNotNull())
    text = F.array_sort(F.array_distinct(F.filter(F.transform(summed, lambda a: a["field"]), lambda c: kind(c) != "number")))
    ready = ready.withColumns({"_unknown": unknown, "_text": text, "_size": F.size("_keys")})
    reason = (
        F.when(F.size("_unknown") > 0, "UNKNOWN_COLUMN")
        .when((F.col("_size") > 3) | (F.coalesce("grouped", F.lit(False)) & (F.col("_size") < 1)), "BAD_GROUPING")
        .when(F.size("_aggs") > 10, "TOO_MANY_AGGREGATES")
        .when(F.exists("_aggs", lambda a: (a["fn"] != "count") & a["field"].isNull()), "COLUMN_REQUIRED")
        .when(F.size("_text") > 0, "NOT_NUMERIC")
        .when(F.exists("_aggs", lambda a: a["alias"].isNotNull() & ~a["alias"].rlike(f"^(?:{ALIAS.pattern})$")), "BAD_ALIAS")
        .when(~F.coalesce(F.col("limit"), F.lit(1)).between(1, max_limit), "BAD_LIMIT")
    )
    wrong = F.when(F.size("_unknown") > 0, F.col("_unknown")).when(F.col("reason") == "NOT_NUMERIC", F.col("_text"))
    return ready.withColumn("reason", reason).select("op_id", "reason", F.array_join(F.coalesce(wrong, none), ",").alias("detail"))


def infer_schema(df: DataFrame) -> DataFrame:
    """SRC2: name, data_type, nullable of text columns, over all rows in one pass.

    Numbers are finite decimals in Spark's syntax; NaN and the like make a column text.
    """
    def facts(c: str) -> Column:
        v = F.col(f"`{c}`")
        number = v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
        boolean = F.lower(F.trim(v)).isin("true", "false")
        return F.struct(F.lit(c).alias("name"), F.count(v).alias("n"), F.coalesce(F.bool_and(number), F.lit(False)).alias("number"), F.coalesce(F.bool_and(boolean), F.lit(False)).alias("boolean"), F.count(F.lit(1)).alias("rows"))

    found = df.agg(F.array(*[facts(c) for c in df.columns]).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    data_type = F.when(F.col("n") == 0, "string").when(F.col("number"), "number").when(F.col("boolean"), "boolean").otherwise("string")
    return found.select("name", data_type.alias("data_type"), (F.col("n") < F.col("rows")).alias("nullable"))


def apply_schema(df: DataFrame, schema: DataFrame, scale: int = 6) -> DataFrame:
    """Text columns by the inferred types: numbers as decimal(38, scale)."""
    kinds = {r["name"]: r["data_type"] for r in schema.collect()}  # a row per column
    to = {"number": f"decimal(38,{scale})", "boolean": "boolean", "string": "string"}
    return df.select(*[F.col(f"`{c}`").try_cast(to[kinds[c]]).alias(c) for c in df.columns])


def count_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    """AGG1."""
    return df.agg(F.count(column or F.lit(1)).alias("value"))


def single_metric(df: DataFrame, fn: str, column: str, strict: bool = False) -> DataFrame:
    """AGG2: nulls are skipped. strict: raise where there is no value."""
    validate_op(df.schema, {"aggs": [{"fn": fn, "field": column}]})
    out = df.agg(FUNCTIONS[fn](column).alias("value"))
    if strict and out.head()[0] is None:
        raise InvalidOperation(f"{column} has no values")
    return out


def key_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def group_by(df: DataFrame, keys: list[str], fn: str = "count", field: str | None = None, limit: int = 100, max_limit: int = 1000) -> DataFrame:
    """AGG3: keys as text, null as the empty text, ordered by key; group_count counts all groups, returned_rows those left."""
    validate_op(df.schema, {"grouped": True, "keys": keys, "aggs": [{"fn": fn, "field": field}], "limit": limit}, max_limit)
    name = "count" if fn == "count" else f"{fn}_{field}"
    value = F.count(field or F.lit(1)) if fn == "count" else FUNCTIONS[fn](field)
    groups = df.groupBy(*[key_text(k).alias(k) for k in keys]).agg(value.alias(name))
    total = groups.agg(F.count(F.lit(1)).alias("group_count"))
    return groups.orderBy(*keys).limit(limit).crossJoin(F.broadcast(total)).withColumn("returned_rows", F.least(F.col("group_count"), F.lit(limit)))


def aggregate(df: DataFrame, aggs: list[dict], keys: tuple[str, ...] = (), limit: int = 100, max_limit: int = 1000) -> DataFrame:
    """AGG4: aliased aggregates of groups, or of all rows."""
    validate_op(df.schema, {"keys": list(keys), "aggs": aggs, "limit": limit}, max_limit)
    columns = [(F.count(a.get("field") or F.lit(1)) if a["fn"] == "count" else FUNCTIONS[a["fn"]](a["field"])).alias(a["alias"]) for a in aggs]
    if not keys:
        return df.agg(*columns)
    return df.groupBy(*[key_text(k).alias(k) for k in keys]).agg(*columns).orderBy(*keys).limit(limit)


def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """AGG5: type, counts of values and of distinct values, and the numbers' range and mean, per column.

    Columns are unpivoted and grouped twice, so exact distinct counts need no row per column and distinct set.
    """
    validate_op(df.schema, {"columns": columns})
    columns = columns or df.columns
    fields = {f.name: f for f in df.schema.fields}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "text").where("text is not null")
    numeric = [c for c in columns if kind(fields[c]) == "number"]
    number = F.when(F.col("column").isin(numeric), F.col("text").try_cast("double")) if numeric else F.lit(None).cast("double")
    if approx:
        found = long.groupBy("column").agg(F.count("*").alias("non_null_count"), F.approx_count_distinct("text").alias("unique_count"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"))
    else:
        values = long.groupBy("column", "text").agg(F.count("*").alias("n")).withColumn("v", number)
        found = values.groupBy("column").agg(F.sum("n").alias("non_null_count"), F.count("*").alias("unique_count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mean"))
    names = df.sparkSession.createDataFrame([(c, kind(fields[c])) for c in columns], "column string, data_type string")
    return names.join(found, "column", "left").select("column", "data_type", F.coalesce("non_null_count", F.lit(0)).alias("non_null_count"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "min", "max", "mean")


def tied(column: str | None) -> list[Column]:
    return [F.col(column)] if column else []


def sort_rows(df: DataFrame, fields: list[tuple[str, str]], limit: int = 100, tie: str | None = None, max_limit: int = 1000) -> DataFrame:
    """SRT1: nulls last either way, texts by lower case; equal rows by `tie`."""
    validate_op(df.schema, {"sort": fields, "limit": limit}, max_limit)
    kinds = {f.name: kind(f) for f in df.schema.fields}
    by = [F.lower(c) if kinds[c] == "string" else F.col(c) for c, _ in fields]
    order = [c.desc_nulls_last() if way == "desc" else c.asc_nulls_last() for c, (_, way) in zip(by, fields, strict=True)]
    return df.orderBy(*order, *tied(tie)).limit(limit)


def top_n(df: DataFrame, column: str, n: int, tie: str | None = None, max_limit: int = 1000) -> DataFrame:
    """SRT2: the n rows of the largest numbers; nulls fill up."""
    validate_op(df.schema, {"aggs": [{"fn": "max", "field": column}], "limit": n}, max_limit)
    return df.orderBy(F.col(column).desc_nulls_last(), *tied(tie)).limit(n)


def list_recent(df: DataFrame, n: int | None = None, created: str = "created_at", key: str = "id") -> DataFrame:
    """SRT3: newest first, then the largest id."""
    out = df.orderBy(F.col(created).desc(), F.col(key).desc())
    return out if n is None else out.limit(n)

