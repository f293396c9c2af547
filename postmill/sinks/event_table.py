"""Stored tables of events whose schema is found from the data and follows it.

Each load brings the JSON lines of an event. Their schema is one aggregate over all of them (merged
in every task first, while they are staged) and is merged with that of the loads before: new fields are added,
also nested ones; where a type changed, the stored one stays, the change is listed as drift and the
lines of that load are kept beside the typed post. Rows are Parquet by event and day, so SQL over
one day of an event reads that folder, and of it the columns that are asked for.

``<path>/rows|schema|drift|bad/load=<number>/``: a load that is repeated replaces itself, and is
seen once its schema is written, which comes last.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.times import created_ms
from postmill.session import scratch_folder

SCHEMAS = "schema string"
LINES = "value string, good boolean"
DRIFT = "field string, kind string, stored string, seen string"
ADDED, CHANGED = "added", "changed"
# Names in back quotes stay as they are; what follows are the type names of variants.
_TYPES = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<>|\bOBJECT(?=<)|\bVARIANT\b(?!:)|\bDECIMAL\(\d+,\d+\)")
_AS = {"OBJECT<>": "STRING", "OBJECT": "STRUCT", "VARIANT": "STRING"}


def detect_schema(lines: DataFrame, value: str = "value") -> T.StructType:
    """Fields of JSON objects, in one pass; fields that are null or empty everywhere are left out.

    Numbers with a fraction are doubles, fields of several types texts.
    """
    return _fields(lines.agg(F.schema_of_variant_agg(_object(F.col(value))).alias("s")).first().s)


def _object(value: Column) -> Column:
    """The JSON object of a line; null if it holds none."""
    return F.when(F.startswith(F.ltrim(value), F.lit("{")), F.try_parse_json(value))


def _fields(found: str | None) -> T.StructType:
    """The fields that ``schema_of_variant_agg`` found."""
    if not found or not found.startswith("OBJECT<") or found == "OBJECT<>":
        return T.StructType()
    ddl = _TYPES.sub(lambda m: m[0] if m[0].startswith("`") else _AS.get(m[0], "DOUBLE"), found)
    return _known(T.StructType.fromDDL(ddl)) or T.StructType()


def _known(kind: T.DataType) -> T.DataType | None:
    """A type without the parts of which nothing is known."""
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, k) for f in kind.fields if (k := _known(f.dataType)) is not None]
        return T.StructType(fields) if fields else None
    if isinstance(kind, T.ArrayType):
        inner = _known(kind.elementType)
        return None if inner is None else T.ArrayType(inner)
    return None if isinstance(kind, T.NullType) else kind


def merge_types(stored: T.DataType, seen: T.DataType, field: str = "") -> tuple[T.DataType, list[tuple[str, str, str | None, str]]]:
    """(merged type, drift rows); field names are compared without case, as Spark's reader does."""
    if isinstance(stored, T.StructType) and isinstance(seen, T.StructType):
        fields, drift = list(stored.fields), []
        place = {f.name.lower(): i for i, f in enumerate(fields)}
        for f in seen.fields:
            at, name = place.get(f.name.lower()), f"{field}.{f.name}".lstrip(".")
            if at is None:
                place[f.name.lower()] = len(fields)
                fields.append(f)
                drift.append((name, ADDED, None, f.dataType.simpleString()))
            else:
                kind, more = merge_types(fields[at].dataType, f.dataType, name)
                fields[at] = T.StructField(fields[at].name, kind)
                drift += more
        return T.StructType(fields), drift
    if isinstance(stored, T.ArrayType) and isinstance(seen, T.ArrayType):
        kind, drift = merge_types(stored.elementType, seen.elementType, f"{field}[]")
        return T.ArrayType(kind), drift
    # Whole numbers fit where fractions are stored, and texts take anything.
    if stored == seen or isinstance(stored, T.StringType) or (isinstance(stored, T.DoubleType) and isinstance(seen, T.LongType)):
        return stored, []
    return stored, [(field, CHANGED, stored.simpleString(), seen.simpleString())]


def load_lines(spark: SparkSession, path: str, event: str, lines: DataFrame, load: int) -> list[tuple[str, str, str | None, str]]:
    """Store the JSON lines (``value``) of an event as load number ``load``; returns its drift.

    The lines are worked out once, with their schema on the way, and kept until the load is stored.
    """
    with scratch_folder(spark, "event-lines") as folder:
        seen = Observation()
        parsed = lines.where(F.trim("value") != "").select("value", _object(F.col("value")).alias("object"))
        parsed = parsed.observe(seen, F.schema_of_variant_agg("object").alias("fields"))
        parsed.select("value", F.col("object").isNotNull().alias("good")).write.parquet(folder)
        return _store(spark, path, event, spark.read.schema(LINES).parquet(folder), _fields(seen.get["fields"]), load)


def _store(spark: SparkSession, path: str, event: str, lines: DataFrame, seen: T.StructType, load: int) -> list[tuple[str, str, str | None, str]]:
    before = _schema(spark, path, load)
    schema, drift = merge_types(before or T.StructType(), seen)
    lines.where("not good").select("value").write.mode("overwrite").text(f"{path}/bad/load={load}")
    changed = any(kind == CHANGED for _, kind, *_ in drift)
    post = F.from_json("value", schema) if schema.fields else F.lit(None).cast("struct<none:string>")
    created = next((f.name for f in schema.fields if f.name == "created_at"), None)
    day = F.date_format(F.timestamp_millis(created_ms(F.col(f"post.{created}"))), "yyyy-MM-dd") if created else F.lit(None).cast("string")
    rows = lines.where("good").select(post.alias("post"), (F.col("value") if changed else F.lit(None).cast("string")).alias("line"))
    rows = rows.select(F.lit(event).alias("event"), day.alias("day"), "post", "line")
    # A day is one file, a busy one as many as it fills.
    rows.hint("rebalance", "event", "day").write.mode("overwrite").partitionBy("event", "day").parquet(f"{path}/rows/load={load}")
    listed = drift if before else []
    spark.createDataFrame(listed, DRIFT).coalesce(1).write.mode("overwrite").parquet(f"{path}/drift/load={load}")
    spark.createDataFrame([(schema.json(),)], SCHEMAS).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema/load={load}")
    return listed


def _loads(spark: SparkSession, path: str) -> dict[int, str]:
    """Schema of every complete load: one short row each."""
    try:
        rows = spark.read.schema(f"{SCHEMAS}, load bigint").parquet(f"{path}/schema").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.load: r.schema for r in rows}


def _schema(spark: SparkSession, path: str, before: int | None = None) -> T.StructType | None:
    """The schema of the newest load, or of the newest one before a load."""
    loads = {n: s for n, s in _loads(spark, path).items() if before is None or n < before}
    return T.StructType.fromJson(json.loads(loads[max(loads)])) if loads else None


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(event, day, post, line) of all complete loads; older rows have null for newer fields."""
    loads, post = _loads(spark, path), _schema(spark, path)
    if post is None:
        raise FileNotFoundError(f"no events stored below {path}")
    schema = T.StructType([T.StructField("post", post), T.StructField("line", T.StringType())])
    schema = schema.add("load", "long").add("event", "string").add("day", "string")
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/load={n}" for n in sorted(loads)])
    return rows.select("event", "day", "post", "line")


def drift_report(spark: SparkSession, path: str) -> DataFrame:
    """(load, field, kind, stored, seen): what each load changed, from the second one on."""
    return spark.read.schema(f"{DRIFT}, load bigint").parquet(f"{path}/drift").select("load", "field", "kind", "stored", "seen")


def register_events(spark: SparkSession, path: str, name: str) -> str:
    """A view of the fields of posts, with ``_event`` and ``_day``, for SQL; it follows later loads when registered again."""
    rows = read_events(spark, path)
    rows.select(F.col("event").alias("_event"), F.col("day").alias("_day"), F.col("line").alias("_line"), "post.*").createOrReplaceTempView(name)
    return name
