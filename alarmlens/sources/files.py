"""Readers and writers of telemetry files: CSV with a schema, matrices, interval lists, Markdown tables, and named artifacts."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform, uniform_sql
from alarmlens.operators import studies

SAMPLES = "channel string, segment long, timestamp timestamp_ntz, value double, sampling double, anomaly int, train int"
SEGMENTS = "segment long, anomaly int, train int, sampling double"


class MissingInput(FileNotFoundError):
    """An input is not there; the message says which."""


def existing(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingInput(f"no input at {path}") from error
        raise


def read_csv(spark: SparkSession, path: str, schema: str = SAMPLES, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, by name and type; unparsable values are null. Only the columns asked for are parsed."""
    rows = existing(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv, path)
    return rows.select(*columns) if columns else rows


def read_samples(spark: SparkSession, samples: str, segments: str | None = None) -> DataFrame:
    """Samples with their index t inside the segment, joined with the segments' labels where these are in a file of their own (each segment once)."""
    rows = read_csv(spark, samples)
    if segments:
        rows = studies.enriched(rows.drop("anomaly", "train", "sampling"), read_csv(spark, segments, SEGMENTS), "segment")
    order = Window.partitionBy("channel", "segment").orderBy("timestamp", "value")
    return rows.withColumn("t", (F.row_number().over(order) - 1).cast("long"))


def synthetic(spark: SparkSession, segments: int = 40, length: int = 60, seed: str = "42") -> DataFrame:
    """Random walks of a quantised and of a float-noise channel; every fifth segment's variance surges at its middle. The same on any partitioning."""
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(step).alias("step"), F.lit(sd).alias("sd")) for c, step, sd in _CHANNELS])).alias("c")
    rows = spark.range(segments).select(F.col("id").alias("segment"), channels).select("segment", "c.*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("t"))
    u, v = uniform(f"{seed}-u", "channel", "segment", "t"), uniform(f"{seed}-v", "channel", "segment", "t")
    normal = F.sqrt(-2 * F.ln(u + 1e-12)) * F.cos(2 * np.pi * v)
    anomaly = F.when(F.col("segment") % 5 == 0, 1).otherwise(0)
    step = normal * F.col("sd") * F.when((anomaly == 1) & (F.col("t") >= length // 2), 8.0).otherwise(1.0)
    walk = F.sum(step).over(Window.partitionBy("channel", "segment").orderBy("t"))
    value = F.when(F.col("step") > 0, F.bround(walk / F.col("step")) * F.col("step")).otherwise(walk)
    return rows.select("channel", "segment", "t", value.alias("value"), anomaly.alias("anomaly"), F.when(F.col("segment") % 4 != 0, 1).otherwise(0).alias("train"))


_CHANNELS = (("SYN_FLOAT", 0.0, 5e-11), ("SYN_QUANT", 0.0026, 0.004))
SYNTHETIC_SQL = f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {s}::DOUBLE, {d}::DOUBLE)" for c, s, d in _CHANNELS)}) v(channel, step, sd)),
r AS (SELECT channel, step, sd, segment, t, sqrt(-2 * ln({uniform_sql('42-u', 'channel', 'segment', 't')} + 1e-12)) * cos(2 * pi() * {uniform_sql('42-v', 'channel', 'segment', 't')}) AS x FROM c, range(0, 40) a(segment), range(0, 60) b(t)),
w AS (SELECT *, sum(x * sd * CASE WHEN segment % 5 = 0 AND t >= 30 THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END) OVER (PARTITION BY channel, segment ORDER BY t) AS walk FROM r)
SELECT channel, segment, t, round(CASE WHEN step > 0 THEN round_even(walk / step, 0) * step ELSE walk END * 1e9::DOUBLE, 3) + 0 AS nano_value, CASE WHEN segment % 5 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS anomaly, CASE WHEN segment % 4 <> 0 THEN 1::BIGINT ELSE 0::BIGINT END AS train FROM w"""


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """(channel, t, value): the first column of each matrix file; a file is read whole by one task, as its format requires."""
    files = existing(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = np.asarray(x if x.ndim == 1 else x[:, 0], float)
                yield pa.RecordBatch.from_pydict({"channel": [name] * len(x), "t": np.arange(len(x)), "value": x})

    channel = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    return files.select(channel.alias("channel"), "content").mapInArrow(run, "channel string, t long, value double")


def read_matrix(spark: SparkSession, path: str, columns: int = 38) -> DataFrame:
    """(machine, dimension, row, value) of comma-separated matrices without a header, one file a machine. row counts lines of a file by their place in it."""
    names = [f"d{i}" for i in range(columns)]
    rows = existing(spark.read.schema(", ".join(f"{c} double" for c in names)).csv, path)
    machine = F.regexp_extract("_metadata.file_path", r"([^/]+)\.\w+$", 1)
    placed = rows.select(machine.alias("machine"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"), *names)
    numbered = placed.withColumn("row", (F.row_number().over(Window.partitionBy("machine").orderBy("file_block_start", "place")) - 1).cast("long"))
    return numbered.select("machine", "row", F.posexplode(F.array(*names)).alias("dimension", "value"))


def interval_rows(rows: DataFrame, column: str) -> DataFrame:
    """rows with their list of intervals, as text like [[1, 5], [9, 12]], one interval a row (first, last)."""
    parsed = F.from_json(F.col(column), "array<array<long>>")
    return rows.withColumn("interval", F.explode(parsed)).withColumn("first", F.col("interval")[0]).withColumn("last", F.col("interval")[1]).drop("interval", column)


def markdown_table(spark: SparkSession, path: str, heading: str, nth: int = 0) -> DataFrame:
    """(row, cells): the rows, without header and rule, of the nth table of pipes after a heading. A file is one group."""
    lines = existing(lambda p: spark.read.text(p, wholetext=True), path).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    order = Window.partitionBy(F.lit(0)).orderBy("line")  # a document's lines
    text = F.trim("text")
    marked = lines.select("line", text.alias("text"), text.startswith("|").alias("piped"), (F.trim(F.regexp_replace(text, "^#+", "")) == heading).alias("at"))
    after = marked.withColumn("after", F.max("at").over(order)).where("after")
    tables = after.withColumn("begins", F.col("piped") & ~F.coalesce(F.lag("piped").over(order), F.lit(False))).withColumn("number", F.sum(F.col("begins").cast("int")).over(order) - 1).where("piped")
    rows = tables.where(F.col("number") == nth).withColumn("row", F.row_number().over(Window.partitionBy("number").orderBy("line")) - 3).where("row >= 0")
    cells = F.transform(F.split(F.regexp_replace("text", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("row", cells.alias("cells"))


def number(text: Column) -> Column:
    """A number after stripping emphasis, thousands separators and percent signs; a minus sign of typography counts. Null if there is none."""
    plain = F.translate(F.translate(text, "−", "-"), "*,%", "")
    return F.regexp_extract(plain, r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def interval(text: Column) -> Column:
    """point, low and high of text like `0.5 [0.4, 0.6]`."""
    parts = [F.regexp_extract(F.translate(text, "−*", "-"), r"([-+.\deE]+)\s*\[\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)\s*\]", i).try_cast("double") for i in (1, 2, 3)]
    return F.struct(parts[0].alias("point"), parts[1].alias("low"), parts[2].alias("high"))


def scientific(text: Column) -> Column:
    """a times ten to the b, where b is written in superscript digits; other numbers as number() has them."""
    plain = F.translate(text, "−⁻⁰¹²³⁴⁵⁶⁷⁸⁹*", "--0123456789")
    a, b = (F.regexp_extract(plain, r"([-+]?\d+(?:\.\d+)?)\s*[×x]\s*10\^?(-?\d+)", i).try_cast("double") for i in (1, 2))
    return F.coalesce(a * F.pow(F.lit(10.0), b), number(text))


def save(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> str:
    """An artifact as parquet, csv (with a header) or json rows, replacing one of that name; its path."""
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": writer.option("header", True).csv, "json": writer.json}[kind](path)
    return path


def save_onsets(draws: DataFrame, folder: str, name: str = "onset_draws") -> str:
    """Draws by channel, so that readers of one channel skip the others."""
    path = f"{folder}/{name}"
    draws.write.mode("overwrite").partitionBy("channel").parquet(path)
    return path


def summary_json(scope: DataFrame) -> DataFrame:
    """One row: the scope table (a row a channel) as JSON, with included and excluded channels and their number."""
    included = F.sort_array(F.collect_list(F.when(F.col("scope") == "included", F.col("channel"))))
    excluded = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("scope") != "included", F.struct("channel", "scope")))))
    rows = scope.agg(included.alias("included_channels"), excluded.alias("excluded_channels"), F.count_if(F.col("scope") == "included").alias("n_included"))
    return rows.select(F.to_json(F.struct("*")).alias("json"))

