"""Readers for the toolkit's file formats. Every reader declares its schema
(no inference pass) and returns a DataFrame; reading is parallel over files
and, for line-delimited JSON, within files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MD_SAMPLE_MARKER, SCORE_ALIASES, SCORE_FIELDS
from ..session import materialize
from ..operators.shape import normalize_records

CORRUPT = "_corrupt_record"

RAW_SCHEMA = T.StructType([
    T.StructField("instance_id", T.LongType()),
    T.StructField("original_content", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("summary", T.StringType()),
])

JUDGEMENT_SCHEMA = "task string, pair_id long, pair_ids array<long>, win string, why string"
SCORES_SCHEMA = "task string, id long, score double"


def rated_schema(fields=SCORE_FIELDS, extra=("uuid", "dataset")) -> T.StructType:
    """Enriched rating records: scores arrive as number or string, so they are
    read as strings and cleaned later (a DOUBLE schema would null a quoted
    "7")."""
    names = list(extra) + list(fields) + list(SCORE_ALIASES)
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TAGGED_SCHEMA = ("uuid string, dataset string, first_level_tag string, second_level_tag string, "
                 "third_level_tag string, in_tree boolean")


def _json(spark: SparkSession, path, schema) -> DataFrame:
    """JSON lines; a line that does not parse is kept in ``_corrupt_record``."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return (spark.read.schema(T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())]))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _with_status(df: DataFrame, bad=None, known: tuple[str, ...] = ()) -> DataFrame:
    """``status``: ``corrupt`` for rows of broken lines (their fields are null, but for
    ``known`` ones, which don't come from the line)."""
    wrong = F.col(CORRUPT).isNotNull()
    status = F.when(wrong if bad is None else wrong | bad, "corrupt").otherwise("ok")
    fields = [F.col(f"`{c}`") if c in known else F.when(~wrong, F.col(f"`{c}`")).alias(c)
              for c in df.columns if c != CORRUPT]
    return df.select(*fields, CORRUPT, status.alias("status"))


def read_records(spark: SparkSession, path: str | list[str], schema, dataset: str | None = None,
                 dataset_from_path: bool = False, rejects: bool = True) -> DataFrame:
    """JSON records (one per line) with a declared schema. ``dataset`` sets the
    column; ``dataset_from_path`` takes the parent directory name. A
    ``dataset=...`` partition directory is picked up as a column by Spark.
    ``_corrupt_record`` and ``status`` tell broken lines (``corrupt``: null fields, the
    line kept, the dataset known) from records without values (``ok``); without
    ``rejects`` these columns are left out, and a broken line is a row of nulls."""
    df = _json(spark, path, schema) if rejects else spark.read.schema(schema).json(path)
    if dataset is not None:
        df = df.withColumn("dataset", F.lit(dataset))
    elif dataset_from_path:
        df = df.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"),
                                                       r"([^/]+)/[^/]+$", 1))
    if not rejects:
        return df
    given = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    elsewhere = tuple(c for c in df.columns if c not in given.fieldNames())
    return _with_status(df, known=elsewhere if dataset is None and not dataset_from_path
                        else (*elsewhere, "dataset"))


def read_raw_jsonl(spark: SparkSession, path: str, extra_schema: T.StructType | None = None) -> DataFrame:
    """Raw JSONL documents normalised to one ``text`` column. Bad lines are
    kept in ``_corrupt_record`` (with null fields) instead of failing."""
    fields = RAW_SCHEMA.fields + (extra_schema.fields if extra_schema else [])
    schema = T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    return normalize_records(df)


def read_raw_txt(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines stored as ``.txt`` whose ``original_content`` is a JSON string.
    A line that is no such record keeps null fields and stands in
    ``_corrupt_record``."""
    schema = "instance_id long, original_content string"
    return normalize_records(_json(spark, path, schema))


def read_md_samples(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files of sample blocks: a line starting with the sample marker
    opens a block (the rest of that line is returned as ``label``); lines are
    stripped and re-joined by newline, the block is stripped, empty blocks are
    dropped. ``(file, block, label, text)``; block 0 is what stands before a file's
    first marker.

    Records are separated by newline plus marker, so that Spark splits inside files:
    a large file is read by several tasks. Blocks are numbered by their place: rows
    of a split are counted, and the counts of a file's splits summed up before them."""
    marker = MD_SAMPLE_MARKER
    rows = materialize(
        spark.read.option("lineSep", "\n" + marker).text(path)
        .select(F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"), "value")
        .withColumn("row", F.monotonically_increasing_id()))
    # one row per split; the first record of a file has no separator before it
    opens = F.col("value").startswith(marker)
    splits = rows.groupBy("file", "start").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("n"),
        F.min_by(opens, F.col("row")).alias("opens"))
    order = Window.partitionBy("file").orderBy("start")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"),
                           F.first("opens").over(order).alias("opens"))
    placed = rows.join(splits, ["file", "start"]).withColumn(
        "at", F.col("row") - F.col("first") + F.col("before"))
    head, leads = F.col("at") == 0, (F.col("at") == 0) & F.col("opens")
    body = F.when(leads, F.substring("value", len(marker) + 1, 1 << 30)).otherwise(F.col("value"))
    cut = F.instr("body", "\n")
    label = (F.when(head & ~F.col("opens"), F.lit(None).cast("string"))
             .when(cut == 0, F.col("body")).otherwise(F.expr("left(body, instr(body, '\n') - 1)")))
    rest = (F.when(head & ~F.col("opens"), F.col("body")).when(cut == 0, F.lit(""))
            .otherwise(F.expr("substring(body, instr(body, '\n') + 1)")))
    lines = F.transform(F.split("rest", "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")
    out = (placed.withColumn("body", body).withColumn("label", label).withColumn("rest", rest)
           .select("file", (F.col("at") + F.col("opens").cast("long")).cast("int").alias("block"),
                   F.trim("label").alias("label"), text.alias("text")))
    return out.filter(F.length("text") > 0)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pair_id, id_1, id_2, added`` of a pair set, read in parallel."""
    return spark.read.schema("pair_id long, id_1 long, id_2 long, added boolean").json(
        f"{path}/pairs")


def read_pairs_meta(spark: SparkSession, path: str) -> DataFrame:
    """``n, n_pairs, compare`` of a pair set."""
    return spark.read.schema("n long, n_pairs long, compare long").json(f"{path}/meta")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """Judgement lines ``task?, pair_id, pair_ids, win, why`` with a ``status``:
    ``ok``, or ``corrupt`` for a line that is no such record (null fields, the
    line in ``_corrupt_record``). Blank lines skip; nothing else is lost."""
    return _with_status(_json(spark, path, JUDGEMENT_SCHEMA), F.col("pair_id").isNull())


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES_SCHEMA).json(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Edges ``(first, second, third)`` of a stored taxonomy."""
    return spark.read.schema("first string, second string, third string").json(path)


def load_templates(spark: SparkSession, directory: str, tasks=None) -> dict[str, str]:
    """``{task: template}`` from ``<task>.txt`` files; missing tasks are
    skipped. Templates are a handful of small files, so they come back to the
    driver as plain strings."""
    df = spark.read.text(os.path.join(directory, "*.txt"), wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("task"), "value")
    if tasks is not None:
        df = df.filter(F.col("task").isin(list(tasks)))
    return {r["task"]: r["value"] for r in df.collect()}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the extension: ``.jsonl``, ``.txt`` or ``.md``."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".jsonl":
        return read_raw_jsonl(spark, path)
    if ext == ".txt":
        return read_raw_txt(spark, path)
    if ext == ".md":
        return read_md_samples(spark, path)
    raise ValueError(f"unsupported raw format: {ext or path}")
