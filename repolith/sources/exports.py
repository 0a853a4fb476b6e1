"""Readers of exported repository data. Every reader returns tables that lead with ``repo_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith import schemas
from repolith.functions import columns as C
from repolith.operators.prs import flatten_prs
from repolith.sources import contentsource
from repolith.sources.logsource import COMMIT_MARK, FIELD_MARK, FIELDS, register

def _repo_from_file(path: Column) -> Column:
    """Repository id of an export: the folder ``repo_id=...`` it lies in, else its base name without its extension."""
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # a folder's name is escaped once more by the path it stands in
    folder = F.regexp_extract(decoded(path), "/repo_id=([^/]+)/", 1)
    return F.when(folder != "", decoded(folder)).otherwise(C.stem(decoded(path)))


def parse_numstat(line: Column) -> Column:
    """Numstat line to (path, insertions, deletions, is_binary); null when it has no three fields (PRJ-01)."""
    parts = F.split(C.strip(line), "\t")
    binary = F.get(parts, F.lit(0)) == "-"
    number = lambda i: F.when(binary, F.lit(0)).otherwise(
        F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0))
    ).cast("bigint")
    return F.when(
        F.size(parts) >= 3,
        F.struct(
            C.resolve_rename(F.get(parts, F.lit(2))).alias("path"),
            number(0).alias("insertions"),
            number(1).alias("deletions"),
            binary.alias("is_binary"),
        ),
    )


def _log_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of exported logs, with the head of the following chunk and the log position.

    The commit mark is the record separator of the text reader, so one large log is read by many
    tasks. Order inside a file split comes from the scan; what crosses a split border (the next
    chunk, the position) is settled on one row per split.
    """
    raw = spark.read.option("lineSep", COMMIT_MARK).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    inside = Window.partitionBy("file", "block").orderBy("row")
    rows = raw.withColumns(
        {"next_here": F.lead("value").over(inside), "nth": F.row_number().over(inside).cast("bigint")}
    )
    splits = raw.groupBy("file", "block").agg(
        F.min_by("value", "row").alias("first_value"), F.count(F.lit(1)).alias("n")
    )
    across = Window.partitionBy("file").orderBy("block")
    borders = splits.select(
        "file",
        "block",
        F.lead("first_value").over(across).alias("next_there"),
        F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    return rows.join(borders, ["file", "block"]).select(
        "file",
        (F.col("offset") + F.col("nth") - 1).alias("seq"),
        "value",
        F.coalesce("next_here", "next_there").alias("following"),
    )


def _text_log(spark: SparkSession, path: str) -> DataFrame:
    """The columns of the data source by the text reader, for stores that only Spark can open."""
    chunks = _log_chunks(spark, path)
    lines = F.split("value", "\n")
    # the header starts at the first line with a field mark; earlier lines belong to the commit above
    start = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(FIELD_MARK))), F.lit(True))
    header = C.strip(F.when(start > 0, F.array_join(F.slice(lines, start, F.size(lines)), "\n")))
    tail = F.split("following", "\n")
    tail_start = F.array_position(F.transform(tail, lambda x: F.contains(x, F.lit(FIELD_MARK))), F.lit(True))
    stats = F.when(tail_start > 0, F.slice(tail, F.lit(1), tail_start - 1)).otherwise(tail)
    raw = chunks.select("file", "seq", header.alias("header"), F.split(header, FIELD_MARK).alias("f"), stats.alias("stats"))
    whole = F.size("f") >= FIELDS
    field = lambda i: F.when(whole, F.get("f", F.lit(i)))
    when = F.to_utc_timestamp(F.try_to_timestamp(field(3), F.lit("yyyy-MM-dd HH:mm:ss Z")), "UTC").cast("timestamp_ntz")
    return raw.filter("f IS NOT NULL").select(
        _repo_from_file(F.col("file")).alias("repo_id"),
        F.col("seq").alias("position"),
        *(field(i).alias(c) for i, c in enumerate(("commit_id", "author", "email", "date"))),
        when.alias("committed_at"),
        field(4).alias("subject"),
        C.strip(field(5)).alias("body"),
        F.contains(field(6), F.lit(" ")).alias("is_merge"),
        "stats",
        F.when(~whole | when.isNull(), F.col("header")).alias("_corrupt"),
    )


def commit_log(
    spark: SparkSession, path: str, columns: str | None = None, via: str = "source", split_bytes: int | None = None
) -> DataFrame:
    """Records of exported ``git log --numstat`` text, one repository to a file or folder (SRC-01, WIN-05).

    A record is seven fields (sha, author, email, date, subject, body, parents) and the commit mark; its numstat lines
    stand in front of the next record. ``columns`` is a schema of those wanted. ``via="text"`` reads by Spark's text reader in place of
    the data source, for stores that Arrow cannot open; there ``position`` counts records, and the text is shuffled.
    """
    if via == "text":
        found = _text_log(spark, path)
        return found if columns is None else found.select(*T.StructType.fromDDL(columns).fieldNames())
    reader = register(spark).read.format("commit_log").option("tasks", 2 * spark.sparkContext.defaultParallelism)
    if columns is not None:
        reader = reader.schema(columns)
    if split_bytes is not None:
        reader = reader.option("splitBytes", split_bytes)
    return reader.load(path)


def corrupt_log_records(spark: SparkSession, path: str, via: str = "source") -> DataFrame:
    """Records of exported logs that cannot be read whole: too few fields, or a date that is none.

    ``read_commit_log`` drops the former and keeps the latter without a time, marked in ``_corrupt``.
    """
    found = commit_log(spark, path, "repo_id STRING, position BIGINT, commit_id STRING, _corrupt STRING", via)
    reason = F.when(F.col("commit_id").isNull(), "fields").otherwise("date").alias("reason")
    return found.filter("_corrupt IS NOT NULL").select("repo_id", F.col("position").alias("seq"), reason, F.col("_corrupt").alias("record"))


def read_commit_log(
    spark: SparkSession, path: str, via: str = "source", split_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Commits and changes of exported logs, see ``commit_log``.

    Records with fewer fields are dropped, see ``corrupt_log_records``. ``seq`` is the log position: it grows
    with every record of a file, from the newest.
    """
    columns = (
        "repo_id STRING, position BIGINT, commit_id STRING, author STRING, email STRING, date STRING, subject STRING, "
        "body STRING, is_merge BOOLEAN, committed_at TIMESTAMP_NTZ, _corrupt STRING"
    )
    commits = commit_log(spark, path, columns, via, split_bytes).filter("commit_id IS NOT NULL").withColumnRenamed("position", "seq")
    columns = "repo_id STRING, position BIGINT, commit_id STRING, committed_at TIMESTAMP_NTZ, stats ARRAY<STRING>"
    changes = (
        commit_log(spark, path, columns, via, split_bytes)
        .filter("commit_id IS NOT NULL")
        .select("repo_id", F.col("position").alias("seq"), "commit_id", "committed_at", F.explode("stats").alias("line"))
        .withColumn("s", parse_numstat(F.col("line")))
        .filter("s IS NOT NULL")
        .select("repo_id", "commit_id", "seq", "committed_at", "s.*")
    )
    return commits, changes


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Exported file lists, one path per line, blank lines dropped (SRC-02)."""
    return (
        spark.read.text(path)
        .select(_repo_from_file(F.col("_metadata.file_path")).alias("repo_id"), F.col("value").alias("path"))
        .filter("path <> ''")
    )


def read_contents(
    spark: SparkSession, root: str, glob: str | None = None, head_lines: int | None = None
) -> DataFrame:
    """Texts below ``root/<repo_id>/...`` (SRC-03). Whole texts unless ``head_lines`` is given.

    ``glob`` prunes files by name before any content is read; unreadable files are skipped.
    """
    reader = contentsource.register(spark).read.format("repo_files").schema("repo_id STRING, path STRING, text STRING")
    if glob:
        reader = reader.option("glob", glob)
    text = F.col("text")
    if head_lines is not None:
        text = F.array_join(F.slice(F.split(text, "\n"), 1, head_lines), "\n")
    return reader.load(root).filter("text IS NOT NULL").select("repo_id", "path", text.alias("text"))


def read_prs(spark: SparkSession, path: str) -> DataFrame:
    """Pull-request JSON, one object per line, one file per repository (SRC-04)."""
    raw = spark.read.schema(schemas.PULL_REQUEST_JSON).json(path)
    return flatten_prs(raw.withColumn("repo_id", _repo_from_file(F.col("_metadata.file_path"))))


def read_state(spark: SparkSession, path: str, schema: str = schemas.ANSWERS) -> DataFrame:
    """Saved answers, snapshots or run metadata (SRC-06); corrupt records go, none means none."""
    raw = spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path)
    return raw.select("*").filter("_corrupt IS NULL").drop("_corrupt")


def read_asked_log(spark: SparkSession, path: str) -> DataFrame:
    """``date | id | question | status`` lines; comments and blank lines dropped."""
    parts = F.split("value", r"\s*\|\s*")
    return (
        spark.read.text(path)
        .select(_repo_from_file(F.col("_metadata.file_path")).alias("repo_id"), "value")
        .filter("value <> '' AND NOT startswith(value, '#')")
        .select(
            "repo_id",
            *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("asked_on", "id", "question", "status"))],
        )
    )
