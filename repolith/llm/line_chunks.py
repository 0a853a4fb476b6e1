"""Line deduplication over content-defined chunks, with DataFrame functions only.

The lines of a text are hashed; a boundary falls after a line where the rolling hash of its hash and
the one before it starts with a digit of ``BOUNDARY``. Boundaries depend on two lines alone, so the same run
of lines gets the same chunks wherever it stands. Chunks of two lines or more that occur again anywhere
are removed, but for the first occurrence, after their bytes have been compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First hexadecimal digits that make a boundary: a quarter of all lines ends a chunk.
BOUNDARY = "0123"


def line_hash(line: Column) -> Column:
    return F.md5(line)


def rolling_hash(before: Column, here: Column) -> Column:
    return F.md5(F.concat(before, here))


def with_chunks(rows: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Adds ``_chunks``: (pos, n_lines, chunk) in order; joined by line breaks they give ``text``.

    Each array is a column of its own, as a lambda would compute what it captures anew for every element.
    """
    rows = rows.withColumn("_lines", F.split("text", "\n", -1))
    rows = rows.withColumn("_hashes", F.transform("_lines", line_hash))
    begins = lambda i: F.substring(rolling_hash(F.get("_hashes", i - 2), F.get("_hashes", i - 1)), 1, 1).isin(*boundary)
    later = F.when(F.size("_lines") > 2, F.filter(F.sequence(F.lit(2), F.size("_lines") - 1), begins)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", F.concat(F.array(F.lit(0)), later))

    def chunk(begin: Column, i: Column) -> Column:
        n = F.coalesce(F.get("_starts", i + 1), F.size("_lines")) - begin
        return F.struct(i.alias("pos"), n.alias("n_lines"), F.array_join(F.slice("_lines", begin + 1, n), "\n").alias("chunk"))

    return rows.withColumn("_chunks", F.transform("_starts", chunk)).drop("_hashes", "_starts")


def remove_repeated_chunks(docs: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """doc_id, text, kept, n_lines, n_removed, chunks_removed for each row of ``docs (doc_id, text)``.

    Of a repeated chunk the occurrence in the smallest (doc_id, text hash, place) stays. ``kept`` joins
    the chunks that stay with line breaks. A null text has no lines and stays null; an empty text is
    one empty line; rows alike in doc_id and text are treated alike, as one place; a null doc_id comes
    first. Other columns are ignored.

    Hashes are grouped first, with one row per hash and task; only then do the bytes of repeated chunks
    travel, once from the first occurrence to each other one. The rows of a very common chunk can be
    split, as they meet one row.
    """
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    # outer, as the filter that explode() would push down repeats all of the expressions above
    cut = with_chunks(rows.filter(F.col("text").isNotNull()), boundary).select(F.struct("doc_id", "_h").alias("row"), F.explode_outer("_chunks").alias("c"))
    places = cut.filter("c.n_lines >= 2").select(F.xxhash64("c.chunk").alias("hash"), F.length("c.chunk").alias("size"), F.struct("row", "c.pos").alias("place"))

    # the bytes of first occurrences
    asked = _repeated(places).select("hash", "size", F.col("first.row.doc_id").alias("f_doc"), F.col("first.row._h").alias("f_h"), F.col("first.pos").alias("f_pos"))
    owners = asked.groupBy("f_doc", "f_h").agg(F.collect_list(F.struct("hash", "size", "f_pos")).alias("asked"))
    first_rows = rows.join(owners, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("_h") == F.col("f_h"))).dropDuplicates(["f_doc", "f_h"])
    firsts = with_chunks(first_rows, boundary).withColumn("a", F.explode("asked"))
    firsts = firsts.select("a.hash", "a.size", "f_doc", "f_h", "a.f_pos", F.get("_chunks", F.col("a.f_pos"))["chunk"].alias("bytes"))

    is_first = F.col("place.row.doc_id").eqNullSafe(F.col("f_doc")) & (F.col("place.row._h") == F.col("f_h")) & (F.col("place.pos") == F.col("f_pos"))
    others = places.join(firsts, ["hash", "size"]).filter(~is_first)
    lists = others.groupBy(F.col("place.row.doc_id").alias("o_doc"), F.col("place.row._h").alias("o_h")).agg(F.collect_set(F.struct(F.col("place.pos").alias("pos"), "bytes")).alias("again"))

    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("_h") == F.col("o_h")), "left")
    goes = lambda c: F.exists("again", lambda a: (a["pos"] == c["pos"]) & (a["bytes"] == c["chunk"]))
    out = with_chunks(joined, boundary)
    out = out.withColumn("_gone", F.when(F.col("again").isNotNull(), F.filter("_chunks", goes)))
    out = out.withColumn("_left", F.when(F.size("_gone") > 0, F.array_except("_chunks", "_gone")))
    removed = F.aggregate("_gone", F.lit(0), lambda n, c: n + c["n_lines"])
    return out.select(
        "doc_id",
        "text",
        F.when(F.col("_left").isNotNull(), F.array_join(F.transform("_left", lambda c: c["chunk"]), "\n")).otherwise(F.col("text")).alias("kept"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).cast("long").alias("chunks_removed"),
    )


def _repeated(places: DataFrame) -> DataFrame:
    """hash, size and first place of chunks that stand in two places at least."""
    found = places.groupBy("hash", "size").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return found.filter("first <> last").select("hash", "size", "first")
