"""Mixing sources to target weights.

Every document gets a random key from its id and text; within a source the keys are put in order by
ranges, word counts are summed up over the ranges and inside each range, and the order is cut where the
source's budget ends. A budget above the source's size takes whole rounds first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import base

#: Weights of the sources in their order, repeated.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its size.
MAX_ROUNDS = 3
#: Documents of one key range, about.
RANGE_ROWS = 4096
SEED = "mix-1"
HEX = "0123456789abcdef"
_PREFIX = r"[\x20\x09-\x0D]*" + base.WORD


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(base.WORD)), F.lit(0)).cast("long")


def random_key(seed: str = SEED) -> Column:
    """32 hexadecimal digits from the seed, doc_id and text: the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")))))


def source_budgets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """source, n_docs, source_size, weight, target of ``sized (source, size)``; one row for each source.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes. A target
    stops at ``max_rounds`` times the source's size and the excess goes to the others by weight. With
    the sources in order of size per weight, those that stop are a prefix: the first that does not
    need to stop, given all before it did, ends it. The windows run over one row per source.
    """
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights)) + 1).cast("long")
    everything = Window.partitionBy(F.lit(0))
    cap = max_rounds * F.col("source_size")
    by_need = Window.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", weight)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(by_need), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_need), F.lit(0))).alias("weights_left"),
    )
    stops = cap * F.col("weights_left") < F.col("weight") * F.col("left")
    # the first row in that order that does not stop has the most left
    first = F.max(F.when(~stops, F.struct("weights_left", "left"))).over(everything)
    rows = rows.withColumn("stops", stops).withColumn("first", first)
    share = F.col("weight") * F.col("first.left") / F.col("first.weights_left")
    return rows.select("source", "n_docs", "source_size", "weight", F.when(F.col("stops"), cap.cast("double")).otherwise(share).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rounds: int = MAX_ROUNDS, seed: str = SEED) -> DataFrame:
    """key, doc_id, source, size, source_size, target, taken for every row of ``docs (doc_id, text, source)``.

    ``taken`` counts the words that the mix takes of a document, rounds included; over a source they
    add up to its target, cut to whole words. The document at the cut gives only its first words.

    Null texts and texts without words have size 0 and give nothing; a null source is a source of its
    own; null or repeated ids are fine, and rows alike in doc_id and text may be taken in any order,
    which leaves the same rows. An empty table gives an empty plan.

    Texts are read once; the narrow rows are written to the shared folder. A source is dealt out by
    ranges of its keys, of about ``RANGE_ROWS`` rows each, so a large source is many tasks.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(seed).alias("key"))
    sized = base.stage(sized, "mix")
    budgets = source_budgets(sized, weights, max_rounds)
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_docs") / RANGE_ROWS))).cast("int")
    budgets = budgets.withColumn("digits", digits).withColumnRenamed("source", "b_source")
    same = F.col("source").eqNullSafe(F.col("b_source"))
    ranged = sized.join(budgets.select("b_source", "digits"), same).withColumn("range", F.expr("substr(key, 1, digits)")).drop("b_source", "digits")

    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_before"))

    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("inside_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    rows = rows.join(budgets, same)
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - rounds * F.col("source_size")
    before = F.col("range_before") + F.col("inside_before")
    taken = rounds * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - before))
    return rows.select("key", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as the plan says, with all their columns.

    Rows alike in doc_id, source and text are one row that is taken for all of them. Of the document
    at a source's cut the first words remain, and ``n_chars``, where there is one, is set to match.
    """
    # columns that bear names used here are set aside
    names = docs.columns
    keyed = docs.select(random_key(seed).alias("_key"), F.struct(*names).alias("_row"), F.col("source").alias("_source"))
    keyed = keyed.dropDuplicates(["_key", "_source"])
    wanted = plan.filter("taken > 0").groupBy("key", "source").agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
    rows = keyed.join(wanted, (F.col("_key") == F.col("key")) & F.col("_source").eqNullSafe(F.col("source")))
    rows = rows.select("_row", "_taken", "_size").withColumn("_round", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")))))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_round") - 1) * F.col("_size"))
    some = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(_PREFIX), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("_size"), some).otherwise(F.col("_row.text"))
    out = {c: F.col("_row")[c] for c in names} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(c.alias(name) for name, c in out.items()))
