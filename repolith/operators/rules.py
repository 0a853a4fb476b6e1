"""Rule tables of any size against texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.session import stage

#: Characters of the piece by which a literal is looked up; shorter literals are looked up whole.
GRAM = 3
#: Distinct pieces of all rules that are sent to every task, some MB at most.
MAX_GRAMS = 100_000


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def literal_hits(texts: DataFrame, rules: DataFrame, text: str = "text", literal: str = "literal") -> DataFrame:
    """Every row of ``texts`` with every row of ``rules`` whose ``literal`` its ``text`` contains, once each.

    A literal is looked up by the one of its trigrams that the fewest texts hold: an equi-join of trigrams names the
    literals a text may hold, and containment is then tested. So neither the plan nor a row's work grows with the number of
    rules, and a literal with a trigram that no text holds meets none. Texts are written once with a number; only numbers
    go with trigrams, and only trigrams of rules are exchanged. Null and empty literals hit nothing. The
    columns of the two tables must differ in name.
    """
    # at most three lengths
    lengths = [r[0] for r in rules.filter(F.length(literal) > 0).select(F.least(F.length(literal), F.lit(GRAM))).distinct().collect()]
    lengths = lengths or [GRAM]
    of_text = F.concat(*[_grams(F.col(text), n) for n in sorted(lengths)])
    of_rule = F.lit(None).cast("array<string>")
    for n in lengths:
        size = F.length(literal) == n if n < GRAM else F.length(literal) >= n
        of_rule = F.when(size, _grams(F.col(literal), n)).otherwise(of_rule)
    numbered = stage(texts.withColumn("_text", F.monotonically_increasing_id()), "texts")
    keyed = numbered.select("_text", F.explode(of_text).alias("_gram"))
    named = rules.withColumn("_rule", F.struct(*rules.columns))
    wanted = stage(named.select("_rule", F.explode(of_rule).alias("_gram")).distinct(), "wanted")
    held = keyed.join(_side(wanted.select("_gram").distinct()), "_gram", "left_semi")
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(often, "_gram", "left").groupBy("_rule").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0).cast("bigint")).alias("n"), F.col("_gram").alias("gram"))).alias("_r")
    )
    rarest = stage(rarest.filter("_r.n > 0").select(F.col("_r.gram").alias("_gram"), "_rule"), "rarest")
    met = keyed.join(_side(rarest.select("_gram").distinct()), "_gram", "left_semi").join(rarest, "_gram")
    met = met.select("_text", *[F.col(f"_rule.{c}").alias(c) for c in rules.columns])
    return numbered.join(met, "_text").filter(F.contains(text, literal)).drop("_text")


def _side(grams: DataFrame) -> DataFrame:
    """Distinct grams for every task while they are few; more are joined by an exchange."""
    return F.broadcast(grams) if grams.count() <= MAX_GRAMS else grams


def scan_literals(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines (repo_id, path, language, line_no, line) that hold a rule's literal (PRJ-28).

    ``rules`` are (rule, rule_language, category, literal); language ``*`` stands for all.
    """
    hits = literal_hits(lines, rules, text="line")
    fits = (F.col("rule_language") == "*") | F.coalesce(F.col("rule_language") == F.col("language"), F.lit(False))
    return hits.filter(fits).select("repo_id", "path", "line_no", "category", "rule")
