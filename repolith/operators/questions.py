"""Questions worth asking, answered ones, repeated ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions import columns as C
from repolith.functions import fixed_values as fv
from repolith.functions.ranking import top_k


def unanswered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions without an answer with the same text (JOIN-08, SET-05)."""
    done = answers.select("repo_id", F.explode("domain_qa").alias("q")).select("repo_id", F.col("q.question").alias("question"))
    return questions.join(done, ["repo_id", "question"], "left_anti")


def split_qa(qa: DataFrame) -> DataFrame:
    """Framework tag and clean text of every question (PRJ-25)."""
    return qa.withColumns(
        {
            "framework": C.qa_tag("question"),
            "clean_question": C.qa_text("question"),
            "is_framework": F.col("question").rlike(r"^\[.+?\] "),
        }
    )


def new_questions(candidates: DataFrame, asked: DataFrame, knowledge: DataFrame | None = None) -> DataFrame:
    """Candidates nobody asked before, by normalised text (JOIN-17)."""
    seen = asked.select("repo_id", C.question_key("question").alias("_key"))
    if knowledge is not None:
        seen = seen.unionByName(knowledge.select("repo_id", C.question_key("title").alias("_key")))
    keyed = candidates.withColumn("_key", C.question_key("question"))
    return keyed.join(seen, ["repo_id", "_key"], "left_anti").drop("_key")


#: Hash functions of a signature, and how many of them make a band.
SIGNATURE, BAND = 96, 3


def similar_questions(questions: DataFrame, percent: int = 70) -> DataFrame:
    """Questions (repo_id, id, question) with ``same_as``: the smallest id of an earlier one that says nearly the same (JOIN-17).

    Two questions are alike when their sets of words share ``percent`` hundredths of their union. A signature keeps the smallest
    hash of the words under each of many hash functions; bands of it are join keys. In each key group the first question
    meets the others, so a group costs its size and not its square; every meeting is verified on the words. Questions
    of equal words meet once as one. ``same_as`` is null for a question unlike all earlier ones and for one
    without words.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    rows = questions.select("repo_id", "id", "question", words.alias("words"))
    sets = rows.filter(F.size("words") > 0).groupBy("repo_id", "words").agg(F.min("id").alias("first"))
    least = lambda seed: F.array_min(F.transform("words", lambda w: F.xxhash64(w, seed)))
    signed = sets.withColumn("signature", F.transform(F.sequence(F.lit(1), F.lit(SIGNATURE)), least))
    band = lambda b: F.xxhash64(b, F.slice("signature", b * BAND + 1, F.lit(BAND)))
    bands = F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE // BAND - 1)), band)
    keyed = signed.select("repo_id", "first", "words", F.explode(bands).alias("key"))
    heads = keyed.groupBy("repo_id", "key").agg(F.min(F.struct("first", "words")).alias("head"), F.count(F.lit(1)).alias("n"))
    met = keyed.join(heads.filter("n > 1"), ["repo_id", "key"]).filter("head.first < first")
    met = met.select("repo_id", "first", "words", F.col("head.first").alias("earlier"), F.col("head.words").alias("other")).distinct()
    shared = F.size(F.array_intersect("words", "other"))
    alike = 100 * shared >= percent * (F.size("words") + F.size("other") - shared)
    found = met.filter(alike).groupBy("repo_id", "words").agg(F.min("earlier").alias("earlier"))
    named = sets.join(found, ["repo_id", "words"], "left")
    joined = rows.join(named, ["repo_id", "words"], "left")
    # the first of equal ones stands for itself
    same = F.when(F.col("id") > F.col("first"), F.least("first", "earlier")).otherwise(F.col("earlier"))
    return joined.select("repo_id", "id", "question", same.alias("same_as"))


def smart_questions(
    repos: DataFrame,
    hot: DataFrame,
    arch: DataFrame,
    services: DataFrame,
    pairs: DataFrame,
    fan_in: DataFrame,
    framework: DataFrame,
    gaps: DataFrame,
    answers: DataFrame,
    k: int = 12,
) -> DataFrame:
    """Candidate questions of seven categories in order, without the answered ones, first ``k`` (SET-01).

    ``hot``, ``pairs`` and ``fan_in`` are the ranked frames; ``services`` has n_services and names.
    """
    lit, c = F.lit, F.col
    text = lambda name: c(name).cast("string")

    def candidate(df: DataFrame, category: str, order: int, pos, question, context, dimension="domainQA") -> DataFrame:
        as_col = lambda v: lit(v) if isinstance(v, str) else v
        return df.select(
            "repo_id",
            lit(category).alias("category"),
            as_col(dimension).alias("dimension"),
            as_col(question).alias("question"),
            as_col(context).alias("context"),
            lit(order).cast("bigint").alias("cat_order"),
            pos.cast("bigint").alias("cat_pos"),
        )

    tribal = repos.select("repo_id").distinct().select(
        "repo_id", F.posexplode(F.array(*[lit(q) for q in fv.TRIBAL_QUESTIONS])).alias("p", "q")
    )
    fw = top_k(framework, 4, ["repo_id"], [F.asc("pos")])
    parts = [
        candidate(
            hot.filter("rank <= 3"), "hot-file", 1, c("rank"),
            F.concat(C.base_name("path"), lit(" changed "), text("change_count"), lit(" times recently — what are the key business rules or invariants it enforces?")),
            F.concat(lit("Most frequently changed file: "), c("path")),
        ),
        candidate(
            arch.filter("style <> 'unknown'"), "architecture", 2, lit(1),
            F.concat(lit("The codebase appears to be a "), c("style"), lit(". Why was this architecture chosen? Any constraints or trade-offs to know about?")),
            F.concat(lit("Detected "), F.size("layers").cast("string"), lit(" layers, "), F.size("entry_points").cast("string"), lit(" entry points")),
        ),
        candidate(
            services.filter("n_services > 1"), "architecture", 2, lit(2),
            F.concat(lit("I see "), text("n_services"), lit(" services ("), c("names"), lit("). How do they communicate? Any ordering dependencies or gotchas?")),
            "Detected from service map analysis",
        ),
        candidate(
            pairs.filter("rank <= 2"), "coupling", 3, c("rank"),
            F.concat(C.base_name("file_a"), lit(" and "), C.base_name("file_b"), lit(" always change together ("), text("n"), lit(" times). Is this intentional coupling or tech debt?")),
            F.concat(lit("Co-change strength: "), C.js_round(c("strength") * 100).cast("string"), lit("%")),
        ),
        candidate(
            fan_in.filter("rank <= 2"), "load-bearing", 4, c("rank"),
            F.concat(C.base_name("file"), lit(" is imported by "), text("n_imports"), lit(" other files. Any rules for modifying it? Breaking change risks?")),
            F.concat(lit("High fan-in module: "), c("file")),
        ),
        candidate(tribal, "tribal", 5, c("p"), c("q"), lit(None).cast("string")),
        candidate(
            fw, "framework", 6, c("pos"),
            F.concat(lit("["), c("framework"), lit("] "), c("question")), c("context"),
        ),
        candidate(
            gaps.filter(c("impact").isin("high", "medium")), "gap", 7, c("pos"), c("question"), c("context"), c("dimension")
        ),
    ]
    candidates = unanswered(reduce(DataFrame.unionByName, parts), answers)
    order = [F.asc("cat_order"), F.asc("cat_pos"), F.asc("question")]
    return top_k(candidates, k, ["repo_id"], order, rank="pos").select(
        "repo_id", "pos", "category", "dimension", "question", "context"
    )
