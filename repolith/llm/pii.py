"""Personal data by weak supervision, with DataFrame functions only.

Four base patterns find spans for certain. Wider patterns propose more: numbers grouped like telephone
numbers, addresses spelled with words, long digit runs, addresses of version 6. Labelers vote on every
candidate: the base pattern, the shape, a gazetteer (calling codes, top-level domains, card issuers), words
before it that speak for it and words that speak against it. Expectation maximisation estimates from
all votes how far each labeler can be trusted, and a logistic span classifier is fitted to the resulting
labels; candidates it accepts are added. Base spans always stay.

Votes and features are counted per pattern of votes, of which there are a few thousand at most, whatever
the size of the input; only these counts reach the driver.

The patterns are written without nested repeats and with possessive runs, so their time is in proportion
to the text. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from repolith.llm import base

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Each finds what the plain pattern in the comment finds, leftmost and without overlap.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE_PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?=\.(?!{_LABEL})|[^A-Za-z0-9.-]|\z)",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ ; runs under 13 digits fail the check anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9][0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of further candidates, by kind.
WIDE_PATTERNS = {
    "email": r"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._-]{0,63}+(?: ?[\[(]at[\])] ?| at )[a-z0-9-]{1,63}+(?:(?: ?[\[(]dot[\])] ?| dot )[a-z0-9-]{2,63}+){1,4}(?![a-z0-9])",
    "ip": r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:])",
    "card": BASE_PATTERNS["card"],
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried at all.
_HINTS = {"email": "@", "phone": "+"}

# Gazetteers and context words: fixed values, replaceable by parameter.
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
FOR_WORDS = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "address", "server", "adresse", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "telefon", "mobile", "fax", "cell", "teléfono", "téléphone"),
}
AGAINST_WORDS = ("order", "invoice", "version", "isbn", "page", "id", "no", "ref", "nr", "serial", "tracking")
#: Code points before a candidate in which its words are looked for.
CONTEXT = 40
LABELERS = ("pattern", "shape", "gazetteer", "for_word", "against_word")
_BLOCK = 256


# ---- spans ------------------------------------------------------------------------------------


def with_matches(rows: DataFrame, column: str, pattern: str, hint: str | None = None) -> DataFrame:
    """Adds ``column``: array of (start, end, value) of the pattern's matches in ``_text``.

    The text between matches and the matches themselves alternate, so starts are sums of lengths; sums
    are kept for every block of matches, which keeps texts with very many matches in bounds.
    """
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    rows = rows.withColumn("_m", F.when(F.contains("_text", F.lit(hint)), found).otherwise(none) if hint else found)
    gaps = F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).otherwise(none)
    rows = rows.withColumn("_l", F.zip_with("_m", F.slice(gaps, 1, F.size("_m")), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))))
    total = lambda array: F.aggregate(array, F.lit(0), lambda n, x: n + x["gap"] + x["own"])
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"size(_l) div {_BLOCK}")), lambda b: total(F.slice("_l", F.lit(1), b * _BLOCK)))
    rows = rows.withColumn("_b", F.when(F.size("_l") > 0, blocks))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get("_b", block) + total(F.slice("_l", block * _BLOCK + 1, i - block * _BLOCK)) + F.get("_l", i)["gap"]
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    return rows.withColumn(column, F.transform("_m", span)).drop("_m", "_l", "_b")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    own = digits(value)
    at = lambda i: F.substring(own, F.length(own) - i, F.lit(1)).cast("int")
    add = lambda n, i: n + F.when(i % 2 == 0, at(i)).when(at(i) < 5, 2 * at(i)).otherwise(2 * at(i) - 9)
    return F.length(own).between(13, 19) & (F.aggregate(F.sequence(F.lit(0), F.length(own) - 1), F.lit(0), add) % 10 == 0)


def holds(kind: str, value: Column) -> Column:
    """The check that a match of the base pattern must pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


# ---- votes ------------------------------------------------------------------------------------


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def votes(kind: str, value: Column, before: Column, is_base: Column, for_words: dict, against: Iterable[str]) -> list[Column]:
    """One vote of each labeler: 1 personal data, -1 not, 0 no opinion."""
    words = F.split(F.lower(before), r"[^\p{L}-]+")
    said = F.arrays_overlap(words, F.array(*map(F.lit, for_words[kind])))
    denied = F.arrays_overlap(words, F.array(*map(F.lit, against)))
    own = digits(value)
    shape = {
        "email": vote(value.rlike(r"^[A-Za-z0-9]"), ~value.rlike("[A-Za-z]")),
        "ip": vote(value.rlike(r"^(?:[1-9][0-9]{0,2}\.){3}|:"), value.rlike(r"^0")),
        "card": vote(value.rlike(r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$"), F.length(own) < 15),
        "phone": vote(value.rlike(r"^\+|^\("), F.length(own) < 9),
    }[kind]
    known = {
        "email": vote(F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS)),
        "ip": vote(value.rlike(r"^(?:10|127|192\.168)\.|:"), value.rlike(r"^(?:0|255)\.")),
        "card": vote(own.rlike(CARD_PREFIX), ~own.rlike("^[3-6]")),
        "phone": vote(reduce(lambda a, b: a | b, (own.startswith(c) for c in CALLING_CODES)) & value.startswith("+")),
    }[kind]
    pattern = vote(is_base, F.lit(kind == "card"))
    return [pattern, shape, known, vote(said), F.when(denied, -1).otherwise(0)]


def candidates(docs: DataFrame, for_words: dict = FOR_WORDS, against: Iterable[str] = AGAINST_WORDS) -> DataFrame:
    """doc_id and, per row of ``docs (doc_id, text)``, arrays ``base`` and ``more`` of candidates.

    ``base`` holds the spans of the base patterns that pass their checks, by kind and start; ``more``
    the wider candidates that overlap none of them. Both carry the votes and a length class.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    for kind in KINDS:
        rows = with_matches(rows, f"_base_{kind}", BASE_PATTERNS[kind], _HINTS.get(kind))
        if kind != "card":
            rows = with_matches(rows, f"_wide_{kind}", WIDE_PATTERNS[kind])

    def judged(kind: str, column: str, is_base: bool) -> Column:
        def one(m: Column) -> Column:
            before = F.substring("_text", F.greatest(F.lit(1), m["start"] - CONTEXT + 1), F.least(m["start"], F.lit(CONTEXT)))
            ballot = F.array(*votes(kind, m["value"], before, F.lit(is_base), for_words, against))
            length = F.least(F.lit(4), F.floor(F.length(m["value"]) / 8)).cast("int")
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), ballot.alias("votes"), length.alias("length"))

        return F.transform(column, one)

    for kind in KINDS:
        passed = F.filter(f"_base_{kind}", lambda m: holds(kind, m["value"]))  # noqa: B023
        rows = rows.withColumn(f"_sure_{kind}", judged(kind, passed, True))
    rows = rows.withColumn("base", F.concat(*(F.col(f"_sure_{kind}") for kind in KINDS)))
    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    wide = []
    for kind in KINDS:
        column = F.filter(f"_base_{kind}", lambda m: F.length(digits(m["value"])) <= 19) if kind == "card" else F.col(f"_wide_{kind}")
        wide.append(judged(kind, F.filter(column, free), False))
    return rows.select("doc_id", "base", F.concat(*wide).alias("more"))


# ---- expectation maximisation and the span classifier -----------------------------------------


def reliabilities(counts: list[Row], rounds: int = 30) -> tuple[dict, dict]:
    """Of each kind and labeler how often it says yes, no or nothing for data and for no data; posteriors.

    ``counts`` has kind, votes, n. A start from the sum of the votes; counts are smoothed by one.
    """
    table: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in counts:
        key = (r["kind"], tuple(r["votes"]))
        table[key] = table.get(key, 0) + r["n"]
    posterior = {key: 1 / (1 + math.exp(-2 * sum(key[1]))) for key in table}
    says: dict = {}
    for _ in range(rounds):
        says = {}
        share: dict = {}
        for (kind, ballot), n in table.items():
            p = posterior[kind, ballot]
            for truth, weight in ((1, p * n), (0, (1 - p) * n)):
                share[kind, truth] = share.get((kind, truth), 1.0) + weight
                for i, v in enumerate(ballot):
                    cell = says.setdefault((kind, i, truth), {-1: 1.0, 0: 1.0, 1: 1.0})
                    cell[v] += weight
        for cell in says.values():
            total = sum(cell.values())
            for v in cell:
                cell[v] /= total
        for kind, ballot in table:
            odds = math.log(share[kind, 1]) - math.log(share[kind, 0])
            for i, v in enumerate(ballot):
                # a yes never speaks against, a no never for
                gain = math.log(says[kind, i, 1][v]) - math.log(says[kind, i, 0][v])
                odds += max(0.0, gain) if v > 0 else min(0.0, gain) if v < 0 else 0.0
            posterior[kind, ballot] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return says, posterior


def features(kind: str, ballot: Iterable[int], length: int) -> list[str]:
    return [f"{kind}", f"{kind}:length:{length}", *(f"{kind}:{name}:{v}" for name, v in zip(LABELERS, ballot, strict=True))]


def span_classifier(counts: list[Row], posterior: dict, rounds: int = 200, rate: float = 1.0, decay: float = 0.01) -> dict[str, float]:
    """Weights of a logistic model over features, fitted to the posteriors of all candidates."""
    weights: dict[str, float] = {}
    rows = [(features(r["kind"], r["votes"], r["length"]), posterior[r["kind"], tuple(r["votes"])], r["n"]) for r in counts]
    mass: dict[str, float] = {}
    for names, _, n in rows:
        for name in names:
            mass[name] = mass.get(name, 1.0) + n
    for _ in range(rounds):
        slope = dict.fromkeys(mass, 0.0)
        for names, label, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(name, 0.0) for name in names)))))
            for name in names:
                slope[name] += n * (label - p)
        weights = {name: weights.get(name, 0.0) * (1 - decay) + rate * slope[name] / mass[name] for name in mass}
    return weights


def score(span: Column, weights: dict[str, float]) -> Column:
    """Log odds of a candidate; features never seen say nothing."""
    table = F.create_map(*(x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(w)))) if weights else F.create_map().cast("map<string,double>")
    names = [span["kind"], F.concat_ws(":", span["kind"], F.lit("length"), span["length"])]
    names += [F.concat_ws(":", span["kind"], F.lit(name), F.get(span["votes"], F.lit(i))) for i, name in enumerate(LABELERS)]
    return reduce(lambda a, b: a + b, (F.coalesce(F.try_element_at(table, n), F.lit(0.0)) for n in names))


def find_personal_data(docs: DataFrame, for_words: dict = FOR_WORDS, against: Iterable[str] = AGAINST_WORDS) -> DataFrame:
    """doc_id, base, spans for each row of ``docs (doc_id, text)``: arrays of (kind, start, end).

    ``base`` is in the order of ``KINDS``, then start; ``spans`` adds what the classifier accepts, in the
    same order. A null or empty text has no spans; null and repeated ids, repeated rows and other columns
    are fine. Where an input has no wider candidates nothing is added. Texts are read once: the narrow
    candidate rows are written to the shared folder.
    """
    found = base.stage(candidates(docs, for_words, against), "pii")
    each = found.select(F.explode(F.concat("base", "more")).alias("c"))
    counts = each.groupBy("c.kind", "c.votes", "c.length").agg(F.count(F.lit(1)).alias("n"))
    # at most 4 kinds, 3 ** 5 ballots, 5 lengths
    counts = sorted(counts.collect(), key=lambda r: (r["kind"], r["votes"], r["length"]))
    _, posterior = reliabilities(counts)
    weights = span_classifier(counts, posterior)
    accepted = F.filter("more", lambda c: score(c, weights) > 0)
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    both = F.concat(F.transform("base", plain), F.transform(accepted, plain))
    in_order = F.concat(*(F.sort_array(F.filter(both, lambda c: c["kind"] == kind)) for kind in KINDS))
    return found.select("doc_id", F.transform("base", plain).alias("base"), in_order.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
