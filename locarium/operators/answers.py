"""Rules that check statements against the records they cite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions.text import signed_number_tokens, squash

# Words and patterns that decide verdicts.
APPROXIMATE = (
    "about", "approximately", "roughly", "around", "nearly", "almost", "half", "twice", "double", "triple", "quarter", "third", "dozen", "times",
    "percent of", "probably", "likely", "presumably", "possibly", "might have", "should have",
)
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
)
JUDGING = ("better", "worse", "best", "prefer", "preferred", "winner", "recommend", "recommended", "recommendation", "ranks above", "overall winner")
COMPARING = ("greater", "higher", "more", "less", "lower", "smaller", "larger")
ABSENT = (
    "unknown", "not known", "not available", "not established", "no data", "not mapped", "cannot be determined", "not determined", "not provided",
    "has not been confirmed", "is not confirmed",
)
ARITHMETIC = r"[=+×÷/]|(?<!\*)\*(?!\*)|\d[\d,]*(?:\.\d+)?\s*[-−]\s*\d"
CLAIMS = {
    "feasibility_claim": r"(?i)feasib\w*",
    "accuracy_claim": r"(?i)\baccura(?:cy|te|tely)\b",
    "sufficient_capacity_claim": r"(?i)\b(?:sufficient|enough|adequate)\b[^.]{0,25}\bcapacity\b|\bcapacity\b[^.]{0,25}\bis\s+(?:sufficient|enough|adequate)\b",
    "approval_claim": r"(?i)\bapprov(?:ed|al|als)\b",
    "viability_claim": r"(?i)\bviab(?:le|ility)\b",
    "revenue_claim": r"(?i)\brevenue\b",
    "land_available_claim": r"(?i)\bland\s+is\s+available\b|\bland\s+availability\s+(?:is|has\s+been)\s+confirmed\b",
    "owner_willing_claim": r"(?i)\b(?:land)?owner(?:'s)?\s+(?:is\s+)?willing(?:ness)?\s*(?:is|has\s+been)?\s*confirmed\b|\b(?:land)?owner\s+is\s+willing\b",
    "permit_approved_claim": r"(?i)\bpermits?\s+(?:is|are|has\s+been|have\s+been)\s+(?:approved|granted)\b",
}
GRID_DISCLAIMER = "Actual grid connection feasibility requires utility confirmation."
LEAST_QUOTE = 3


def _says(text: Column, word: str) -> Column:
    """A phrase anywhere, a single word as a whole."""
    return F.contains(text, F.lit(word)) if " " in word else text.rlike(rf"\b{word}\b")


def _says_any(text: Column, words: tuple[str, ...]) -> Column:
    phrases = [w for w in words if " " in w]
    singles = [w for w in words if " " not in w]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases], text.rlike(r"\b(?:" + "|".join(singles) + r")\b"))


def check(statements: DataFrame, records: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """``statement_id, rules``: the rules that each statement breaks, sorted; an empty array if none.

    ``statements``: ``statement_id, kind, text, evidence_ids, quotes``;
    ``records``: ``id, type, display, knowledge`` and, of comparisons, where
    there is such a column, their ``relation``; ``sites``: known ``site`` ids.
    Numbers must stand in a cited record's display; claims are looked for
    beside the disclaimer; who compares must cite a relation with a direction. Null text is empty,
    null arrays are empty.
    """
    none = F.array().cast("array<string>")
    s = statements.select("statement_id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("evidence_ids", none).alias("ids"), F.coalesce("quotes", none).alias("quotes"))
    if "relation" not in records.columns:
        records = records.withColumn("relation", F.lit(None).cast("string"))
    cited = s.select("statement_id", F.explode(F.array_distinct("ids")).alias("id")).join(records, "id")
    known = F.coalesce(F.col("knowledge"), F.lit(False))
    numbers = signed_number_tokens(F.col("display"))
    of = cited.groupBy("statement_id").agg(
        F.collect_set("id").alias("found"),
        F.array_distinct(F.flatten(F.collect_list(numbers))).alias("shown"),
        F.array_distinct(F.flatten(F.collect_list(F.when(known, none).otherwise(numbers)))).alias("shown_s"),
        F.array_distinct(F.flatten(F.collect_list(F.when(known, numbers).otherwise(none)))).alias("shown_k"),
        F.count_if(known).alias("n_k"),
        F.count_if(~known).alias("n_s"),
        F.bool_and(F.col("type") == "UNKNOWN").alias("all_unknown"),
        F.bool_or(F.col("type") == "CALCULATED").alias("calculated"),
        F.bool_or(F.col("relation").isin("a_greater", "b_greater")).alias("directed"),
        F.collect_list(F.when(known, squash(F.col("display")))).alias("chunks"),
    )
    j = s.join(of, "statement_id", "left").withColumns({c: F.coalesce(c, none) for c in ("found", "shown", "shown_s", "shown_k", "chunks")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_k", "n_s")})
    j = j.withColumn("low", F.lower("text")).withColumn("said", F.array_distinct(signed_number_tokens(F.col("text"))))
    ids, quotes = F.col("ids"), F.col("quotes")
    unknown = F.col("kind") == "UNKNOWN"
    quoted = F.transform(quotes, lambda q: F.struct(q.alias("q"), F.size(F.split(squash(q), " ")).alias("n"), F.exists("chunks", lambda c: F.contains(c, squash(q))).alias("in")))
    sites_said = F.regexp_extract_all("text", F.lit(r"(cand-[0-9a-f]{12})"), F.lit(1))
    both = (F.col("n_k") > 0) & (F.col("n_s") > 0)
    rules: dict[str, Column] = {
        "unknown_evidence_id": F.size(F.array_except(ids, F.col("found"))) > 0,
        "missing_citation": ~unknown & (F.size(ids) == 0),
        "unknown_must_state_absence": unknown & ~reduce(lambda a, b: a | b, [_says(F.col("low"), w) for w in ABSENT]),
        "calculated_not_grounded": (F.col("kind") == "CALCULATED") & ~F.coalesce("calculated", F.lit(False)),
        "number_not_grounded": F.size(F.array_except("said", "shown")) > 0,
        "arithmetic_expression": F.regexp_replace("text", r"\b[a-z]+-[0-9a-f]{12}\b", "ID").rlike(ARITHMETIC),
        "approximation_language": _says_any(F.col("low"), APPROXIMATE) | F.col("text").rlike("[~≈]"),
        "number_word": _says_any(F.col("low"), NUMBER_WORDS),
        "prohibited_comparison_language": _says_any(F.col("low"), JUDGING),
        "knowledge_quote_missing": (F.col("n_k") > 0) & (F.size(quotes) == 0),
        "quote_without_knowledge_citation": (F.size(quotes) > 0) & (F.col("n_k") == 0),
        "quote_too_short": (F.col("n_k") > 0) & F.exists(quoted, lambda q: q["n"] < LEAST_QUOTE),
        "quote_not_in_cited_chunk": (F.col("n_k") > 0) & F.exists(quoted, lambda q: (q["n"] >= LEAST_QUOTE) & ~q["in"]),
        "mixed_number_not_structured": both & F.exists("said", lambda t: ~F.array_contains("shown_s", t) & F.array_contains("shown_k", t)),
        "grid_disclaimer_missing": F.col("low").rlike(r"\bgrid\b") & ~F.contains("text", F.lit(GRID_DISCLAIMER)),
        "comparison_relation_mismatch": _says_any(F.col("low"), COMPARING) & ~F.coalesce("directed", F.lit(False)),
        "unknown_stated_as_fact": ~unknown & F.coalesce("all_unknown", F.lit(False)),
    }
    beside = F.replace("text", F.lit(GRID_DISCLAIMER), F.lit(""))
    rules |= {name: beside.rlike(p) for name, p in CLAIMS.items()}
    # numbers that any structured record shows may not come of documentation alone
    owned = records.where(~known).select(F.explode(numbers).alias("token")).distinct()
    bare = j.where((F.col("n_k") > 0) & (F.col("n_s") == 0)).select("statement_id", F.explode("said").alias("token"))
    must = bare.join(owned, "token", "left_semi").select("statement_id").distinct().withColumn("owned", F.lit(True))
    j = j.join(must, "statement_id", "left")
    rules["number_must_cite_structured_record"] = F.coalesce("owned", F.lit(False))
    j = j.withColumn("named", F.array_distinct(sites_said))
    if sites is not None:
        named = j.select("statement_id", F.explode("named").alias("site")).join(sites.select("site"), "site", "left_anti").groupBy("statement_id").agg(F.lit(True).alias("stranger"))
        j = j.join(named, "statement_id", "left")
        rules["unknown_site_reference"] = F.coalesce("stranger", F.lit(False))
    broken = F.array_sort(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))
    return j.select("statement_id", broken.alias("rules"))


def tally(checked: DataFrame) -> DataFrame:
    """``category, true_accept, false_accept, false_reject, true_reject``: verdicts against what was expected, per category.

    ``checked`` has ``category, accepted, expected``; a null in either is not counted.
    """
    a, e = F.col("accepted"), F.col("expected")
    return checked.groupBy("category").agg(F.count_if(a & e).alias("true_accept"), F.count_if(a & ~e).alias("false_accept"), F.count_if(~a & e).alias("false_reject"), F.count_if(~a & ~e).alias("true_reject"))
