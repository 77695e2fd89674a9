"""Quality rules with risk-controlled cutoffs.

A rule rejects a text whose figure exceeds a cutoff. Cutoffs come from
labelled rows: for each stratum (language) and rule, an exact binomial test
over the labelled good texts must show that at most a given share of them is
rejected. Cutoffs are tried from the loosest on and the first failure ends the
search, which needs no correction; rules and strata are corrected for by
Bonferroni's inequality.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
#: Share of good texts that all rules together may reject in a stratum, and the chance of a breach.
RISK = 0.05
BREACH = 0.05
_SPACE = "\x20\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Figures, as expressions over the base columns, and the cutoffs tried from the loosest on.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [5, 4, 3, 2.5, 2, 1.5, 1.2, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "upper": ("n_upper / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25]),
    "marks": ("n_marks / greatest(n_words, 1)", [5, 4, 3, 2.5, 2, 1.5, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "word_length": ("word_chars / greatest(n_words, 1)", [100, 60, 40, 30, 25, 20, 18, 16, 14, 12]),
}
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    pair = at[:-1] * len(known) + at[1:]
    if len(known) > 2_000_000:  # the product of three would not fit
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, count = np.unique(pair[:-1] * len(known) + at[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def figures(text: str | None) -> tuple[int, ...]:
    """The base figures of a text, in the order of ``_FIELDS``; null is an empty text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    doubled = lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            doubled += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        doubled,
        repeat_words(words),
        upper_case(text),
        text.count("!") + text.count("?"),
        lines,
    )


_IS_UPPER: list[np.ndarray] = []


def upper_case(text: str) -> int:
    """Upper-case characters, by Unicode's property."""
    if not _IS_UPPER:
        _IS_UPPER.append(np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000))
    return int(_IS_UPPER[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())


def measure(text: Column) -> Column:
    """The base figures as a struct."""

    @F.pandas_udf(", ".join(f"{f} long" for f in _FIELDS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([figures(t) for t in texts], columns=list(_FIELDS), dtype="int64")

    return run(text)


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, by exact terms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.concatenate(([0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)))))
    terms = steps + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def cutoffs(measured: DataFrame, good: DataFrame, risk: float = RISK, breach: float = BREACH) -> DataFrame:
    """``stratum`` and a column per rule: the tightest certified cutoff, null where none is.

    ``measured`` has ``id, stratum`` and the rules' figures, ``good`` the ids
    of labelled good texts. The upper confidence bound of a cutoff's false
    rejections is at most risk/rules exactly when so few of n texts would be
    rejected with probability at most breach/(rules x strata).
    """
    per_rule = risk / len(RULES)
    rows = []
    for name, (_, tried) in RULES.items():
        # the number of cutoffs, from the loosest on, that would reject the text
        over = sum((F.when(F.col(name) > c, 1).otherwise(0) for c in tried[1:]), F.when(F.col(name) > tried[0], 1).otherwise(0))
        rows.append(F.struct(F.lit(name).alias("rule"), (F.lit(len(tried)) - over).alias("first")))
    # `first` is the place of the loosest cutoff that rejects a text
    held = measured.join(good, "id").select("stratum", F.explode(F.array(*rows)).alias("r")).groupBy("stratum", "r.rule", "r.first").agg(F.count("*").alias("n"))
    held = stored(held)
    strata = held.select("stratum").distinct().count()
    level = breach / (len(RULES) * max(strata, 1))

    @F.pandas_udf("boolean")
    def certified(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b), per_rule) <= level for a, b in zip(n, k, strict=True)])

    spark = measured.sparkSession
    grid = spark.createDataFrame([(name, i, float(c)) for name, (_, tried) in RULES.items() for i, c in enumerate(tried)], "rule string, place int, cutoff double")
    total = held.groupBy("stratum", "rule").agg(F.sum("n").alias("total"))
    steps = total.join(grid, "rule")
    same = F.col("a.stratum").eqNullSafe(F.col("b.stratum")) & (F.col("a.rule") == F.col("b.rule")) & (F.col("b.first") <= F.col("a.place"))
    counts = steps.alias("a").join(held.alias("b"), same, "left").groupBy("a.stratum", "a.rule", "a.place", "a.cutoff", "a.total").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("k"))
    ok = counts.withColumn("ok", certified("total", "k"))
    upto = F.min(F.col("ok").cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("place"))
    best = ok.withColumn("upto", upto).where("upto = 1").groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"max_{name}") for name in RULES])
    return best


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, breach: float = BREACH) -> DataFrame:
    """``id``, base figures, ``base_failed``, ``kept`` and the cutoffs used, for every document.

    Null texts have no words and fail the base rules (fewer than 50 words, or
    repeated windows over half of them). A stratum without enough labelled
    good texts has no cutoffs; null is a stratum. Texts with conflicting labels
    count as good if any label says so. Repeated rows are all returned.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), measure(F.col(text_col).cast("string")).alias("m")).select("id", "stratum", "m.*")
    measured = stored(base.withColumns({name: F.expr(e).cast("double") for name, (e, _) in RULES.items()}))
    good = labels.where("quality = 1").select(F.col(id_col).alias("id")).where("id is not null").distinct()
    limits = stored(cutoffs(measured, good, risk, breach))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over: Column = F.lit(False)
    for name in RULES:
        over = over | F.coalesce(F.col(name) > F.col(f"max_{name}"), F.lit(False))
    joined = measured.alias("m").join(limits.alias("l"), F.col("m.stratum").eqNullSafe(F.col("l.stratum")), "left").drop(F.col("l.stratum"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
