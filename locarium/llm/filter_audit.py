"""Audit of how filters interact, by walking the trie of their permutations.

What survives a set of filters doesn't depend on their order. The trie of all
orders is walked depth first; each node looks up the state of its unordered
prefix, so that of n! orders only 2^n states are ever made, each as a table of
survivors that is filtered from one of its parents and written. Every edge
counts the rows that its filter removes from its state.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored
from .exact_dedup import COUNTERS, frequent_digests

FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _first_ids(keyed: DataFrame, counters: int) -> DataFrame:
    """Add ``first``, the smallest id of the row's digest; frequent digests are settled where their rows lie."""
    least = F.min("id").alias("first")
    heavy = frequent_digests(keyed, counters)
    # A proven bound: at most `counters` rows of some 100 bytes.
    winners = stored(keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_semi").groupBy("digest").agg(least))
    at_home = keyed.join(F.broadcast(winners), "digest")
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return at_home.unionByName(rest.join(rest.groupBy("digest").agg(least), "digest"))


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", counters: int = COUNTERS) -> DataFrame:
    """``part, good, toxic`` and a boolean per filter, true if it fails, of every document.

    E fails a text that is identical to that of any smaller id. Null texts are
    empty, a null part is ''. A null id is neither smaller nor larger than any
    and has no labels; of several labels of an id the highest counts.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    keyed = stored(docs.select(F.col(id_col).alias("id"), part, digest.alias("digest"), *[c.alias(k) for k, c in text_failures(F.col(text_col).cast("string")).items()]))
    judged = _first_ids(keyed, counters).withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("digest", "first")
    of = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    known = judged.where("id is not null").join(of, F.col("id") == F.col("doc_id"), "left")
    nameless = judged.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    names = ["part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], *FILTERS]
    return stored(known.select(*names).unionByName(nameless.select(*names)))


class Trie:
    """The states and edges of a permutation trie over ``rows``, whose boolean column of each filter is true where it fails."""

    def __init__(self, rows: DataFrame, filters: str = FILTERS):
        self.filters = filters
        self.survivors: dict[frozenset[str], DataFrame] = {frozenset(): rows}
        self.edges: list[DataFrame] = []

    def walk(self, prefix: str = "") -> Trie:
        """Visit ``prefix`` and, the first time its state is met, the filters that may follow it."""
        state = frozenset(prefix)
        rows, free = self.survivors[state], [f for f in self.filters if f not in state]
        self.edges.append(self._removals(rows, state, free))
        for f in free if len(free) > 1 else ():
            if state | {f} not in self.survivors:
                left = rows.where(~F.col(f))
                # a state with one filter to go is read once, by its only edge
                self.survivors[state | {f}] = stored(left) if len(free) > 2 else left
                self.walk(prefix + f)
        return self

    def _removals(self, rows: DataFrame, state: frozenset[str], free: list[str]) -> DataFrame:
        """``part, state, filter, here, removed, good_lost, toxic_lost`` of the edges out of a state, in one pass over its survivors."""
        lost = [F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in free]
        counted = rows.groupBy("part").agg(F.count("*").alias("here"), F.array(*lost).alias("edges"))
        return counted.select("part", F.lit("".join(sorted(state))).alias("state"), "here", F.inline("edges"))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``filter_order, step, state, filter``: every step of every order, and the state before it; a table of n! n rows."""
    rows = [("".join(p), i + 1, "".join(sorted(p[:i])), p[i]) for p in permutations(filters) for i in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, state string, filter string")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", counters: int = COUNTERS) -> DataFrame:
    """One row per part, order of the filters and step of it, zeros included.

    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``: documents of the part that are left after
    the step, that it removes, that fail its filter and went before, that fail
    its filter alone, removed ones of quality 1, removed toxic ones, and the
    filter's removals summed over all orders. Parts are the values of
    ``part_col``, null taken as ''. Repeated rows count each; rows that share
    an id share its labels, and none of them is the smaller. An empty table
    gives no rows; other columns aren't read. See :func:`verdicts` for nulls.
    """
    rows = verdicts(docs, labels, id_col, text_col, part_col, counters)
    trie = Trie(rows).walk()
    edges = stored(reduce(DataFrame.unionByName, trie.edges))
    others = {f: reduce(lambda a, b: a | b, [F.col(g) for g in FILTERS if g != f]) for f in FILTERS}
    alone = [F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("fails"), F.count_if(F.col(f) & ~others[f]).alias("unique_fails")) for f in FILTERS]
    whole = stored(rows.groupBy("part").agg(F.array(*alone).alias("of")).select("part", F.inline("of")))
    # A state of k filters comes before one of the others in k! (n - 1 - k)! orders.
    n = len(FILTERS)
    ways = reduce(lambda a, k: F.when(F.length("state") == k, F.lit(factorial(k) * factorial(n - 1 - k))).otherwise(a), range(n), F.lit(0))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = F.broadcast(orders(docs.sparkSession))  # 600 rows
    out = whole.join(steps, "filter").join(edges, ["part", "state", "filter"], "left").join(shapley, ["part", "filter"], "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = count(F.col("removed"))
    return out.select(
        "part", "filter_order", "step", (count(F.col("here")) - removed).alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails",
        *[count(F.col(c)).alias(c) for c in ("good_lost", "toxic_lost", "shapley")],
    )
