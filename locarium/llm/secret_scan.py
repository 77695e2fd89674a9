"""Secret scans by patterns and by character Markov models, in DataFrame functions only.

Three fixed patterns find the plain cases. The models learn from labelled
samples: long tokens inside those matches are labelled random; words that
two or more texts of the corpus have, and long tokens made of such words
alone, are labelled ordinary; the rest has no label. A first-order Markov model of either
kind, of three quarters of the samples, gives every remaining token a
log-likelihood ratio, and tokens far on the random side are added. The other
quarter tells how often that errs (:func:`held_out_errors`).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The patterns of the three kinds, with the least length of a match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge, and those that are digits alone, which they don't.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_BLOCK = 128
_N = len(ALPHABET) + 1  # the last symbol stands before a token
#: Tokens that may be samples of ordinary identifiers: words, joined in any usual way.
ORDINARY = "^(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}|[-_/=+])+$"
#: The words of such a token.
PART = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"
#: Letters from which a word of the corpus is a sample.
LONG_WORD = 4
#: One sample in so many, by its hash, is held out of training.
HELD_OUT = 4
#: Log-likelihood ratio from which a token counts as random: odds of a secret of one in some 20,000 before, evens after.
RATIO = 10.0


def _found(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, said>>`` of leftmost non-overlapping matches, in code points.

    The gaps between matches and the matches themselves add up to positions:
    within blocks of ``_BLOCK`` matches first, then over the blocks, so that a
    text of very many matches costs little more for each.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"))
    kind = "array<struct<start:int,end:int,said:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["said"])
        span = F.struct(start.alias("start"), end.alias("end"), x["said"].alias("said"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["said"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def blocks(all_pieces: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_pieces), F.lit(_BLOCK))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(all_pieces, i, F.lit(_BLOCK)), none, step))

    def placed(of: Column) -> Column:
        begins = F.aggregate(of, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b["at"]))
        moved = F.transform(F.arrays_zip(of.alias("of"), begins.alias("by")), lambda z: F.transform(z["of"]["out"], lambda s: F.struct((s["start"] + z["by"]).alias("start"), (s["end"] + z["by"]).alias("end"), s["said"].alias("said"))))
        return F.flatten(F.filter(moved, lambda m: m.isNotNull()))

    return _with(_with(pieces, blocks), placed)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once for a row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _spans(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Matches of the patterns and long tokens of every text."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def of(kind: int, pattern: str) -> Column:
        spans = F.transform(_found(text, pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["said"].alias("said")))
        if kind == 0:
            spans = F.filter(spans, lambda x: F.char_length(F.regexp_extract(x["said"], ASSIGN, 2)) >= 6)
        # a cheap test first: few texts have any match
        return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,said:string>>"))

    return rows.select("id", *keep, of(0, ASSIGN).alias("assign"), of(1, ACCESS).alias("access"), of(2, HEX).alias("hex"), of(3, TOKEN).alias("tokens"))



def _steps(token: Column) -> Column:
    """A token's transitions as ``from * n + to``; the first comes from the symbol before a token."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    at = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.arrays_zip(F.concat(F.array(F.lit(_N - 1)), F.slice(at, F.lit(1), F.size(at) - 1)).alias("from"), at.alias("to"))
    return F.transform(pairs, lambda x: x["from"] * _N + x["to"])


def _held(base: Column) -> Column:
    """Sorted spans in blocks with their bounds, so that a token is compared with few of them."""

    def bounds(block: Column) -> Column:
        return F.struct(F.get(block, 0)["start"].alias("first"), F.array_max(F.transform(block, lambda b: b["end"])).alias("last"), block.alias("spans"))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(base), F.lit(1)), F.lit(_BLOCK))
    return F.transform(firsts, lambda i: _with(F.slice(base, i, F.lit(_BLOCK)), bounds))


def _overlaps(token: Column, held: Column) -> Column:
    def within(block: Column) -> Column:
        near = (block["first"] < token["end"]) & (token["start"] < block["last"])
        return F.when(near, F.exists(block["spans"], lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))).otherwise(False)

    return F.exists(held, within)


def labelled_samples(spans: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``said, random, held_out``: every distinct sample that has a label, once however often it stands.

    ``spans`` has ``tokens`` and sorted ``base``, ``docs`` the texts. A long
    token that overlaps a base span anywhere is random. Ordinary are the words
    that two or more distinct texts have, of at least LONG_WORD letters, as
    they stand and in capitals, and the other long tokens of the shape ORDINARY whose words, whatever their
    case, are all among such words of any length. Null texts have no words.
    """
    said = _with(_held(F.col("base")), lambda held: F.transform("tokens", lambda t: F.struct(t["said"].alias("said"), _overlaps(t, held).alias("random"))))
    tokens = spans.where(F.size("tokens") > 0).select(F.explode(said).alias("t")).groupBy(F.col("t.said").alias("said")).agg(F.bool_or("t.random").alias("random"))
    tokens = stored(tokens.where(F.col("random") | F.col("said").rlike(ORDINARY)))
    text = F.col(text_col).cast("string")
    # a word's texts are told apart by their hashes; whether there are two shows in the least and the largest
    words = docs.select(F.xxhash64(text).alias("digest"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)))).alias("word"))
    words = stored(words.groupBy("word").agg(F.min("digest").alias("least"), F.max("digest").alias("most")))
    known = words.groupBy(F.lower("word").alias("word")).agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
    parts = tokens.where(~F.col("random")).select("said", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("said", F.lit(PART), F.lit(0)), F.lower))).alias("word"))
    strange = parts.join(known, "word", "left_anti").select("said").distinct()
    long_words = words.where((F.col("least") != F.col("most")) & (F.length("word") >= LONG_WORD)).select(F.explode(F.array("word", F.upper("word"))).alias("said"), F.lit(False).alias("random"))
    samples = tokens.join(strange, "said", "left_anti").unionByName(long_words).groupBy("said").agg(F.bool_or("random").alias("random"))
    return samples.withColumn("held_out", F.pmod(F.xxhash64(F.lower("said")), F.lit(HELD_OUT)) == 0)


def markov_ratios(tokens: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary.

    ``tokens`` has ``said`` and ``random``. At most n x n counts of each kind
    come to the driver. The random model is half the learned one and half
    uniform, so that random strings of an alphabet not seen among the samples
    count too. The ordinary one falls back on the symbols' own shares.
    """
    counts = {True: [0.0] * (_N * _N), False: [0.0] * (_N * _N)}
    for r in tokens.select("random", F.explode(_steps(F.col("said"))).alias("step")).groupBy("random", "step").agg(F.count("*").alias("n")).collect():
        counts[r["random"]][r["step"]] = float(r["n"])
    out = []
    chance = 1 / (_N - 1)
    # how common each symbol is in ordinary tokens, whatever stands before it
    seen = [sum(counts[False][b::_N]) for b in range(_N)]
    alone = [(n + 0.5) / (sum(seen) + 0.5 * _N) for n in seen]
    for a in range(_N):
        rows = {k: c[a * _N : (a + 1) * _N] for k, c in counts.items()}
        total = {k: sum(c) for k, c in rows.items()}
        for b in range(_N):
            p = {k: (rows[k][b] + 20 * chance) / (total[k] + 20) for k in rows}
            ordinary = (rows[False][b] + 20 * alone[b]) / (total[False] + 20)
            out.append(math.log((0.5 * p[True] + 0.5 * chance) / ordinary))
    return out


def _score(token: Column, ratios: list[float]) -> Column:
    table = F.array(*[F.lit(float(x)) for x in ratios])
    return F.aggregate(_steps(token), F.lit(0.0), lambda acc, s: acc + F.element_at(table, (s + 1).cast("int")))


def held_out_errors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``random, tokens, wrong``: of the samples held out, how many of either label there are and how many the models take for the other.

    A label without samples held out has no row.
    """
    spans = stored(_spans(docs, id_col, text_col, ()).withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))))
    samples = stored(labelled_samples(spans, docs, text_col))
    says = _score(F.col("said"), markov_ratios(samples.where(~F.col("held_out")))) > ratio
    return samples.where("held_out").groupBy("random").agg(F.count("*").alias("tokens"), F.count_if(says != F.col("random")).alias("wrong"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, base, added`` for every row: sorted arrays of ``struct<start, kind, end, said>``.

    ``base`` has all matches of the patterns; ``added`` the tokens that the
    models take for random, of at least 16 characters, not digits alone, and
    apart from base spans. Null and empty texts have neither. Repeated rows
    are all returned; columns named in ``keep`` come along.
    """
    spans = stored(_spans(docs, id_col, text_col, keep))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    table = spans.select("id", *keep, base.alias("base"), "tokens")
    ratios = markov_ratios(labelled_samples(table.select("base", "tokens"), docs, text_col).where(~F.col("held_out")))
    added = _with(_held(F.col("base")), lambda held: F.filter("tokens", lambda t: ~_overlaps(t, held) & ~t["said"].rlike("^[0-9]+$") & (_score(t["said"], ratios) > ratio)))
    return table.select("id", *keep, "base", F.when(F.size("tokens") > 0, F.array_sort(added)).otherwise(F.col("tokens")).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
