"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """No byte-order mark, and line feeds alone as line ends."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def slug(text: Column, by: str = "-") -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one ``by``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", by), f"^{by}+|{by}+$", "")


def tokens(text: Column) -> Column:
    """Words of letters, marks, digits and underscores in lower case; one with underscores is followed by its parts."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("_")), F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: p != ""))).otherwise(F.array(w))))


def number_tokens(text: Column) -> Column:
    """Numbers as they are displayed: digits, with points or commas inside."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1))


def signed_number_tokens(text: Column) -> Column:
    """Numbers of a statement: thousands in threes, a fraction, a sign not after a word, a percent sign. Ids are masked first."""
    masked = F.regexp_replace(text, r"\b[a-z]+-[0-9a-f]{12}\b", "ID")
    return F.regexp_extract_all(masked, F.lit(r"(?<!\w)(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?)"), F.lit(1))


def stable_id(prefix: str, text: Column) -> Column:
    """``prefix-`` and the first twelve hex digits of the text's SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 12))


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
