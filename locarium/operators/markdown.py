"""Markdown documents as chunks with ids, sections and line numbers.

A table function scans each document once, line by line, and gives the parts
of its sections; ids and what titles tell are column expressions over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions.text import slug

# What opens a fence, a heading, a list item and a heading too deep for a section.
FENCE, HEADING, ITEM, DEEP = r"^ {0,3}(`{3,}|~{3,})", r"^(#{1,6})[ \t]+(.*?)[ \t]*$", r"^(?:[-*+]|\d{1,9}[.)])[ \t]", r"^#{4,6}[ \t]"
#: Headings up to this level begin a section.
SPLIT_LEVEL = 3
_FENCE, _HEADING, _ITEM, _DEEP = (re.compile(p) for p in (FENCE, HEADING, ITEM, DEEP))


@dataclass
class Line:
    """A line with its offset: of a fence (``fence`` numbers it), a section heading (``level``), or any other."""

    start: int
    text: str
    fence: int = 0
    level: int = 0
    title: str = ""


def read_lines(text: str) -> tuple[list[Line], bool]:
    """The lines of a document, and whether its last fence is open at the end.

    A fence ends at a line of nothing but its mark, as often as it was opened with or more.
    """
    out, at, fences, mark = [], 0, 0, ""
    for said in text.split("\n"):
        line = Line(at, said)
        at += len(said) + 1
        if mark:
            line.fence = fences
            bare = said.strip()
            if bare and not bare.strip(mark[0]) and len(bare) >= len(mark):
                mark = ""
        elif m := _FENCE.match(said):
            mark, fences = m[1], fences + 1
            line.fence = fences
        elif (m := _HEADING.match(said)) and len(m[1]) <= SPLIT_LEVEL:
            line.level, line.title = len(m[1]), m[2]
        out.append(line)
    return out, bool(mark)


def blocks(lines: list[Line]) -> list[tuple[int, int, int]]:
    """``(start, end, index of its first line)`` of the atomic blocks of a section's lines: fences, tables, list items, paragraphs.

    Each list item is a block, with what follows it up to the next block and
    with indented lines after blank ones; a heading of level 4 to 6 begins one.
    """
    found: list[list[int]] = []
    kind, indented = "", False
    after = [False] * len(lines)  # whether the next line that isn't blank is indented
    for i in range(len(lines) - 1, -1, -1):
        after[i] = indented
        if lines[i].text.strip():
            indented = lines[i].text[0] in " \t"
    for i, line in enumerate(lines):
        end = line.start + len(line.text)
        if line.fence:
            if kind == f"fence {line.fence}":
                found[-1][1] = end
            else:
                kind = f"fence {line.fence}"
                found.append([line.start, end, i])
            continue
        if not line.text.strip():
            if not (kind == "item" and after[i]):
                kind = ""
            continue
        table, item = line.text.startswith("|"), bool(_ITEM.match(line.text))
        if kind in ("table", "item", "text") and table == (kind == "table") and not item and not _DEEP.match(line.text):
            found[-1][1] = end
            continue
        kind = "table" if table else "item" if item else "text"
        found.append([line.start, end, i])
    return [(a, b, i) for a, b, i in found]


def packed(pieces: list[tuple[int, int, int]], most: int, least: int) -> list[tuple[int, int, int]]:
    """Neighbouring blocks together up to ``most`` characters, the heading always with the first block.

    A part under ``least`` then goes to the next one, the last to the one before.
    """
    if len(pieces) > 1:
        pieces = [(pieces[0][0], pieces[1][1], pieces[0][2]), *pieces[2:]]
    parts: list[tuple[int, int, int]] = []
    for p in pieces:
        if parts and p[1] - parts[-1][0] <= most:
            parts[-1] = (parts[-1][0], p[1], parts[-1][2])
        else:
            parts.append(p)
    out: list[tuple[int, int, int]] = []
    short = False
    for p in parts:
        if short:
            p = (out[-1][0], p[1], out.pop()[2])
        out.append(p)
        short = p[1] - p[0] < least
    if short and len(out) > 1:
        last = out.pop()
        out[-1] = (out[-1][0], last[1], out[-1][2])
    return out


def problem_of(heads: list[tuple[int, Line]], lines: list[Line], unclosed: bool) -> str | None:
    """What keeps a document from being cut into sections, if anything does."""
    if unclosed:
        return "a fence is never closed"
    if not heads or heads[0][1].level != 1 or any(x.text.strip() for x in lines[: heads[0][0]]):
        return "it doesn't begin with a heading of level 1"
    if sum(h.level == 1 for _, h in heads) > 1:
        return "it has several headings of level 1"
    above = 0
    for _, h in heads:
        if h.level == SPLIT_LEVEL and above < 2:
            return "a heading of level 3 has none of level 2 above it"
        above = 2 if h.level == 2 else 0 if h.level == 1 else above
    return None


_PARTS = "problem string, level int, title string, path array<string>, section string, body string, part int, parts int, start bigint, `end` bigint, line int"


@F.udtf(returnType=_PARTS)
class Parts:
    """The parts of a document's sections, in order; a document that can't be cut gives its problem alone."""

    def eval(self, text: str, most: int, least: int) -> Iterator[tuple]:
        if text is None:
            return
        lines, unclosed = read_lines(text)
        heads = [(i, x) for i, x in enumerate(lines) if x.level]
        if problem := problem_of(heads, lines, unclosed):
            yield (problem, *[None] * 10)
            return
        trail: list[str] = []
        for k, (i, head) in enumerate(heads):
            trail = [*trail[: head.level - 1], head.title]
            own = lines[i : heads[k + 1][0] if k + 1 < len(heads) else len(lines)]
            while own and not own[-1].text.strip():
                own.pop()
            if len(own) < 2:
                continue  # a heading without text of its own
            end = own[-1].start + len(own[-1].text.rstrip(" \t"))
            parts = packed(blocks(own), most, least)
            for n, (a, b, at) in enumerate(parts, 1):
                yield (None, head.level, head.title, trail, trail[1] if len(trail) > 1 else None, text[head.start : end], n, len(parts), a, min(b, end), i + at + 1)


def _one(found: Column) -> Column:
    """The only value of an array, else null."""
    return F.when(F.size(F.array_distinct(found)) == 1, F.element_at(found, 1))


def chunk_rows(docs: DataFrame, key: str = "doc_id", name: str = "slug", topic: str = "topic", most: int = 1500, least: int = 200, topics: dict[str, str] | None = None, milestone_topics: dict[int, str] | None = None) -> DataFrame:
    """A row per chunk of ``docs(key, name, topic, text)``, text with line feeds alone.

    ``key, chunk_id, topic, section_path, heading_level, decision_id, milestone,
    part, parts, oversize, char_count, line_start, content_sha256,
    source_sha256, text``. Ids are ``kb/<name>/<section>``, with ``#<part>``
    where a section has several; the section is 'intro' for the title's own
    text, ``d-<number>`` for a decision, else the slugs of its path. A topic
    comes of the section's heading, else of its milestone, else of the
    document. A document that can't be cut is an error, as is a heading without
    a slug; null texts have no chunks. Columns beside the four aren't read.
    """
    read = docs.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(topic).alias("of"), "text")
    parts = read.lateralJoin(Parts(F.col("text").outer(), F.lit(most), F.lit(least)))
    title, piece = F.col("title"), F.substr("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    number = F.regexp_extract(title, r"^D-(\d{3}):", 1)
    of_title = F.regexp_extract(title, r"\bMilestone (\d+)\b", 1)
    dated = F.coalesce(F.element_at(F.filter(F.split("body", "\n"), lambda x: x.startswith("- **Date:**")), 1), F.lit(""))
    of_date = F.when(number != "", F.regexp_extract(dated, r"\bMilestone (\d+)\b", 1)).otherwise("")
    milestone = F.when(of_title != "", of_title).when(of_date != "", of_date).cast("int")
    slugs = F.transform(F.slice("path", F.lit(2), F.size("path")), lambda t: slug(t))
    section = F.when(F.col("level") == 1, "intro").when((F.col("level") == 2) & (number != ""), F.concat(F.lit("d-"), number)).otherwise(F.array_join(slugs, "/"))
    base = F.concat(F.lit("kb/"), F.col("name"), F.lit("/"), section)
    fault = F.when(F.col("problem").isNotNull(), F.col("problem")).when((F.col("level") > 1) & F.exists(slugs, lambda s: s == ""), F.concat(F.lit("no slug for the heading "), title))
    lookup = lambda of, table: F.coalesce(F.lit(None).cast("string"), *[F.when(of == F.lit(k), F.lit(v)) for k, v in (table or {}).items()])
    chunk_id = F.when(fault.isNotNull(), F.raise_error(F.concat(F.col("key").cast("string"), F.lit(": "), fault))).when(F.col("parts") == 1, base).otherwise(F.concat(base, F.lit("#"), F.col("part").cast("string")))
    return parts.select(
        F.col("key").alias(key), chunk_id.alias("chunk_id"), F.coalesce(lookup(F.col("section"), topics), lookup(milestone, milestone_topics), F.col("of")).alias("topic"), F.col("path").alias("section_path"),
        F.col("level").alias("heading_level"), _one(F.regexp_extract_all(title, F.lit(r"\b(D-\d{3})\b"), F.lit(1))).alias("decision_id"), milestone.alias("milestone"), "part", "parts",
        (F.char_length(piece) > most).alias("oversize"), F.char_length(piece).alias("char_count"), F.col("line").alias("line_start"), F.sha2(piece.cast("binary"), 256).alias("content_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), piece.alias("text"),
    )


def search_text(chunks: DataFrame) -> Column:
    """What an index reads of a chunk: the titles above it, then its text."""
    return F.concat(F.array_join(chunks["section_path"], " "), F.lit("\n"), chunks["text"])
