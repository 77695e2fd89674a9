import hashlib

import pytest

from locarium.operators import markdown

DOC = """# Title
Opening words.

## D-007: Keep it
- **Date:** 2026, Milestone 4
- one
  more of one

  and still one
- two

not two
| a | b |
| - | - |
after
#### Deep
under deep

~~~
# no heading
```
still in

~~~
## Empty
## Part B (D-001, D-002)
### Leaf Milestone 9
text


"""


def rows(spark, text, most=1500, least=0, **more):
    df = spark.createDataFrame([(1, "data-sources", "general", text, 3)], "doc_id int, slug string, topic string, text string, path int")
    return markdown.chunk_rows(df, most=most, least=least, **more).collect()


def test_blocks_of_every_kind():
    lines, unclosed = markdown.read_lines(DOC)
    assert not unclosed
    first = next(i for i, x in enumerate(lines) if x.level == 2)
    last = next(i for i, x in enumerate(lines) if x.title == "Empty")
    got = [DOC[a:b] for a, b, _ in markdown.blocks(lines[first:last])]
    assert got == [
        "## D-007: Keep it", "- **Date:** 2026, Milestone 4", "- one\n  more of one\n\n  and still one", "- two", "not two", "| a | b |\n| - | - |", "after", "#### Deep\nunder deep", "~~~\n# no heading\n```\nstill in\n\n~~~",
    ]


def test_chunk_ids_sections_and_lines(spark):
    got = rows(spark, DOC, topics={"Part B (D-001, D-002)": "b"}, milestone_topics={4: "four", 9: "nine"})
    assert [(r["chunk_id"], r["line_start"], r["topic"], r["decision_id"], r["milestone"], r["heading_level"], r["parts"]) for r in got] == [
        ("kb/data-sources/intro", 1, "general", None, None, 1, 1),
        ("kb/data-sources/d-007", 4, "four", "D-007", 4, 2, 1),
        ("kb/data-sources/part-b-d-001-d-002/leaf-milestone-9", 27, "b", None, 9, 3, 1),
    ]
    assert got[2]["section_path"] == ["Title", "Part B (D-001, D-002)", "Leaf Milestone 9"] and got[2]["text"] == "### Leaf Milestone 9\ntext"
    for r in got:
        assert r["char_count"] == len(r["text"]) and r["text"] in DOC and r["content_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert DOC.split("\n")[r["line_start"] - 1] == r["text"].split("\n")[0] and r["source_sha256"] == hashlib.sha256(DOC.encode()).hexdigest()


def test_parts_are_numbered_and_small_ones_joined(spark):
    body = "\n\n".join(c * n for c, n in (("a", 30), ("b", 300), ("c", 40), ("d", 50), ("e", 5)))
    got = rows(spark, f"# T\n\n{body}\n", most=100, least=20)
    assert [r["chunk_id"] for r in got] == [f"kb/data-sources/intro#{k}" for k in (1, 2, 3)] and [r["oversize"] for r in got] == [False, True, False]
    assert [r["text"] for r in got] == ["# T\n\n" + "a" * 30, "b" * 300, "c" * 40 + "\n\n" + "d" * 50 + "\n\n" + "e" * 5]
    assert markdown.packed([(0, 5, 0), (6, 10, 1), (11, 200, 2), (201, 203, 3)], 50, 20) == [(0, 203, 0)]
    assert markdown.packed([(0, 60, 0), (61, 130, 1), (131, 190, 2), (191, 199, 3)], 60, 20) == [(0, 130, 0), (131, 199, 2)]


@pytest.mark.parametrize(
    ("text", "why"),
    [("# T\n```\nx", "never closed"), ("words\n# T\nx", "begin"), ("## T\nx", "begin"), ("", "begin"), ("# T\nx\n# U\ny", "several"), ("# T\nx\n### L\ny", "level 2 above"), ("# T\nx\n## !?\ny", "no slug")],
)
def test_documents_that_cannot_be_cut(spark, text, why):
    with pytest.raises(Exception, match=why):
        rows(spark, text)


def test_null_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "t", None)], "doc_id int, slug string, topic string, text string")
    assert markdown.chunk_rows(df).count() == 0 and markdown.chunk_rows(df.limit(0)).count() == 0


def test_headings_without_text_have_no_chunk(spark):
    assert [r["chunk_id"] for r in rows(spark, "# T\n\n## A\n\n## B\nx")] == ["kb/data-sources/b"]
