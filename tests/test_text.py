"""Markdown, search, slices, chunks."""

import random
import re

import pytest

from pyspark.sql import functions as F

from tabledoc.operators import text_ops as tx

MD = """# Cards
intro
```
# not a heading
## nor this
```
## Main Sets
| No | Name |
|----|:---:|
| 1 | Base |
| 2 |  |
### Details
text
| only | header |
|---|---|

## Promo ##
 | a | b | c |
|-|-|-|
| x|y | z |"""


def test_headings(docs_of):
    rows = tx.md_headings(docs_of(MD, "no heading\n#tag", "~~~\n# a\n~~~\n# b\n```\n# c")).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.line, r.level, r.text) for r in rows] == [
        (1, 1, 1, "Cards"), (1, 7, 2, "Main Sets"), (1, 12, 3, "Details"), (1, 17, 2, "Promo"), (3, 4, 1, "b")
    ]


def test_section(docs_of):
    rows = tx.md_section(docs_of(MD, "plain"), "SETS").orderBy("doc_id").collect()
    assert (rows[0].heading, rows[0].start_line, rows[0].end_line) == ("Main Sets", 7, 17)
    assert rows[0].section == "\n".join(MD.split("\n")[6:16])
    assert rows[1].section == "Error: No headings found in markdown content"
    last = tx.md_section(docs_of(MD), "promo").first()
    assert last.end_line is None and last.section == "\n".join(MD.split("\n")[16:])
    missing = tx.md_section(docs_of(MD), "it's", max_listed=tx.SECTION_HEADINGS_LISTED).first()
    assert not missing.found and missing.section.endswith(
        "Available headings:\n  - Cards\n  - Main Sets\n  - Details\n  - Promo"
    )


def test_tables(docs_of):
    rows = tx.md_table_rows(docs_of(MD, "| a |\n| b |")).orderBy("doc_id", "table_no", "row_no").collect()
    assert [(r.doc_id, r.section, r.table_no, r.row_no, r.cells) for r in rows] == [
        (1, "Main Sets", 1, 1, ["No", "Name"]), (1, "Main Sets", 1, 2, ["1", "Base"]), (1, "Main Sets", 1, 3, ["2", ""]),
        (1, "Promo ##", 2, 1, ["a", "b", "c"]), (1, "Promo ##", 2, 2, ["x", "y", "z"]),
        (2, None, 1, 1, ["a"]), (2, None, 1, 2, ["b"]),
    ]


def test_combined_file(spark, docs_of, tmp_path):
    from tabledoc.sources.sinks import write_combined

    write_combined(tx.md_tables_combined(tx.md_table_rows(docs_of(MD, "| \"q\" |\n| b,c |"))), str(tmp_path / "c"))
    parts = sorted((tmp_path / "c").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == (
        "=== Main Sets ===\n\nNo,Name\n1,Base\n2,\n\n=== Promo ## ===\n\na,b,c\nx,y,z\n\n=== Unknown ===\n\n\"\"\"q\"\"\"\n\"b,c\"\n\n"
    )


def brute_grep(text, pattern, n):
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    hits = [i for i, line in enumerate(lines) if re.search(pattern, line, re.I)]
    shown = sorted({j for i in hits for j in range(max(0, i - n), min(len(lines), i + n + 1))})
    return [(j + 1, j in hits, lines[j]) for j in shown]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_grep_context(docs_of, n):
    rng = random.Random(n)
    texts = ["\n".join(rng.choice(["Ab", "x", "", "it's a b"]) for _ in range(rng.randint(0, 12))) for _ in range(30)]
    rows = tx.grep_context(docs_of(*texts), r"a\s?b|it's", n).orderBy("doc_id", "line_no").collect()
    for i, text in enumerate(texts, 1):
        assert [(r.line_no, r.hit, r.line) for r in rows if r.doc_id == i] == brute_grep(text, r"a\s?b|it's", n)


def test_grep_report(docs_of):
    text = "\n".join(["q", "hit", "q", "q", "q", "hit"])
    report = tx.grep_report(docs_of(text, "none"), "HIT", 1).collect()
    assert [r.report for r in report] == ["1-q\n2:hit\n3-q\n--\n5-q\n6:hit"]
    long = tx.grep_report(docs_of("hit " + "x" * 20000), "hit", 0, max_chars=tx.GREP_OUTPUT_CHARS).first().report
    assert len(long) < 15200 and "truncated due to max length" in long
    with pytest.raises(ValueError):
        tx.grep_context(docs_of("x"), "x", -1)


def test_grep_literal(docs_of):
    text = "\n".join(["A.b", "axb", "a.B"] * 6)
    rows = tx.grep_literal(docs_of(text), "a.b", max_lines=tx.GREP_MAX_LINES).collect()
    assert len(rows) == 10 and [r.line_no for r in rows[:4]] == [1, 3, 4, 6]
    assert [r.line_no for r in tx.grep_literal(docs_of(text), "a.B", case_sensitive=True, max_lines=2).collect()] == [3, 6]


def test_byte_slice(docs_of):
    texts = ["aé漢😀z" * 3, "", "plain"]
    for offset in range(0, 14):
        for limit in (0, 1, 2, 3, 4, 5, 9):
            rows = tx.byte_slice(docs_of(*texts), offset, limit).orderBy("doc_id").collect()
            assert [r.slice for r in rows] == [t.encode()[offset:offset + limit].decode("utf-8", "ignore") for t in texts]
        if offset > 4:
            break
    assert [r.slice for r in tx.byte_slice(docs_of("abc", "abcdef"), max_bytes=4).orderBy("doc_id").collect()] == ["abc", None]


def test_chunks(docs_of):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n") if rng.random() < 0.1 else "é" for _ in range(n)) for n in (0, 99, 100, 101, 950)]
    rows = tx.text_chunks(docs_of(*texts), size=100, backoff=20).orderBy("doc_id", "chunk_no").collect()
    for i, text in enumerate(texts, 1):
        mine = [r for r in rows if r.doc_id == i]
        assert "".join(r.chunk for r in mine) == text
        assert [r.chunk_no for r in mine] == list(range(1, len(mine) + 1))
        for r in mine:
            assert text[r.start:r.end] == r.chunk and len(r.chunk) == r.size <= 100
            tail = text[max(r.start, r.start + 80):r.start + 100]
            if r.end < len(text) and "\n" in tail[1:]:
                assert r.chunk.endswith("\n")


def test_map_captures_errors_and_merge_drops_empty(docs_of):
    def fn(text):
        if "boom" in text:
            raise RuntimeError("bad chunk")
        return "No relevant information found in this chunk" if "x" in text else text.upper()

    chunks = tx.text_chunks(docs_of("aaa\nboom\nxxx\nccc", "xxxx"), size=4, backoff=3)
    merged = tx.merge_chunks(tx.map_text(chunks, fn)).collect()
    assert len(merged) == 1 and merged[0].n_results == 3
    assert "=== Chunk 1 (chars 0-4) ===\nAAA\n" in merged[0].merged and "Error processing chunk: bad chunk" in merged[0].merged
    assert merged[0].merged.index("AAA") < merged[0].merged.index("bad chunk") < merged[0].merged.index("CCC")


def test_map_rows_guard_makes_rows_once(spark):
    from tabledoc.operators.tabular import map_rows

    made = spark.sparkContext.accumulator(0)

    def seen(_):
        made.add(1)
        return True

    rows = spark.range(20).where(F.udf(seen, "boolean")("id"))
    assert map_rows(rows, lambda t: t, limit=20).count() == 20 and made.value == 20


def test_row_map_task_has_no_limit(spark, sf_dir, monkeypatch):
    from tabledoc.plans import texts

    given = []
    monkeypatch.setattr(texts, "map_rows", lambda df, fn, **named: given.append(named) or df.withColumn("result", F.lit("")))
    texts.row_map_task(spark, sf_dir)
    assert given == [{}]


def test_map_rows_guard(spark):
    from tabledoc.operators.tabular import map_rows

    assert {r.result for r in map_rows(spark.range(3), lambda t: t).collect()} == {'{"id":0}', '{"id":1}', '{"id":2}'}
    with pytest.raises(ValueError):
        map_rows(spark.range(201), lambda t: t, limit=200)


def test_finder(docs_of):
    found = tx.find_in_chunks(docs_of("b@x.io a@x.io b@x.io", "none"), r"\w@x\.io", text="text")
    assert [r.result for r in found.orderBy("doc_id").collect()] == ["a@x.io, b@x.io", "No relevant information found in this chunk"]
    assert found.where(tx.carries_result()).count() == 1
