"""Registered queries that have no SQL, against brute force over the whole smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from sparkloom.operators import structure as S
from sparkloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return lambda sql: duckdb.sql(sql.replace("@", SF)).fetchall()


def plain_mmr(hits, k):
    taken = []
    while hits and len(taken) < k:
        def worth(h):
            def alike(t):
                a, b = ({w for w in x[4].lower().split() if len(w) > 1} for x in (h, t))
                j = len(a & b) / len(a | b) if a | b else 0.0
                if h[2] != t[2]:
                    return 0.65 * j
                return {0: 1.0, 1: 0.85}.get(abs(h[3] - t[3]), min(1.0, 0.45 + 0.45 * j))

            return 0.7 * h[1] - 0.3 * max(map(alike, taken), default=0.0)

        best = max(hits, key=lambda h: (round(worth(h), 12), h[1], -h[0]))
        hits = [h for h in hits if h is not best]
        taken.append(best)
    return [h[0] for h in taken]


def test_mmr_diversify(spark, rows):
    docs = {i: (s, i % 7, t) for i, s, t in rows("SELECT doc_id, source, text FROM '@/documents.parquet'")}
    first = {}
    for r in QUERIES["fts_or_topk"](spark, SF).collect():
        first.setdefault(r.query_id, []).append((r.id, r.score, *docs[r.id]))
    got = {}
    for r in QUERIES["mmr_diversify"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.id
    assert {q: [p[k] for k in sorted(p)] for q, p in got.items()} == {q: plain_mmr(h, 8) for q, h in first.items()}


@pytest.mark.parametrize("name, recursive", [("paragraph_chunks", False), ("recursive_chunks", True)])
def test_text_chunks(spark, rows, name, recursive):
    got = {}
    for r in QUERIES[name](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.char_start, r.char_end, r.text)
    texts = rows("SELECT doc_id, text FROM '@/documents.parquet' WHERE text IS NOT NULL")
    assert set(got) == {i for i, t in texts if t.strip()}
    for i, t in texts:
        if t.strip():
            chunks = [got[i][k] for k in range(len(got[i]))]
            letters = "".join(x for _, _, x in chunks)
            assert all(0 < len(x) <= 800 for _, _, x in chunks) and (len(t) > 800 or letters == t.strip())
            assert all(w in letters for w in t.split()[:3] + t.split()[-3:] if len(w) < 100)


def test_pages(spark, rows):
    """What a reader of the page sees is in its Markdown, its blocks and its chunks, in order; scripts are not."""
    pages = dict(rows("SELECT page_id, html FROM '@/pages.parquet'"))
    markdown = {r.page_id: r.markdown for r in QUERIES["html_to_markdown"](spark, SF).collect()}
    assert set(markdown) == set(pages) and all("track(" not in m and "margin:0" not in m and "<p" not in m for m in markdown.values())
    blocks, chunks = {}, {}
    for r in QUERIES["markdown_blocks"](spark, SF).collect():
        blocks.setdefault(r.doc_id, {})[r.block] = r
    for r in QUERIES["markdown_chunks"](spark, SF).collect():
        chunks.setdefault(r.doc_id, {})[r.chunk_index] = r
    for i, m in markdown.items():
        own = [blocks[i][k] for k in range(len(blocks.get(i, {})))]
        assert "".join(b.text for b in own).split() == m.split() or "".join("".join(b.text for b in own).split()) == "".join(m.split())
        assert all(m[b.start : b.end].strip() == b.text.strip() for b in own)
        parts = [chunks[i][k] for k in range(len(chunks.get(i, {})))]
        assert all((c.loc_type == "slide") == (i % 2 == 0) and len(c.text) <= 800 for c in parts)
        assert {c.kind for c in parts} <= {"heading", "paragraph", "code", "table"} and len(parts) >= len(own) - 1
    assert S.html_to_markdown(None) == ""


def test_search_diverse(spark):
    """Each query has eight hits with the texts around them, in falling order of pick."""
    found = QUERIES["search_diverse"](spark, SF).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r["rank"])
    assert by and all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 8 for x in by.values()) and all(r.context_md5 for r in found)
