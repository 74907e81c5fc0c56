"""Top-k search, HTML text, registered queries and the pipeline."""

import collections

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import html_text, near_dup, packing, pii, quality, topk
from ledgerline.llm.html_text import page_text, page_texts
from ledgerline.llm.mixing import poisson_mix
from ledgerline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(query_ids, queries, ids, vectors, k):
    out = []
    for i, q in zip(query_ids, queries):
        scored = sorted((-int(q @ v), int(j)) for j, v in zip(ids, vectors) if j != i)[:k]
        out += [(int(i), j, -s) for s, j in scored]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 8), st.sampled_from([1, 3, 1000, 10**7, 10**9]), st.integers(0, 10**6))
def test_block_search_is_exact(n, width, k, largest, seed):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-largest, largest + 1, (n, width))
    vectors[n // 2 :] = vectors[0]  # many ties
    ids = draw.permutation(n)
    found = topk.search_block(ids[::3], vectors[::3], ids, vectors, k)
    assert sorted(zip(*(x.tolist() for x in found))) == brute(ids[::3], vectors[::3], ids, vectors, k)


def test_search_stops_early():
    draw = np.random.default_rng(0)
    vectors = np.floor(64 * draw.normal(0, 0.125, (4000, 64))).astype(np.int64)
    ids = np.arange(4000)
    whole = topk.search_block(ids[:50], vectors[:50], ids, vectors, 20, depths=(1.0,))
    early = topk.search_block(ids[:50], vectors[:50], ids, vectors, 20, depths=(0.5, 0.7, 0.8, 0.9, 1.0))
    assert all((a == b).all() for a, b in zip(whole, early))


@pytest.mark.parametrize("sizes", [(8192, 1024), (7, 3)])
def test_top_k_on_odd_vectors(spark, sizes):
    rows = [(0, [1.0, 0.5]), (20, [0.25, float("nan")]), (40, [2.0]), (1, None), (2, [1.0, None]), (3, [float("inf"), 0.0]), (4, []), (None, [1.0, 1.0]), (5, [1.0, 0.5]), (5, [1.0, 0.5]), (6, [-1.0, 3.0, 2.0])]
    rows += [(100 + i, [0.5, 0.5]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as block", "true as asks", "3 as query_id")
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 3, candidate_block=sizes[0], query_block=sizes[1]).collect()
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    matrix = np.zeros((len(good), 3), np.int64)
    for k, (_, v) in enumerate(good):
        matrix[k, : len(v)] = np.floor(64 * np.array(v))
    ids = np.array([i for i, _ in good])
    want = brute(ids[ids % 20 == 0], matrix[ids % 20 == 0], ids, matrix, 3)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in found) == want
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a</p>) x</script></head><body>
<h1>Head</h1><p>One <b>two</b><br>three<p>Four &amp; five<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul><ol start=3><li>x<li>y</ol>
<table><tr><th>Name<th>N<tr><td>longer name<td>1<tr><td>b<td>22<td>z</table><div hidden>no</div><div style="Display: none">no</div>
<details><summary>sum</summary>no</details><!-- no --><pre>
 a  b
   c</pre>end</i></span> of <img alt="it"> all"""


def test_layout():
    assert page_text(PAGE) == "\n".join(
        ["Head", "", "One two", "three", "", "Four & five", "", "- a", "- b", "  - c", "  - d", "- e", "", "3. x", "4. y", ""]
        + ["Name         N", "longer name  1", "b            22  z", "", "sum", "", " a  b", "   c", "", "end of it all"]
    )


def test_layout_of_odd_pages(spark):
    pages = [(1, None), (1, ""), (None, "<p>x"), (2, "plain < text & more"), (3, "<div>" * 3000 + "deep" + "</div>" * 3000), (4, "<table><td>a<table><tr><td>b</table><td>c"), (5, "<b>" + "word " * 200_000), (6, "<p title='a > b'>c</p></p></div><li>d")]
    frame = spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "html as text")
    got = [(r["page_id"], r["text"]) for r in page_texts(frame).collect()]
    assert got[:4] == [(1, None), (1, ""), (None, "x"), (2, "plain < text & more")]
    assert got[4] == (3, "deep") and got[5][1].split() == ["a", "b", "c"] or set("abc") <= set(got[5][1])
    assert got[6][1].count("word") == 200_000 and got[7][1] == "c\n\n- d" or got[7][1].split() == ["c", "-", "d"]
    assert page_texts(frame.limit(0)).count() == 0


def test_table_text_outside_of_cells_stays():
    assert page_text("<table><tbody><td>x<td>y<tr><td>z</table>") == "x  y\nz"
    assert page_text("<table><tr><form><td>a<td>b</form></table>") == "a  b"
    assert page_text("<table><tr><b>bold<td>a<td>b</b><tr><td>c</table>") == "bold\na  b\nc"
    assert page_text("<table><tr>one<td>a</td>two</tr><tbody>three<div>four</div><tr><td>b</tbody></table>").split() == ["onetwothree", "four", "a", "b"]
    assert page_text("<table><form><tr><td>a<table><td>b</table><td>c</form></table>end") == "a  c\nb\n\nend"


def test_shown_text_is_not_taken_for_hidden():
    assert page_text("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b") == "a x=2 b"
    assert page_text("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>one</text><text>two</text></svg>") == "one two"
    assert page_text("<i aria-hidden='true'>icon</i> label<desc>yes</desc>") == "icon labelyes"
    assert page_text("<div style='visibility:hidden'>no<b>no</b><b style='visibility: visible'>yes</b><img alt='no'></div>") == "yes"
    assert page_text("<table><tr style='visibility:collapse'><td style='visibility:visible'>no<tr><td>a</table>") == "a"


def test_all_visible_words_stay(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in page_texts(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", r["html"])
        want = collections.Counter(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        got = collections.Counter(w for w in texts[r["page_id"]].split())
        assert not want - got and set(got - want) <= {"-"}


def cell(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(map(cell, r)) for r in df.select(*columns).collect()) == want


def test_every_query_has_rows(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert all(QUERIES[n](spark, SF).count() > 0 for n in ("op2_token_counts", "op4_html_text", "op5_personal_data"))


def test_pipeline_stage_by_stage(spark):
    """Each stage against what its operator alone says about the rows that it got."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    kept = corpus_pipeline.materialize(stages["quality"](spark, docs, SF))
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.columns == columns and ids(kept) == ids(scores.where("predicted = 1"))

    single = corpus_pipeline.materialize(stages["near_duplicates"](spark, kept, SF))
    assert single.columns == columns and ids(single) == ids(near_dup.jaccard_join(kept).where("doc_id = class_id"))

    clean = corpus_pipeline.materialize(stages["personal_data"](spark, single, SF))
    assert clean.columns == columns and ids(clean) == ids(single)
    assert not any(pii.pattern_spans(r["text"])[0] for r in clean.collect())

    mixed = corpus_pipeline.materialize(stages["mixing"](spark, clean, SF))
    assert mixed.columns == columns and ids(mixed) == ids(poisson_mix(clean))

    packed = stages["packing"](spark, mixed, SF)
    pieces = packing.pieces(mixed, packing.default_tokenizer()).collect()
    assert sorted(tuple(r[:5]) for r in packed.collect()) == sorted(map(tuple, pieces))
    assert packed.count() == corpus_pipeline.run(spark, SF).count()


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '\"", "<!", "<a b='", "</a ", "<a\"", "< ", "<!-- x"])
@pytest.mark.parametrize("end", ["", ">", "\">", "'>"])
def test_unclosed_tags_are_read_in_linear_time(piece, end):
    import time

    page = piece * (1_000_000 // len(piece)) + end
    start = time.perf_counter()
    assert sum(1 for _ in html_text.tokens(page)) <= len(page)
    assert time.perf_counter() - start < 5


def test_a_tag_without_an_end_is_text():
    assert page_text("a <b c") == "a <b c"
    assert page_text("<i title='a > b'>c</i> <i x='>") == "c <i x='>"
    assert page_text("<!DOCTYPE html>a<!-- b > c -->d<?pi?>e<!-->f") == "ade"
    assert page_text("<script>if (a < b) '</p>'</script>c<title>x") == "c"


def test_pipeline_on_odd_rows(spark, odd):
    """Every stage, one after the other: nulls, empty and long texts, repeated rows, clashing columns."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, near_dup.staged(stage(spark, docs, SF))
        assert docs.columns == before.columns
        rows, kept = before.count(), docs.count()
        assert kept <= rows or name == "mixing"
        if name == "near_duplicates":
            texts = [r["text"] for r in docs.collect()]
            worded = [" ".join(t.lower().split()) for t in texts if t and t.split()]
            assert len(worded) == len(set(worded))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert bool(pieces) == (docs.count() > 0)
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
