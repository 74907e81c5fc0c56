"""Steps that must spread over tasks, or do less work than all pairs, whatever the size of the bytes."""

import collections
import datetime as dt
import os
import re
import time

import numpy as np
from model import distance
from pyspark.sql import functions as F
from test_search import frame, row

from ledgerline.llm import perplexity
from ledgerline.functions.text import is_blank, strip
from ledgerline.operators import dedup, importing, inference, similar, views
from ledgerline.operators.criteria import with_view_conditions
from ledgerline.operators.similar import _probes as segments
from ledgerline.plans import tables as S
from ledgerline.schemas import SAVED_VIEW
from ledgerline.session import by_key, ensure_checkpoint_dir, materialize
from ledgerline.sources import text_tables, two_column
from ledgerline.sources.chunks import character_counts, chunks_to_lines, lines_to_cells, with_character_counts


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    rows = [(i, f"Supplier {i}", 0, 0.0) for i in range(60)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    folder = re.sub("^file:", "", S.supplier_files(spark, str(tmp_path)))
    files = [(at, f) for at, _, names in os.walk(folder) for f in names if f.startswith("part-")]
    assert sorted(int(at.rsplit("=", 1)[1]) for at, _ in files) == list(range(60))
    by_task = collections.Counter(f.split("-")[1] for _, f in files)
    assert len(by_task) >= 4 and max(by_task.values()) < 30


def test_equal_conditions_are_tested_once(spark):
    criteria = ['{"searchText":"tea"}', '{"type":"DEBIT"}', '{"searchText":"tea"}', None]
    rows = [(f"v{i}", "u1", "n", c, False, "[]", "[1]" if i == 2 else "[]", None, None) for i, c in enumerate(criteria * 5)]
    conditions = with_view_conditions(spark.createDataFrame(rows, SAVED_VIEW), dt.date(2024, 5, 1))
    asked, members = views._distinct_conditions(conditions)
    assert asked.count() == 3
    assert sorted(r.member for r in members.collect()) == sorted(r[0] for r in rows)
    tx = frame(spark, row(1, "tea"), row(2, "coffee"))
    got = views.view_membership(spark.createDataFrame(rows, SAVED_VIEW), tx, dt.date(2024, 5, 1)).collect()
    found = {(r.view_id, r.transaction_id): r.membership for r in got}
    assert found["v0", 1] == "MATCHED" and found["v2", 1] == "EXCLUDED" and found["v6", 1] == "MATCHED"
    assert ("v4", 2) not in found and found["v3", 2] == "MATCHED"


def test_rows_of_one_condition_spread_over_tasks(spark):
    """Also where nothing is broadcast; repeated views and transactions, and what single views exclude."""
    rows = [(f"v{i}", "u1", "n", None, False, "[]", f"[{i},{i + 1}]", None, None) for i in range(40)]
    rows += [rows[0], ("w", "u1", "n", '{"type":"NONE"}', False, "[5]", "[]", None, None), ("x", "u2", "n", None, False, "[]", "[5]", None, None)]
    tx = [row(i, "tea") for i in range(1, 29)] + [row(7, "tea")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = views.view_membership(spark.createDataFrame(rows, SAVED_VIEW), frame(spark, *tx), dt.date(2024, 5, 1))
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    matched = collections.Counter((r.view_id, r.transaction_id) for r in got if r.membership == "MATCHED")
    want = collections.Counter()
    for i in range(40):
        times = 4 if i == 0 else 1
        want.update({(f"v{i}", k): times * (1 + (k == 7)) for k in range(1, 29) if k not in (i, i + 1)})
    assert matched == want
    assert [(r.view_id, r.transaction_id) for r in got if r.membership == "PINNED"] == [("w", 5)]
    tasks = collections.Counter(r.task for r in got if r.membership == "MATCHED")
    assert len(tasks) >= 4 and max(tasks.values()) < len(got) / 2


def test_costly_rows_keep_their_tasks(spark):
    assert by_key(spark.range(10), "id").groupBy("id").count().rdd.getNumPartitions() >= 4


def test_a_window_left_out_finds_partners_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(similar, "SALT", 3)
    probed = []
    monkeypatch.setattr(similar, "_probes", lambda asking, group: probed.append(asking.select("norm").distinct().count()) or segments(asking, group))
    texts = [f"CARDPAYMENTSIAMMALL{name}{a}{b}X" for name in ("LARGERING", "OLDPLATE") for a in "ABCDEF" for b in "ABCDEF"]
    table = spark.createDataFrame([("k", t, "", i) for i, t in enumerate(texts)], "key string, norm string, tokens string, pos long")
    earlier = F.col("r_pos") < F.col("pos")
    got = similar.similar_semi_join(table, table, ["key"], earlier)
    expected = {a for i, a in enumerate(texts) if any(10 * distance(a, b) <= max(len(a), len(b)) for b in texts[:i])}
    assert {r.norm for r in got.collect()} == expected and len(expected) > 60
    assert sum(probed) < 10


def test_language_model_tells_all_characters_apart():
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points)).encode()
    sizes = [1 if p < 128 else 2 if p < 2048 else 3 if p < 65536 else 4 for p in points]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    found, before = perplexity.codes(np.frombuffer(text, np.uint8), offsets)
    symbols = (found & 63).astype(np.uint8).tobytes()
    each = sorted(symbols[a:b] for a, b in zip(before, before[1:]))
    assert all(each) and not any(b.startswith(a) for a, b in zip(each, each[1:]))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blank_ends_need_no_search_inside_the_text(spark):
    texts = ["  a" + " " * 3000 + "b　\t", " x ", " \t", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [("a" + " " * 3000 + "b", False), (" x ", False), ("", True), ("", True), (None, True)]
    assert "regexp" not in plan(df).lower() and "rlike" not in plan(df).lower()


def test_lines_are_found_without_a_join(spark):
    heights = [None, 0.0, -0.0, 1.5, 2.0, 2.5, 3.5, 4.0, 4.5, 9.0, 9.5, float("nan"), float("nan")]
    rows = [("f", page, float(i), float(i) + 1, y, f"w{i}") for page in (1, 2) for i, y in enumerate(heights)]
    rows += [(None, 1, 0.0, 1.0, 0.0, "none"), ("f", 1, 50.0, 51.0, 0.0, "  ")]
    chunks = spark.createDataFrame(rows, "file_id string, page int, start_x float, end_x float, y float, text string")
    lines = chunks_to_lines(chunks)
    got = sorted((r.page, r.line_no, [c.text for c in r.chunks]) for r in lines.collect())
    expected = [(0, ["w0"]), (1, ["w1", "w2", "w3", "w4"]), (2, ["w5", "w6", "w7", "w8"]), (3, ["w9", "w10"]), (4, ["w11", "w12"])]
    assert got == [(page, no, texts) for page in (1, 2) for no, texts in expected]
    assert "Join" not in plan(lines)


def test_a_head_stands_on_one_row_of_a_file(spark):
    text = "Date,Memo,Amount\n" + "01/02/2024,tea,1.00\n" * 30
    rows = [("a", bytearray(text.encode())), ("b", bytearray(b"Date,Memo\n")), ("c", bytearray())]
    found = inference.csv_rows(spark.createDataFrame(rows, "file_id string, content binary"))
    counts = {r.file_id: (r.n, r.heads) for r in found.groupBy("file_id").agg(F.count("record").alias("n"), F.count("head").alias("heads")).collect()}
    assert counts == {"a": (30, 1), "b": (0, 1), "c": (0, 1)}
    read = spark.createDataFrame([("31/02/2024",)], "v string").select(inference.date_patterns_read(F.col("v")).alias("bits"))
    assert read.first().bits and "regexp_replace" not in plan(read)


def test_cells_are_looked_at_once_for_all_kinds(spark):
    tables = spark.createDataFrame(
        [("f", 1, 1, 3, ["Date", "What"], [["1/2/2024", "tea"], ["Jan 3", "1.00"], [" ", None]], 3)],
        "file_id string, page int, start_line int, end_line int, header array<string>, rows array<array<string>>, row_count int",
    )
    cells = spark.createDataFrame([(["1/2", "3.50", "(4)", "tea", " ", "2024-01-02", "CR", "jan 3"],)], "v array<string>")
    shares = cells.select(inference.value_scores(F.col("v"))).first()[0]
    assert shares.asDict() == {"date": 3 / 7, "amount": 2 / 7, "description": 1 / 7, "type": 1 / 7}
    ranked = inference.rank_table_candidates(tables)
    assert ranked.first().date_format and plan(ranked).count("jul|aug") < 12


def test_lines_of_two_columns_are_dealt_once(spark):
    chunks = spark.createDataFrame([], "file_id string, page int, start_x float, end_x float, y float, text string")
    assert plan(two_column._read_lines(chunks)).count("Repartition") <= 1


def test_an_import_reads_its_rows_from_a_step(spark, monkeypatch):
    written = []
    monkeypatch.setattr(importing, "materialize", lambda df: written.append(df.columns) or materialize(df))
    incoming = S.incoming(spark, "/root/testdata/sf0.001")
    tx = S.transactions(spark, "/root/testdata/sf0.001")
    importing.import_batch(incoming, S.batch_sources(spark, "/root/testdata/sf0.001"), tx, S.import_ledger(spark, "/root/testdata/sf0.001"), dt.date(2024, 1, 1), dt.datetime(2024, 1, 1))
    assert incoming.columns in written and tx.columns in written


def test_lines_are_read_once_and_dealt_once_for_tables(spark, monkeypatch):
    cells = lambda y, *texts: [(30.0 * i, 30.0 * i + 5, y, t) for i, t in enumerate(texts) if t]
    year = cells(0.0, "Statement of 2023") + cells(60.0, "And 2024")
    table = cells(100.0, "Date", "Memo", "Amount") + cells(110.0, "Nov 5", "tea", "1.00")
    again = cells(120.0, "date", "MEMO", "amount") + cells(130.0, "Nov 6", "", "-2.00")
    again += cells(130.0, "", "pie") + [(90.0, 95.0, 130.0, "x")]
    files = {
        "whole": year + table + again, "no year": table + again, "short": cells(0.0, "Date", "a") + cells(9.0, "b", "c"),
        "no table": cells(0.0, "text of enough characters"), "few": cells(0.0, "of 2024") + table,
    }
    rows = [(f, 1, *chunk) for f, chunks in files.items() for chunk in chunks]
    chunks = spark.createDataFrame(rows, "file_id string, page int, start_x float, end_x float, y float, text string")
    names = [(f, "a.pdf", 1, "acct") for f in (*files, "no text", "whole")]
    uploads = spark.createDataFrame(names, "file_id string, filename string, statement_format_id long, account_id string")
    config = (
        '{"fileType":"TEXT_PDF","headerMustContain":["memo"],"minimumRows":2,"dateHeader":"Date","dateFormat":"MMM d",'
        '"descriptionHeader":"Memo","amountHeader":"Amount","negativeMeans":"DEBIT","yearSource":"STATEMENT_PERIOD"}'
    )
    formats = spark.createDataFrame([(1, "PDF", "Bank", "USD", True)], "id long, format_type string, bank_name string, default_currency_iso_code string, enabled boolean")
    revisions = spark.createDataFrame(
        [(9, 1, 1, "PDF_TEXT_TABLE_CONFIG", None, config, 0, True)],
        "id long, statement_format_id long, revision_number int, parser_type string, handler_key string, parser_config string, priority int, enabled boolean",
    )
    steps = []
    monkeypatch.setattr(text_tables, "materialize", lambda df: steps.append(df) or materialize(df))
    parsed, attempts = text_tables.parse_text_tables(chunks, uploads, formats, revisions)
    got = sorted((r.file_id, r.row_pos, str(r.date), r.description, r.type) for r in parsed.collect())
    whole = [("whole", 1, "2023-11-05", "tea", "CREDIT"), ("whole", 2, "2023-11-06", "pie", "DEBIT")]
    assert got == sorted(2 * whole)
    status = collections.Counter((r.file_id, r.status, r.row_count) for r in attempts.collect())
    missed = {(f, "NOT_APPLICABLE", 0): 1 for f in ("short", "no table", "few", "no text")}
    assert status == {("whole", "MATCHED", 4): 2, ("no year", "FAILED", 0): 1, **missed}
    # The files with their configurations, and the rows: neither the lines nor the tables are a step, and only chunks are dealt.
    assert len(steps) == 2
    assert plan(steps[1]).count("RepartitionByExpression") == 1 == plan(steps[1]).count("Join ")

    lines = materialize(lines_to_cells(chunks_to_lines(chunks)))
    beside = with_character_counts(lines).select("file_id", "characters", "sufficient").distinct()
    assert sorted(map(tuple, beside.collect())) == sorted(map(tuple, character_counts(lines).collect()))


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_step_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    counts = materialize(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count())
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and counts.count() == 5000


def marks(spark):
    key = ["'u' owner_id", "'B' bank_name", "date'2024-01-01' date", "1.00BD amount", "'DEBIT' type", "'USD' currency_iso_code"]
    name = "concat('CARD PAYMENT SIAM MALL ', translate(lpad(cast(id % 50 AS string), 3, '0'), '0123456789', 'ABCDEFGHIJ'), ' x') description"
    incoming = spark.range(90).selectExpr(*key, "'b' batch_id", "id row_pos", name, "false allow_duplicate")
    return incoming, spark.range(3).selectExpr(*key, "id", name, "false deleted")


def test_marking_keeps_only_what_its_result_reads(spark):
    folder = re.sub("^file:", "", ensure_checkpoint_dir(spark))
    there = set(os.listdir(folder))
    marked = dedup.mark_duplicates(*marks(spark))
    assert len([x for x in os.listdir(folder) if x.startswith("step-") and x not in there]) == 2
    reasons = collections.Counter(r.duplicate_reason for r in marked.collect())
    assert reasons["EXISTING_TRANSACTION"] > 80 and sum(reasons.values()) == 90


def test_multiplied_rows_are_not_sent_to_the_driver(spark, monkeypatch):
    """Spark takes a step for as small as its compressed files."""
    joins = []
    answered, probes = similar._answered, similar._probes
    monkeypatch.setattr(similar, "SALT", 3)
    monkeypatch.setattr(similar, "_answered", lambda *a: joins.append(answered(*a)) or joins[-1])
    monkeypatch.setattr(similar, "_probes", lambda *a: joins.append(probes(*a)) or joins[-1])
    incoming, stored = marks(spark)
    rows = materialize(dedup.batch_units(materialize(dedup.prepared(incoming)))).select(*dedup.UNIT_BATCH, *dedup.TEXT, "pos")
    found = similar._matches(rows, rows, dedup.UNIT_BATCH, dedup._earlier(), "left_semi")
    assert len(joins) == 2
    plans = "".join(t._jdf.queryExecution().executedPlan().toString() for t in (*found, *joins)).split("\n")
    assert not [x for x in plans if "BroadcastHashJoin" in x and re.search(r"BroadcastHashJoin \[[^]]*(mask|segment|norm)#", x)]
