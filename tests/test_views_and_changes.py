import datetime as dt
import itertools

from pyspark.sql import functions as F
from test_search import frame, row

from ledgerline.operators import changes, formats, views
from ledgerline.schemas import SAVED_VIEW, STATEMENT_FORMAT

NOW = dt.datetime(2024, 5, 1)
TODAY = dt.date(2024, 5, 1)


def view(spark, criteria="{}", pinned="[]", excluded=None, open_ended=False):
    return spark.createDataFrame(
        [("v", "u1", "n", criteria, open_ended, pinned, excluded, NOW, NOW)], SAVED_VIEW
    )


def membership(v, tx):
    got = views.view_membership(v, tx, TODAY).collect()
    return sorted((r.membership, r.transaction_id) for r in got)


def test_membership_rules(spark):
    tx = frame(
        spark, row(1, "coffee"), row(2, "coffee"), row(3, "tea"), row(4, "tea", deleted=True),
        row(5, "coffee", owner_id="u2"), row(6, "tea"),
    )
    # 2 is pinned, excluded and matching: in neither list, yet counted.
    v = view(spark, '{"searchText":"coffee"}', "[2,3,4,5]", "[2,6]")
    assert membership(v, tx) == [("EXCLUDED", 2), ("EXCLUDED", 6), ("MATCHED", 1), ("PINNED", 3)]
    assert views.view_counts(v, tx, TODAY).first().n == 3
    empty = view(spark, None, " ")
    assert membership(empty, tx) == [("MATCHED", i) for i in (1, 2, 3, 6)]


def test_open_end_and_zero_count(spark):
    tx = frame(spark, row(1), row(2, date=dt.date(2030, 1, 1)))
    assert views.view_counts(view(spark, open_ended=True), tx, TODAY).first().n == 1
    assert views.view_counts(view(spark), tx, TODAY).first().n == 2
    assert views.view_counts(view(spark, '{"type":"CREDIT"}'), tx, TODAY).first().n == 0


def test_event_fold_equals_replay(spark):
    """All event sequences up to length 4, from all four starting states."""
    actions = ["pin", "unpin", "exclude", "unexclude"]
    plans = [p for n in range(5) for p in itertools.product(actions, repeat=n)]
    cases = list(itertools.product(plans, [False, True], [False, True]))
    stored_p = "[" + ",".join(str(i) for i, c in enumerate(cases) if c[1]) + "]"
    stored_x = "[" + ",".join(str(i) for i, c in enumerate(cases) if c[2]) + "]"
    events = [
        ("v", i, action, n) for i, (plan, _, _) in enumerate(cases) for n, action in enumerate(plan)
    ]
    df = spark.createDataFrame(events, "view_id string, transaction_id long, action string, seq long")
    got = views.apply_view_events(view(spark, "{}", stored_p, stored_x), df).collect()
    found = {r.transaction_id: (r.pinned, r.excluded) for r in got}
    for i, (plan, p, x) in enumerate(cases):
        for action in plan:
            if action == "pin":
                p, x = True, False
            elif action == "exclude":
                p, x = False, True
            elif action == "unpin":
                p = False
            else:
                x = False
        assert found.get(i, (False, False)) == (p, x), cases[i]


def test_fold_outcome_and_store(spark):
    tx = frame(spark, row(1), row(2, owner_id="u2"))
    events = spark.createDataFrame(
        [("v", 1, "pin", 0), ("v", 2, "pin", 1), ("v", 9, "unpin", 2), ("v", 2, "exclude", 3)],
        "view_id string, transaction_id long, action string, seq long",
    )
    v = view(spark, "{}", "[9]")
    edits, outcome = views.fold_view_events(v, events, tx)
    assert [r.outcome for r in outcome.orderBy("seq").collect()] == [
        "APPLIED", "NOT_FOUND", "APPLIED", "NOT_FOUND",
    ]
    saved = views.store_view_edits(v, edits).first()
    assert (saved.pinned_ids, saved.excluded_ids) == ("[1]", "[]")


def test_soft_delete(spark):
    tx = frame(spark, row(1), row(2, deleted=True), row(3, owner_id="u2"), row(4))
    requests = spark.createDataFrame(
        [(1, i, t, "u1", False) for i, t in enumerate([1, 1, 2, 3, 99])]
        + [(2, 0, 3, "boss", True), (2, 1, 1, "boss", True)],
        "request_id long, pos long, transaction_id long, actor string, can_act_on_any boolean",
    )
    new, outcome = changes.soft_delete(tx, requests, NOW)
    gone = {r.id: r.deleted_by for r in new.where("deleted_at is not null").collect()}
    assert gone == {1: "u1", 3: "boss"}
    got = [r.outcome for r in outcome.orderBy("request_id", "pos").collect()]
    assert got == ["DELETED"] + ["NOT_FOUND"] * 4 + ["DELETED", "NOT_FOUND"]
    summary = {r.request_id: tuple(r)[1:] for r in changes.delete_summary(outcome).collect()}
    assert summary == {1: (1, 4), 2: (1, 1)}


def test_patch_keeps_nulls(spark):
    tx = frame(spark, row(1, "old"), row(2, owner_id="u2"))
    patches = spark.createDataFrame(
        [(0, 1, "u1", False, "new", None), (1, 1, "u1", False, None, "a9"), (2, 2, "u1", False, "x", "y")],
        "seq long, transaction_id long, actor string, can_act_on_any boolean, description string, "
        "account_id string",
    )
    new, outcome = changes.apply_patch(tx, patches)
    first = new.where("id = 1").first()
    assert (first.description, first.account_id) == ("new", "a9")
    assert [r.outcome for r in outcome.orderBy("seq").collect()] == ["UPDATED"] * 2 + ["NOT_FOUND"]


def test_ids_are_dense_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(7)
    a = {r.k: r.id for r in changes.assign_ids(df, ["k"], 50, buckets=16).collect()}
    b = {r.k: r.id for r in changes.assign_ids(df.repartition(3), ["k"], 50, buckets=16).collect()}
    assert a == b and sorted(a.values()) == list(range(51, 1051))


def test_append_is_readable_by_year(spark, tmp_path):
    path = str(tmp_path / "store")
    changes.append_transactions(frame(spark, row(1), row(2, date=dt.date(2023, 1, 1))), path)
    changes.append_transactions(frame(spark, row(3)), path)
    assert sorted(r.id for r in spark.read.parquet(path).where("year = 2024").collect()) == [1, 3]


def test_format_visibility_and_selection(spark):
    f = spark.createDataFrame(
        [(1, "CSV", "B", "USD", "z", "SYSTEM", None, True), (2, "CSV", "B", "USD", "a", "USER", "u", True),
         (3, "CSV", "B", "USD", "m", "USER", "w", False)], STATEMENT_FORMAT,
    )
    users = spark.createDataFrame([("u",), ("w",), ("x",)], "user_id string")
    seen = {(r.user_id, r.id) for r in formats.visible_formats(f, users).collect()}
    assert seen == {("u", 1), ("u", 2), ("w", 1), ("w", 3), ("x", 1)}
    assert [r.id for r in formats.formats_for(f, "u").collect()] == [2, 1]
    assert [r.id for r in formats.formats_for(f, "u", True).collect()] == [2, 3, 1]
    asked = users.withColumn("statement_format_id", F.lit(3))
    assert not any(r.usable for r in formats.resolve_formats(asked, f).collect())
