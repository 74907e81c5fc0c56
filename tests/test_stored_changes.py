import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_search import frame, row

from ledgerline.operators import changes, stored_changes

NOW = dt.datetime(2024, 5, 1)
REQUEST = "request_id long, pos long, transaction_id long, actor string, can_act_on_any boolean"


@pytest.fixture
def store(spark, tmp_path):
    """Two years, and one of them in two batches."""
    path = str(tmp_path / "a store")
    old = dt.date(2023, 1, 1)
    changes.append_transactions(frame(spark, row(1), row(2, date=old), row(3, date=old, owner_id="u2")), path)
    late = frame(spark, row(4), row(5, deleted=True)).withColumn("id", F.col("id") + 70_000)
    changes.append_transactions(late, path)
    return path


def files(spark, path):
    return set(spark.read.parquet(path).inputFiles())


def asked(spark, *ids):
    return spark.createDataFrame([(1, i, t, "u1", False) for i, t in enumerate(ids)], REQUEST)


def state(spark, path):
    rows = stored_changes.stored_transactions(spark, path).collect()
    return {r.id: (r.deleted, r.deleted_by) for r in rows}


def test_only_files_with_requested_ids_change(spark, store):
    before, rows = files(spark, store), stored_changes.stored_transactions(spark, store)
    requests = asked(spark, 70_004, 70_004, 70_005, 999, None)
    expected, outcomes = changes.soft_delete(rows, requests, NOW)
    expected = sorted(map(str, expected.collect()))
    outcomes = sorted(map(str, outcomes.collect()))
    got = stored_changes.soft_delete_stored(spark, store, requests, NOW)
    assert sorted(map(str, got.collect())) == outcomes
    now = stored_changes.stored_transactions(spark, store).select(*rows.columns)
    assert sorted(map(str, now.collect())) == expected
    after = files(spark, store)
    assert len(before - after) == 1 and len(after - before) == 1 and len(after) == 3
    # Another change, which goes through the index of the first one and one file more.
    stored_changes.soft_delete_stored(spark, store, asked(spark, 2, 3), NOW)
    assert state(spark, store)[2] == (True, "u1") and state(spark, store)[3] == (False, None)
    stored_changes.drop_index(spark, store)
    again = stored_changes.soft_delete_stored(spark, store, asked(spark, 2, 1), NOW).orderBy("pos").collect()
    assert [r.outcome for r in again] == ["NOT_FOUND", "DELETED"]


def test_unknown_ids_rewrite_nothing(spark, store):
    before = files(spark, store)
    for requests in (asked(spark, 5, None, -3), asked(spark).where("false")):
        got = stored_changes.soft_delete_stored(spark, store, requests, NOW)
        assert {r.outcome for r in got.collect()} <= {"NOT_FOUND"} and got.count() == requests.count()
    assert files(spark, store) == before


def test_patch(spark, store):
    patches = spark.createDataFrame(
        [(0, 2, "u1", False, "new", None), (1, 2, "u1", False, None, "a9"), (2, 3, "u1", False, "z", None)],
        "seq long, transaction_id long, actor string, can_act_on_any boolean, description string, "
        "account_id string",
    )
    got = stored_changes.apply_patch_stored(spark, store, patches).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["UPDATED", "UPDATED", "NOT_FOUND"]
    rows = {r.id: r for r in stored_changes.stored_transactions(spark, store).collect()}
    assert (rows[2].description, rows[2].account_id) == ("new", "a9")
    assert rows[3].description == "x" and len(rows) == 5


@pytest.mark.parametrize("lost", ["before", "in swap"])
def test_lost_driver(spark, store, monkeypatch, lost):
    """A stop before the swap is written down changes nothing; one after it is made good by the next change."""
    before, was = files(spark, store), state(spark, store)
    moves = []

    def stop(*_):
        moves.append(1)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        if lost == "before":
            patch.setattr(stored_changes, "append_transactions", lambda rows, path: (changes.append_transactions(rows, path), stop()))
        else:
            patch.setattr(stored_changes, "_move_files", stop)
        with pytest.raises(KeyboardInterrupt):
            stored_changes.soft_delete_stored(spark, store, asked(spark, 1, 2), NOW)
    assert moves
    if lost == "before":
        assert files(spark, store) == before and state(spark, store) == was
    stored_changes.finish_changes(spark, store)
    stored_changes.finish_changes(spark, store)
    done = state(spark, store)
    assert set(done) == set(was)
    assert (done == was) if lost == "before" else (done[1] == done[2] == (True, "u1"))


def test_index_tells_blocks(spark, store):
    index = stored_changes.index_ids(spark, store)
    assert sorted(r.block for r in index.collect()) == [0, 0, 1]
    found = stored_changes.files_with(spark, store, spark.range(70_004, 70_005))
    assert len(found) == 1 and found == stored_changes.files_with(spark, store, spark.range(70_004, 70_006))
    assert index.select(F.max("block")).first()[0] == 1
