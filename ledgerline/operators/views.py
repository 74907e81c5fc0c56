"""Saved views: membership, counts, and pin/exclude events, for all views at once.

M = active transactions of the view's owner that fit its criteria; P and X = pinned and excluded ids
that are active and owned. matched = M - X, pinned = P - M, excluded = X; the counted set is
(M - X) + P. An id stored in both P and X and also in M is in neither ``matched`` nor ``pinned``,
but counts.

Views are not tried on all transactions of their owner. *Facets*, the distinct currencies, types, banks, accounts, months and
sizes of amount of each owner with their counts, tell which condition of a view leaves least; the view is filed under the
facets that fit it, a transaction looks under its own facets, and only such pairs are tested in full.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_key, materialize, tasks
from .criteria import (
    active,
    id_set,
    id_set_text,
    view_predicate,
    with_lower_text,
    with_view_conditions,
)

VIEW_FIELDS = [
    "id", "owner_id", "account_id", "bank_name", "date",
    "currency_iso_code", "amount", "type", "description",
]


def _owned(tx: DataFrame) -> DataFrame:
    return with_lower_text(active(tx).select(*VIEW_FIELDS))


#: What a view may be filed under. ``all`` is for views without any of the others.
KINDS = ["all", "currency", "type", "bank", "account", "month", "size"]


def _facet_values() -> Column:
    """The value of each kind for a transaction, in the order of ``KINDS``; a month, a power of two for the amount."""
    size = F.floor(F.log2(F.greatest(F.col("amount").cast("double"), F.lit(1.0)))).cast("string")
    values = [
        F.lit(""), F.col("l_currency_iso_code"), F.col("type"), F.col("l_bank_name"), F.col("l_account_id"),
        F.date_format("date", "yyyy-MM"), size,
    ]
    return F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in zip(KINDS, values)])


def facets(owned: DataFrame) -> DataFrame:
    """``owner_id, kind, value, n`` with the ranges of dates and amounts: what an owner's transactions have, and how often."""
    each = owned.select("owner_id", "date", "amount", F.explode(_facet_values()).alias("f"))
    return each.where("f.value is not null").groupBy("owner_id", "f.kind", "f.value").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{c}_{name}") for c in ("date", "amount") for f, name in ((F.min, "low"), (F.max, "high"))],
        F.count_if(F.col("date").isNull() | F.col("amount").isNull()).alias("gaps"),
    )


def filed(conditions: DataFrame, facet: DataFrame) -> DataFrame:
    """Views with a row for each facet that they are filed under: ``kind``, ``value``, ``n``, ``covered``.

    Each view goes under the kind of condition that leaves the fewest of its owner's transactions. ``covered``: the
    condition is the view's only one and the whole facet fits it, so its transactions need no test.
    """
    col = F.col
    dated = col("v_date_from").isNotNull() | col("v_date_to").isNotNull()
    sized = col("v_min").isNotNull() | col("v_max").isNotNull()
    has = {
        "currency": F.size("v_currencies") > 0,
        "type": col("v_type").isNotNull(),
        "bank": F.size("v_banks") > 0,
        "account": F.size("v_accounts") > 0,
        "month": dated,
        "size": sized,
    }
    words = F.size("v_words") > 0
    asked = reduce(lambda a, b: a + b, [c.cast("int") for c in [*has.values(), words]])

    def within(low: Column, high: Column, name: str, whole: bool) -> Column:
        first, last = (f"{name}_low", f"{name}_high") if whole else (f"{name}_high", f"{name}_low")
        return (low.isNull() | (col(first) >= low)) & (high.isNull() | (col(last) <= high))

    any_word = lambda words, field: F.exists(words, lambda w: F.contains(field, w))
    bounds = {"month": ("v_date_from", "v_date_to", "date"), "size": ("v_min", "v_max", "amount")}
    fits = {
        "all": F.lit(True),
        "currency": F.array_contains("v_currencies", col("value")),
        "type": col("v_type") == col("value"),
        "bank": any_word("v_banks", col("value")),
        "account": any_word("v_accounts", col("value")),
        **{k: within(col(a), col(b), name, False) for k, (a, b, name) in bounds.items()},
    }
    meets = reduce(lambda a, b: a | b, [(col("kind") == k) & has.get(k, F.lit(True)) & f for k, f in fits.items()])
    pairs = conditions.join(facet, (col("view_owner") == col("owner_id")) & meets).drop("owner_id")
    whole = F.when(col("kind") == "all", asked == 0)
    for kind, (low, high, name) in bounds.items():
        fit = within(col(low), col(high), name, True) & (col("gaps") == 0)
        whole = whole.when(col("kind") == kind, (asked == 1) & fit)
    covered = F.coalesce(whole.otherwise(asked == 1), F.lit(False)).alias("covered")
    # a condition that no facet fits leaves nothing of its view
    wanted = (1 + asked - words.cast("int")).alias("_wanted")
    narrow = pairs.select("view_id", "kind", "value", "n", covered, wanted)
    cost = F.sum("n").over(Window.partitionBy("view_id", "kind"))
    least = F.min(F.struct(col("_cost"), "kind")).over(Window.partitionBy("view_id"))
    met = F.size(F.collect_set("kind").over(Window.partitionBy("view_id")))
    chosen = narrow.withColumn("_cost", cost).withColumn("_least", least).withColumn("_met", met)
    chosen = chosen.where("kind = _least.kind and _met = _wanted").select("view_id", "kind", "value", "n", "covered")
    return conditions.join(chosen, "view_id")


def candidate_pairs(owned: DataFrame, views: DataFrame) -> DataFrame:
    """Transactions beside the filed views to test them by: an equi-join on owner and facet.

    Views are a small table next to transactions, so Spark broadcasts them when their size allows; otherwise the
    shuffle join splits what holds much of the data (adaptive skew join). A transaction looks only under the kinds
    that its owner's views are filed under.
    """
    used = views.groupBy(F.col("view_owner").alias("owner_id")).agg(F.collect_set("kind").alias("_kinds"))
    probes = by_key(owned, "id").join(used, "owner_id").withColumn("_f", F.explode(_facet_values()))
    probes = probes.where(F.array_contains("_kinds", F.col("_f.kind"))).drop("_kinds")
    return probes.join(
        views,
        (F.col("owner_id") == F.col("view_owner"))
        & (F.col("_f.kind") == F.col("kind"))
        & (F.col("_f.value") == F.col("value")),
    )


#: What a view asks of transactions; the views of one owner that ask the same are one condition.
ASKED = [
    "view_owner", "v_date_from", "v_date_to", "v_min", "v_max", "v_type", "v_accounts", "v_banks", "v_currencies", "v_words",
]


def _distinct_conditions(conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, members): each condition of an owner once, known by one of its views (``view_id``), and ``view_id, member``.

    A view whose row comes m times is a member m * m times, as the join of views and facets by id has it.
    """
    least = F.min("view_id").over(Window.partitionBy(*ASKED))
    known = materialize(conditions.select(*ASKED, F.col("view_id").alias("member"), least.alias("view_id")).where("member is not null"))
    asked = known.where("member = view_id").select("view_id", *ASKED).dropDuplicates(["view_id"])
    return asked, materialize(known.select("view_id", "member").join(known.select("member"), "member"))


def _filed(asked: DataFrame, tx: DataFrame) -> DataFrame:
    return materialize(filed(by_key(asked, "view_id"), materialize(facets(by_key(_owned(tx), "id")))))


#: Members of a condition in one array, about.
ARRAY = 256


def _of_members(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of conditions as rows of each view that asks the same."""
    return counts.join(members, "view_id").drop("view_id").withColumnRenamed("member", "view_id")


def _members_matched(pairs: DataFrame, members: DataFrame, excluded: DataFrame) -> DataFrame:
    """(view_id, transaction_id) of each view that asks what a pair's condition asks, without what the view excludes.

    That is many rows for a pair, so only pairs are ever dealt, evenly: a condition's pairs go to all tasks by transaction. Members come as
    arrays, so a pair becomes its rows where it is; what some member excludes is a set beside the pair.
    """
    gone = excluded.join(members.distinct().withColumnRenamed("view_id", "_asked"), F.col("view_id") == F.col("member"))
    gone = gone.groupBy(F.col("_asked").alias("view_id"), "transaction_id").agg(F.collect_set("member").alias("_gone"))
    spread = tasks(pairs.sparkSession)
    parts = F.ceil(F.count("*").over(Window.partitionBy("view_id")) / ARRAY)
    cut = members.withColumn("_cut", F.pmod(F.xxhash64("member"), parts))
    lists = cut.groupBy("view_id", "_cut").agg(F.collect_list("member").alias("_members")).drop("_cut")
    lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(spread)).cast("int")
    dealt = by_key(pairs.join(gone, ["view_id", "transaction_id"], "left").withColumn("_part", part), "view_id", "_part")
    rows = dealt.join(lists, ["view_id", "_part"]).select("transaction_id", "_gone", F.explode("_members").alias("view_id"))
    kept = F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("view_id"))
    return rows.where(kept).select("view_id", "transaction_id")


def _edits(conditions: DataFrame, tx: DataFrame) -> DataFrame:
    """(view_id, transaction_id, in_p, in_x, in_m) for pinned or excluded, active, owned ids.

    ``in_m`` evaluates the criteria on these few pairs, so M itself is not needed for them.
    """
    ids = conditions.select(
        "*", F.explode(F.array_union("v_pinned", "v_excluded")).alias("transaction_id")
    )
    pairs = ids.select(
        "*",
        F.array_contains("v_pinned", F.col("transaction_id")).alias("in_p"),
        F.array_contains("v_excluded", F.col("transaction_id")).alias("in_x"),
    ).drop("v_pinned", "v_excluded")
    owned = _owned(tx).join(
        pairs,
        (F.col("id") == F.col("transaction_id")) & (F.col("owner_id") == F.col("view_owner")),
    )
    return owned.select(
        "view_id",
        "transaction_id",
        "in_p",
        "in_x",
        F.coalesce(view_predicate(), F.lit(False)).alias("in_m"),
    )


def view_membership(views: DataFrame, tx: DataFrame, as_of: date) -> DataFrame:
    """(view_id, transaction_id, membership) with membership MATCHED, PINNED or EXCLUDED."""
    conditions = with_view_conditions(views, as_of)
    edits = _edits(conditions, tx)
    excluded = edits.where("in_x").select("view_id", "transaction_id")
    asked, members = _distinct_conditions(conditions)
    pairs = candidate_pairs(_owned(tx), _filed(asked, tx)).where(F.col("covered") | view_predicate())
    matched = _members_matched(pairs.select("view_id", F.col("id").alias("transaction_id")), members, excluded)
    pinned = edits.where("in_p and not in_m").select("view_id", "transaction_id")
    return (
        matched.withColumn("membership", F.lit("MATCHED"))
        .unionByName(pinned.withColumn("membership", F.lit("PINNED")))
        .unionByName(excluded.withColumn("membership", F.lit("EXCLUDED")))
    )


def view_counts(views: DataFrame, tx: DataFrame, as_of: date) -> DataFrame:
    """(view_id, n): the size of (M - X) + P for every view, zero included.

    What a view's facets cover is counted from the facets, the rest on the map side of the join; the edited ids add or
    take away one each. No (view, transaction) pair of M is ever shuffled.
    """
    conditions = with_view_conditions(views, as_of)
    asked, members = _distinct_conditions(conditions)
    index = _filed(asked, tx)
    known = index.where("covered").groupBy("view_id").agg(F.sum("n").alias("d"))
    tested = candidate_pairs(_owned(tx), index.where("not covered")).where(view_predicate())
    matched = _of_members(known.unionByName(tested.groupBy("view_id").agg(F.count("*").alias("d"))), members)
    counted = (F.col("in_m") & ~F.col("in_x")) | F.col("in_p")
    changes = _edits(conditions, tx).groupBy("view_id").agg(
        F.sum(counted.cast("int") - F.col("in_m").cast("int")).alias("d")
    )
    zero = conditions.select("view_id", F.lit(0).cast("bigint").alias("d"))
    return (
        matched.unionByName(changes).unionByName(zero).groupBy("view_id").agg(F.sum("d").alias("n"))
    )


def resolve_ids(requests: DataFrame, tx: DataFrame, owner: str, id_column: str) -> DataFrame:
    """Requests with ``found``: the id names an active transaction owned by column ``owner``."""
    known = active(tx).select(
        F.col("id").alias(id_column), F.col("owner_id").alias(owner), F.lit(True).alias("found")
    )
    return requests.join(known, [id_column, owner], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def fold_view_events(
    views: DataFrame, events: DataFrame, tx: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Apply pin, unpin, exclude and unexclude events to the stored id sets.

    Returns (edits, outcome). ``edits`` has one row per (view_id, transaction_id) left pinned or
    excluded. ``outcome`` has one row per event with APPLIED or NOT_FOUND: pin and exclude need an
    active transaction of the view's owner, the other two do not.

    Events are folded per (view, transaction) by the last position of each action, so no view's
    history is ever gathered in one place; the stored sets enter as events before the first.
    """
    owners = views.select(F.col("id").alias("view_id"), F.col("user_id").alias("owner_id"))
    mine = events.join(owners, "view_id")
    resolved = resolve_ids(mine, tx, "owner_id", "transaction_id")
    adds = F.col("action").isin("pin", "exclude")
    outcome = resolved.select(
        "view_id",
        "seq",
        "transaction_id",
        "action",
        F.when(~adds | F.col("found"), "APPLIED").otherwise("NOT_FOUND").alias("outcome"),
    )
    return apply_view_events(views, outcome.where("outcome = 'APPLIED'")), outcome


def _stored_events(views: DataFrame) -> DataFrame:
    def stored(column: str, action: str) -> DataFrame:
        return views.select(
            F.col("id").alias("view_id"),
            F.explode(id_set(F.col(column))).alias("transaction_id"),
            F.lit(action).alias("action"),
        )

    return stored("pinned_ids", "stored_pin").unionByName(stored("excluded_ids", "stored_exclude"))


def _last(action: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("action") == action, F.col("seq"))), F.lit(-1))


def _was(action: str) -> Column:
    return F.coalesce(F.bool_or(F.col("action") == action), F.lit(False))


def apply_view_events(views: DataFrame, events: DataFrame) -> DataFrame:
    """(view_id, transaction_id, pinned, excluded) after ``events`` (seq >= 0)."""
    stored = _stored_events(views).withColumn("seq", F.lit(-1).cast("bigint"))
    folded = (
        events.select("view_id", "transaction_id", "action", F.col("seq").cast("bigint"))
        .unionByName(stored.select("view_id", "transaction_id", "action", "seq"))
        .groupBy("view_id", "transaction_id")
        .agg(
            *[_last(a).alias(a) for a in ("pin", "unpin", "exclude", "unexclude")],
            _was("stored_pin").alias("p0"),
            _was("stored_exclude").alias("x0"),
        )
    )

    def ends_in(add: str, start: str, *removers: str) -> Column:
        removed = F.greatest(*[F.col(r) for r in removers])
        added = F.col(add)
        return F.when((added < 0) & (removed < 0), F.col(start)).otherwise(added > removed)

    return folded.select(
        "view_id",
        "transaction_id",
        ends_in("pin", "p0", "unpin", "exclude").alias("pinned"),
        ends_in("exclude", "x0", "unexclude", "pin").alias("excluded"),
    ).where("pinned or excluded")


def store_view_edits(views: DataFrame, edits: DataFrame) -> DataFrame:
    """Views with their id-set texts rewritten from ``edits`` (one text value per view)."""
    sets = edits.groupBy("view_id").agg(
        id_set_text(F.collect_set(F.when(F.col("pinned"), F.col("transaction_id")))).alias("p"),
        id_set_text(F.collect_set(F.when(F.col("excluded"), F.col("transaction_id")))).alias("x"),
    )
    joined = views.drop("pinned_ids", "excluded_ids").join(
        sets, views["id"] == sets["view_id"], "left"
    )
    return (
        joined.withColumn("pinned_ids", F.coalesce("p", F.lit("[]")))
        .withColumn("excluded_ids", F.coalesce("x", F.lit("[]")))
        .select(*views.columns)
    )


def bulk_view_summary(outcome: DataFrame) -> DataFrame:
    """Per view and action: distinct ids updated, and requests not found (repeats counted).

    The not-found ids themselves are the NOT_FOUND rows of ``outcome`` in ``seq`` order.
    """
    return outcome.groupBy("view_id", "action").agg(
        F.count_distinct(F.when(F.col("outcome") == "APPLIED", F.col("transaction_id"))).alias(
            "updated_count"
        ),
        F.count_if(F.col("outcome") == "NOT_FOUND").alias("not_found_count"),
    )


def list_views(views: DataFrame, user: str) -> DataFrame:
    """One user's views, newest first."""
    return views.where(F.col("user_id") == user).orderBy(F.col("created_at").desc(), "id")
