"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A document's number of copies is the Poisson quantile of a uniform number that a hash of its id gives;
the mean is the repetition rate that its source needs to reach its target weight. So the result needs no
state, is the same however the input is split, and survives lost tasks. The copies are then dealt to
tasks, and ordered in them, by a hash of id and copy: a global shuffle.

Weights are shares of documents. A null source is a source of its own. A row with a null id is known by
its text and source. Rows that are repeated hash alike: they get the same number of copies. Empty texts
count as any other. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged

TEMPERATURE = 0.5
SEED = "mix-1"


def _hash_number(hex_digits: int, *parts) -> Column:
    """The first digits of an MD5 of the parts, as a whole number; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, hex_digits), 16, 10).cast("long")


def _identity() -> Column:
    """What is hashed: the id; for a null id the text and source, so that such rows differ too."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "source")]
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(told[0]), F.lit(":"), told[1]))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0) -> DataFrame:
    """``source, rate, cdf``: mean copies of a document of each source, and the Poisson distribution function up to a negligible rest.

    ``weights`` gives target shares by source (sources it lacks get none); without it a source of n
    documents gets n ** temperature. ``size`` is the expected output as a multiple of the input.
    """
    counted = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        wanted = counted.withColumn("weight", F.pow("n", F.lit(float(temperature))))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "key string, weight double")
        wanted = counted.join(given, F.col("source").cast("string").eqNullSafe(F.col("key")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    totals = wanted.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight")).first()
    scale = size * (totals["all_n"] or 0) / (totals["all_weight"] or 1.0)
    rated = wanted.select("source", (F.lit(scale) * F.col("weight") / F.col("n")).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("long")
    # log of k! and of the probability of k copies, running sums over k
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.exp(-F.col("rate")).alias("below"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        log_factorial = state["log_factorial"] + F.log(k.cast("double"))
        below = state["below"] + F.exp(k * F.log("rate") - F.col("rate") - log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), below.alias("below"), F.array_append(state["cdf"], below).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), last), start, step)["cdf"])
    return rated.select("source", "rate", cdf.alias("cdf"))


def copies(seed: str = SEED) -> Column:
    """The quantile: how many values of ``cdf`` are not above the document's uniform number."""
    uniform = _hash_number(13, F.lit(seed), _identity()) / F.lit(float(2**52))
    return F.when(F.col("cdf").isNull(), 0).otherwise(F.size(F.filter("cdf", lambda c: c <= uniform)))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """The columns of ``docs``, ``replica`` (from 1) and ``shuffle_key``, in the order of the key inside each of the tasks it deals to.

    A column of ``docs`` with one of these two names gives way. The table of rates has a row for each
    source; it is written first, so Spark knows its size and broadcasts it only if it is small, else a
    hot source is split by the skew join.
    """
    names = [c for c in docs.columns if c not in ("replica", "shuffle_key")]
    known = staged(rates(docs, weights, temperature, size)).select(F.col("source").alias("_source"), "cdf")
    counted = docs.select(*names).join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies(seed))
    replicated = counted.where("_copies > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))).alias("replica"))
    keyed = replicated.withColumn("shuffle_key", _hash_number(15, F.lit(seed), F.lit("shuffle"), _identity(), F.col("replica").cast("string")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The same in one SQL statement, for the default parameters.
_IDENTITY_SQL = "coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')) || ':' || coalesce(source, ''))"
MIX_SQL = f"""
WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (
    SELECT source, sum(n) OVER () * (sqrt(n) / sum(sqrt(n)) OVER ()) / n AS rate FROM counted
),
steps AS (
    SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rated
),
logs AS (
    SELECT source, rate, k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(k) END) OVER (PARTITION BY source ORDER BY k) AS log_factorial FROM steps
),
cdf AS (
    SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS below FROM logs
),
uniform AS (
    SELECT *, CAST('0x' || substr(md5('{SEED}:' || {_IDENTITY_SQL}), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
    FROM documents
),
copied AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
        (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.below <= d.u) AS copies
    FROM uniform d
),
replicated AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS replica FROM copied)
SELECT *, CAST('0x' || substr(md5('{SEED}:shuffle:' || {_IDENTITY_SQL} || ':' || CAST(replica AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM replicated
"""
