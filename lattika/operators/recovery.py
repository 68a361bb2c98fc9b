"""Recovery of sessions from snapshots: what is restored, and how often it is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recover(requests: DataFrame, snapshots: DataFrame, key: str, now: Column, most_age: int, version: str, most_bins: int, most_precincts: int) -> DataFrame:
    """``requests`` with status (failed, partial, full), reason, bins_restored and precincts_restored.

    ``snapshots``: key, at (timestamp), version, n_bins, n_precincts; one row a key. A snapshot older than ``most_age`` seconds or of another version restores nothing.
    """
    rows = requests.join(snapshots, key, "left")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("at"))
    why = F.when(F.col("at").isNull(), "no snapshot").when(age > most_age, "too old").when(F.col("version") != version, "other version")
    bins, precincts = F.least(F.col("n_bins"), F.lit(most_bins)), F.least(F.col("n_precincts"), F.lit(most_precincts))
    whole = (bins == F.col("n_bins")) & (precincts == F.col("n_precincts"))
    part = F.concat(F.lit("restored "), bins.cast("string"), F.lit("/"), F.col("n_bins").cast("string"), F.lit(" bins, "), precincts.cast("string"), F.lit("/"), F.col("n_precincts").cast("string"), F.lit(" precincts"))
    status = F.when(why.isNotNull(), "failed").when(whole, "full").otherwise("partial")
    count = lambda c: F.when(why.isNotNull(), 0).otherwise(c).cast("bigint")
    return rows.select(*requests.columns, status.alias("status"), F.coalesce(why, F.when(~whole, part)).alias("reason"), count(bins).alias("bins_restored"), count(precincts).alias("precincts_restored"))


def restored(bins: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` bins of each session's snapshot; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return bins.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def attempts(events: DataFrame, keys: list[str], order: list[str], works: Column, most: int) -> DataFrame:
    """``events`` with attempt, refused and recovered: attempts count up until one works, and beyond ``most`` all later ones are refused.

    ``works`` tells whether an event would recover if it were tried. A session is ordered in one task.
    """
    own = Window.partitionBy(*keys)
    rows = events.withColumn("_ok", works).withColumn("_pos", F.row_number().over(own.orderBy(*order)))
    rows = rows.withColumn("_run", F.coalesce(F.sum(F.col("_ok").cast("int")).over(own.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_try", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("_pos")))
    rows = rows.withColumn("_stop", F.min(F.when(F.col("_try") > most, F.col("_pos"))).over(own))
    refused = F.coalesce(F.col("_pos") >= F.col("_stop"), F.lit(False))
    attempt = F.when(refused, most + 1 + F.col("_pos") - F.col("_stop")).otherwise(F.col("_try")).cast("bigint")
    return rows.select(*events.columns, attempt.alias("attempt"), refused.alias("refused"), (~refused & F.col("_ok")).alias("recovered"))
