"""Delivery metrics over tables of runs and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED = ("failure", "cancelled")
#: Minutes to restore that are reported when nothing ever failed.
DEFAULT_MTTR = 30.0


def deployment_frequency(deployments: DataFrame, at: str, start: object, end: object) -> DataFrame:
    """One row ``per_day``: rows with ``start`` <= ``at`` < ``end`` a day."""
    days = (F.unix_timestamp(F.lit(end).cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 86400
    inside = (F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz"))
    return deployments.agg((F.count(F.when(inside, 1)) / F.max(days)).alias("per_day"))


def lead_time(changes: DataFrame, created: str = "created_at", merged: str = "merged_at", last: int | None = 20) -> DataFrame:
    """One row ``hours``: mean time from creation to merge over the ``last`` merged changes (all if
    None); 0 without any."""
    done = changes.where(F.col(merged).isNotNull() & F.col(created).isNotNull())
    recent = done if last is None else done.orderBy(F.desc(merged), F.desc(created)).limit(last)
    return recent.agg(F.coalesce(F.avg(seconds(F.col(created), F.col(merged))) / 3600, F.lit(0.0)).alias("hours"))


def seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, with or without zone."""
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6


def change_failure_rate(runs: DataFrame, conclusion: str = "conclusion", at: str = "created_at", last: int | None = 20) -> DataFrame:
    """One row ``percent`` of the ``last`` runs (all if None) that failed or were cancelled; of runs at
    the same time the first by conclusion count as last."""
    recent = runs if last is None else runs.orderBy(F.desc(at), F.asc(conclusion)).limit(last)
    return recent.agg(F.coalesce(100.0 * F.try_divide(F.count_if(F.col(conclusion).isin(*FAILED)), F.count(F.lit(1))), F.lit(0.0)).alias("percent"))


def recoveries(runs: DataFrame, conclusion: str = "conclusion", created: str = "created_at", updated: str = "updated_at", by: str | None = None) -> DataFrame:
    """(``failed_at``, ``restored_at``, ``minutes``): each success with the last failure before it that
    no earlier success has answered.

    With ``by`` runs are matched within each of its values, which also spreads the work; without it
    they form one sequence, split by day: only the last open failure of a day is carried on.
    """
    own = runs.where(F.col(conclusion).isin("failure", "success")).select(*([by] if by else []), F.col(conclusion).alias("c"), F.col(created).alias("t"), F.col(updated).alias("u"))
    fail = F.when(F.col("c") == "failure", F.struct("t", "u"))
    done = F.when(F.col("c") == "success", F.col("t"))
    if by:
        before = Window.partitionBy(by).orderBy("t", "c").rowsBetween(Window.unboundedPreceding, -1)
        seen = own.withColumn("f", F.last(fail, True).over(before)).withColumn("s", F.last(done, True).over(before))
    else:
        day = own.withColumn("day", F.to_date("t"))
        ends = day.groupBy("day").agg(F.max(fail).alias("df"), F.max(done).alias("ds"))  # a row a day
        earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("day", F.max("df").over(earlier).alias("cf"), F.max("ds").over(earlier).alias("cs"))
        before = Window.partitionBy("day").orderBy("t", "c").rowsBetween(Window.unboundedPreceding, -1)
        seen = day.join(F.broadcast(carried), "day").withColumn("f", F.coalesce(F.last(fail, True).over(before), "cf")).withColumn("s", F.coalesce(F.last(done, True).over(before), "cs"))
    open_ = seen.where((F.col("c") == "success") & F.col("f").isNotNull() & (F.col("s").isNull() | (F.col("f.t") >= F.col("s"))))
    timed = open_.select(*([by] if by else []), F.col("f.u").alias("failed_at"), F.col("t").alias("restored_at"), (seconds(F.col("f.u"), F.col("t")) / 60).alias("minutes"))
    return timed.where("minutes > 0")


def mean_time_to_restore(runs: DataFrame, **columns: str) -> DataFrame:
    """One row ``minutes``; DEFAULT_MTTR if nothing failed and was restored."""
    return recoveries(runs, **columns).agg(F.coalesce(F.avg("minutes"), F.lit(DEFAULT_MTTR)).alias("minutes"))


# Least deployments a day, most hours, per cent and minutes of each level.
LEVELS = (("Elite", 1, 24, 15, 60), ("High", 0.14, 168, 30, 1440), ("Medium", 0.03, 720, 45, 10080))


def performance_level(frequency: Column, lead: Column, failure: Column, restore: Column) -> Column:
    """The best of LEVELS whose limits all four metrics keep, else Low."""
    level = F.lit("Low")
    for name, least, hours, percent, minutes in reversed(LEVELS):
        level = F.when((frequency >= least) & (lead <= hours) & (failure <= percent) & (restore <= minutes), name).otherwise(level)
    return level


def recommendations(frequency: Column, lead: Column, failure: Column, restore: Column) -> Column:
    """What to improve, one sentence each, or that nothing need be."""
    said = F.concat_ws(
        " ",
        F.when(frequency < 1, "Deploy smaller changes more often."),
        F.when(lead > 24, "Shorten the way from change to release."),
        F.when(failure > 15, "Test more before release."),
        F.when(restore > 60, "Automate rollback and alerts."),
    )
    return F.when(said == "", "All metrics are in the target range.").otherwise(said)


def report(frequency: DataFrame, lead: DataFrame, failure: DataFrame, restore: DataFrame) -> DataFrame:
    """One row with the four metrics, the level and the recommendations."""
    joined = frequency.select("per_day").join(F.broadcast(lead.select("hours")), F.lit(True)).join(F.broadcast(failure.select("percent")), F.lit(True)).join(F.broadcast(restore.select("minutes")), F.lit(True))
    m = tuple(F.col(c) for c in ("per_day", "hours", "percent", "minutes"))
    return joined.withColumn("level", performance_level(*m)).withColumn("recommendations", recommendations(*m))


def workflow_status(runs: DataFrame, conclusion: str = "conclusion", at: str = "created_at", last: int | None = 10) -> DataFrame:
    """One row: ``runs``, ``failures`` and ``failure_rate`` as text such as 12.5%."""
    recent = runs if last is None else runs.orderBy(F.desc(at), F.asc(conclusion)).limit(last)
    rate = F.coalesce(100.0 * F.try_divide(F.count_if(F.col(conclusion) == "failure"), F.count(F.lit(1))), F.lit(0.0))
    return recent.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col(conclusion) == "failure").alias("failures"), F.format_string("%.1f%%", rate).alias("failure_rate"))


def recent_runs(runs: DataFrame, run_id: str, at: str = "created_at", show: int = 5) -> DataFrame:
    """The ``show`` latest runs, latest first; ties go to the smaller ``run_id``."""
    return runs.orderBy(F.desc(at), F.asc(run_id)).limit(show)


def run_status(jobs: DataFrame, run: object, run_id: str = "run_id", name: str = "name", conclusion: str = "conclusion", created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """One row about one run from its ``jobs``: ``total_jobs``, the names of ``failed_jobs`` in order,
    ``conclusion`` (failure, cancelled or success, the worst of its jobs; null if none has ended),
    ``created_at`` and ``updated_at``. No jobs give zero and nulls."""
    own = jobs.where(F.col(run_id) == F.lit(run))
    failed = F.col(conclusion) == "failure"
    worst = F.when(F.count_if(failed) > 0, "failure").when(F.count_if(F.col(conclusion) == "cancelled") > 0, "cancelled").when(F.count(conclusion) > 0, "success")
    return own.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.sort_array(F.collect_list(F.when(failed, F.col(name)))).alias("failed_jobs"), worst.alias("conclusion"), F.min(created).alias("created_at"), F.max(updated).alias("updated_at")
    )


def failure_kinds(jobs: DataFrame, name: str = "name", conclusion: str = "conclusion") -> DataFrame:
    """(``kind``, ``n``) of failed jobs, told by their names."""
    low = F.lower(F.col(name))
    kind = F.when(F.contains(low, F.lit("test")), "assertion").when(F.contains(low, F.lit("build")), "import").otherwise("unknown")
    return jobs.where(F.col(conclusion) == "failure").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def valid_workflow_name(c: Column) -> Column:
    """Letters, digits, dots, underscores, hyphens and blanks."""
    return F.coalesce(c.rlike(r"^[\w .-]+$"), F.lit(False))
