"""User journeys: per-user rollup, user-level KPIs, sessions to first conversion, touch attribution.

Everything here is keyed by user. A shared id (an "anonymous" bucket, a bot) can
hold a large part of all sessions, so no job sorts or collects one user's
sessions in a single task:

* rollups are combinable aggregations (partial aggregation per task first);
* the first-conversion session number is found without a per-user window: the
  first converting session key per (user, arm) is a combinable ``min``, and its
  number is one more than the user's sessions before that key, counted by a
  join on ``user_id`` (AQE splits a hot user's partition; see ``first_conversion``)
  followed by a combinable count.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import avg_d, rnd
from ..spec import DEFAULT_SPEC, ExperimentSpec
from .clean import normal
from .common import share_of


def user_rollup(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC, digits: int | None = None) -> DataFrame:
    """One row per (user, arm): sessions, conversions, ever converted, per-session averages.

    Averages are unrounded unless ``digits`` is given (a float sum's last bits depend
    on the summation order, so published tables round them).
    """
    n = normal(clean_df, spec)
    out = n.groupBy("user_id", "test_group").agg(
        F.count("*").alias("total_sessions"),
        F.sum("conversion_flag").cast("bigint").alias("total_conversions"),
        F.max("conversion_flag").alias("ever_converted"),
        avg_d("widgets_viewed").alias("avg_widgets_per_session"),
        avg_d("time_on_dashboard_clean").alias("avg_time_per_session"),
        avg_d("bounce_flag").alias("bounce_rate"),
    )
    if digits is None:
        return out
    averages = ("avg_widgets_per_session", "avg_time_per_session", "bounce_rate")
    return out.withColumns({c: rnd(c, digits) for c in averages})


def user_summary(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Per-arm user KPIs: two-level aggregation (users first, then the mean of user means)."""
    users = user_rollup(clean_df, spec)
    return (
        users.groupBy("test_group")
        .agg(
            F.count("*").alias("total_users"),
            rnd(F.avg("total_sessions"), 2).alias("avg_sessions_per_user"),
            F.sum("ever_converted").cast("bigint").alias("users_who_converted"),
            rnd(F.avg("ever_converted") * 100, 2).alias("user_conversion_rate_pct"),
            rnd(F.avg("avg_widgets_per_session"), 2).alias("avg_widgets_per_session"),
            rnd(F.avg("avg_time_per_session"), 1).alias("avg_time_per_session"),
        )
        .orderBy("test_group")
    )


def first_rows(rows: DataFrame, keys: Sequence[str], conditions: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Per key and condition, the earliest row that meets it: ``keys``, ``which``, ``ts``, ``row`` (a struct of ``keep``).

    Order: ``session_timestamp``, then ``session_id``, NULLs first; NULL keys are keys. Two phases: the
    least time is a fixed-width buffer, so the first aggregation is hashed and sorts no
    sessions; ties are settled by id among the rows at that time only, found by an equi-join
    on keys and time, over which a hot key spreads.
    """
    aggs = []
    for name, met in conditions.items():
        aggs += [
            F.min(F.when(met, F.col("session_timestamp"))).alias(f"{name}__ts"),
            F.count_if(met & F.col("session_timestamp").isNull()).alias(f"{name}__untimed"),
        ]
    times = rows.groupBy(*keys).agg(*aggs)
    each = [
        F.struct(
            F.lit(name).alias("which"),
            F.when(F.col(f"{name}__untimed") == 0, F.col(f"{name}__ts")).alias("ts"),
            (F.col(f"{name}__ts").isNotNull() | (F.col(f"{name}__untimed") > 0)).alias("met"),
        )
        for name in conditions
    ]
    times = times.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.explode(F.array(*each)).alias("t")).filter("t.met")
    times = times.select(*[f"key_{k}" for k in keys], F.col("t.which").alias("which"), F.col("t.ts").alias("ts"))
    same = F.col("session_timestamp").eqNullSafe(F.col("ts"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    meets = functools.reduce(Column.__or__, [(F.col("which") == name) & met for name, met in conditions.items()])
    found = rows.join(times, same).filter(meets)
    return found.groupBy(*keys, "which", "ts").agg(F.min_by(F.struct(*keep), F.struct("session_id")).alias("row"))


def first_conversion(
    clean_df: DataFrame, method: str = "join", spec: ExperimentSpec = DEFAULT_SPEC, salt_buckets: int = 32
) -> DataFrame:
    """Number of the first converting session per (user, arm).

    Sessions are numbered per user over all the user's sessions, ordered by timestamp
    then session id (NULLs first); a user seen in both arms is numbered across arms, NULL
    user ids are one user. The number is one more than the user's sessions strictly
    before the first converting one, so repeated rows of a session share its number.

    ``method="join"`` (default) is skew-safe and combinable (see module doc): AQE splits a
    hot user's partition. ``method="salted"`` spreads every user over ``salt_buckets``
    buckets by a hash of the session id and repeats the (small) key side per bucket, for
    clusters that run without AQE. ``method="window"`` is the direct ``row_number`` form,
    for small data and tests.
    """
    n = normal(clean_df, spec).select("user_id", "test_group", "session_timestamp", "session_id", "conversion")
    if method == "window":
        w = Window.partitionBy("user_id").orderBy("session_timestamp", "session_id")
        return (
            n.withColumn("session_number", F.row_number().over(w))
            .filter(F.col("conversion") == 1)
            .groupBy("user_id", "test_group")
            .agg(F.min("session_number").alias("session_of_first_conversion"))
        )
    if method not in ("join", "salted"):
        raise ValueError(f"unknown method {method!r}")
    place = F.struct(F.col("session_timestamp").alias("ts"), F.col("session_id").alias("sid"))
    converting = n.filter(F.col("conversion") == 1)
    first_key = first_rows(converting, ["user_id", "test_group"], {"first": F.lit(True)}, ["session_id"])
    first_key = first_key.select("user_id", "test_group", F.struct("ts", F.col("row.session_id").alias("sid")).alias("k"))
    # The count is grouped by one struct (user, arm, conversion key) rather than by the
    # join key, so it gets its own exchange fed by per-task partial counts, and AQE
    # may split a hot user's join partition over many tasks without adding a shuffle
    # (it declines to split when the next operator would reuse the join's user_id
    # partitioning, which would leave that user's count to one task).
    first_key = first_key.select(F.col("user_id").alias("key_user"), F.struct("user_id", "test_group", "k").alias("fk"))
    visits = n.select("user_id", place.alias("place"))
    same_user = F.col("user_id").eqNullSafe(F.col("key_user"))
    if method == "salted":
        visits = visits.withColumn("salt", F.pmod(F.xxhash64("place.sid"), F.lit(salt_buckets)))
        buckets = F.sequence(F.lit(0), F.lit(salt_buckets - 1)).cast("array<bigint>")
        first_key = first_key.withColumn("key_salt", F.explode(buckets))
        same_user = same_user & (F.col("salt") == F.col("key_salt"))
    return (
        visits.join(first_key, same_user)
        .groupBy("fk")
        .agg((F.count_if(F.col("place") < F.col("fk.k")) + 1).alias("session_of_first_conversion"))
        .select("fk.user_id", "fk.test_group", "session_of_first_conversion")
    )


def sessions_to_conversion(clean_df: DataFrame, method: str = "join", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Distribution of the first-conversion session number per arm, with share of converters."""
    fc = first_conversion(clean_df, method, spec)
    return (
        fc.groupBy("test_group", "session_of_first_conversion")
        .agg(F.count("*").alias("users"))
        .select(
            "test_group",
            "session_of_first_conversion",
            "users",
            share_of("users", "test_group").alias("pct_of_converters"),
        )
        .orderBy("test_group", "session_of_first_conversion")
    )


def touch_attribution(clean_df: DataFrame, dim: str = "device_type", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """First-touch and last-touch attribution of converters to a ``dim`` value, per arm.

    Our reading of "attribution modeling": for each converting (user, arm), the
    first touch is ``dim`` of the user's first session in that arm, the last touch
    is ``dim`` of the first converting session (see ``first_rows``).
    """
    n = normal(clean_df, spec).select("user_id", "test_group", "session_timestamp", "session_id", dim, "conversion")
    touches = first_rows(n, ["user_id", "test_group"], {"first_touch": F.lit(True), "last_touch": F.col("conversion") == 1}, [dim])
    # first touches of converters only
    names = ("first_touch", "last_touch")
    touches = touches.groupBy("user_id", "test_group").agg(*[F.max(F.when(F.col("which") == name, F.struct("row"))).alias(name) for name in names])
    each = F.array(*[F.struct(F.lit(m).alias("attribution_model"), F.col(f"{m}.row.{dim}").alias(dim)) for m in names])
    long = touches.filter(F.col("last_touch").isNotNull()).select("test_group", F.explode(each).alias("t"))
    long = long.select("test_group", "t.attribution_model", f"t.{dim}")
    return (
        long.groupBy("test_group", "attribution_model", dim)
        .agg(F.count("*").alias("converters"))
        .select(
            "test_group",
            "attribution_model",
            dim,
            "converters",
            share_of("converters", "test_group", "attribution_model").alias("pct_of_converters"),
        )
        .orderBy("test_group", "attribution_model", dim)
    )


# States of a journey beside its touches.
_START, _CONVERSION, _EXIT = "<start>", "<conversion>", "<exit>"
_UNKNOWN_TOUCH = "~"  # a NULL value of the dimension; known ones begin with "="


def touch_transitions(clean_df: DataFrame, dim: str = "device_type", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Transition counts of all journeys: ``test_group``, ``source``, ``target``, ``steps``.

    A journey is a run of one user's sessions in one arm, in order; a converting session
    ends it in ``<conversion>`` and the next session starts another, and the last session
    ends in ``<exit>`` unless it converted. Sessions are put in order within (user, arm, hour),
    and the hours of a user by their first and last sessions: a window never holds more
    than one user's hour of sessions, or one row for each of a user's hours.
    """
    touch = F.coalesce(F.concat(F.lit("="), F.col(dim).cast("string")), F.lit(_UNKNOWN_TOUCH))
    rows = normal(clean_df, spec).select(
        "user_id",
        "test_group",
        "session_timestamp",
        "session_id",
        F.date_trunc("hour", F.col("session_timestamp")).alias("hour"),
        touch.alias("touch"),
        F.coalesce(F.col("conversion") == 1, F.lit(False)).alias("hit"),
    )
    within = Window.partitionBy("user_id", "test_group", "hour").orderBy("session_timestamp", "session_id", "touch", "hit")
    # what the next session comes from
    rows = rows.withColumn("state", F.when(F.col("hit"), F.lit(_START)).otherwise(F.col("touch")))
    rows = rows.withColumns({"before": F.lag("state").over(within), "last": F.lead("touch").over(within).isNull()})
    step = lambda source, target: F.struct(source.alias("source"), target.alias("target"))
    own = F.array(F.when(F.col("hit"), step(F.col("touch"), F.lit(_CONVERSION))), F.when(F.col("before").isNotNull(), step(F.col("before"), F.col("touch"))))
    hours = rows.groupBy("user_id", "test_group", "hour").agg(
        F.max(F.when(F.col("before").isNull(), F.col("touch"))).alias("first"), F.max(F.when(F.col("last"), F.col("state"))).alias("left")
    )
    across = Window.partitionBy("user_id", "test_group").orderBy("hour")
    hours = hours.withColumns({"before": F.coalesce(F.lag("left").over(across), F.lit(_START)), "final": F.lead("left").over(across).isNull()})
    between = F.array(step(F.col("before"), F.col("first")), F.when(F.col("final") & (F.col("left") != _START), step(F.col("left"), F.lit(_EXIT))))
    counted = [
        part.select("test_group", F.explode(steps).alias("s")).filter("s IS NOT NULL").groupBy("test_group", "s").agg(F.count("*").alias("steps"))
        for part, steps in ((rows, own), (hours, between))
    ]
    total = counted[0].unionByName(counted[1]).groupBy("test_group", "s").agg(F.sum("steps").alias("steps"))
    return total.select("test_group", "s.source", "s.target", "steps")


def _chance(steps: dict[tuple[str, str], int], touches: list[str], removed: str | None) -> float:
    """Chance that a journey ends in a conversion when every step to ``removed`` ends it instead."""
    left = {s: sum(n for (a, _), n in steps.items() if a == s) for s in [_START, *touches]}
    share = lambda a, b: steps.get((a, b), 0) / left[a] if left[a] and b != removed else 0.0
    inner = np.array([[share(a, b) for b in touches] for a in touches])
    ends = np.array([share(a, _CONVERSION) for a in touches])
    reach = np.linalg.solve(np.eye(len(touches)) - inner, ends)
    return float(sum(share(_START, b) * reach[i] for i, b in enumerate(touches)))


def chain_attribution(clean_df: DataFrame, dim: str = "device_type", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Multi-touch attribution by an absorbing Markov chain, per arm.

    The removal effect of a touch is the share of conversions lost if every step to it
    ended the journey; an arm's conversions are credited in proportion to removal effects, so
    credits sum to the conversions. The transition counts (at most the square of the levels
    of ``dim`` for each arm) come to the driver, where the small chains are solved; the
    result is a local table. Without conversions credits are 0 and effects NULL.
    """
    found: dict[str, dict[tuple[str, str], int]] = {}
    for r in touch_transitions(clean_df, dim, spec).collect():
        found.setdefault(r["test_group"], {})[r["source"], r["target"]] = r["steps"]
    out = []
    for arm, steps in found.items():
        touches = sorted({b for _, b in steps} - {_CONVERSION, _EXIT})
        conversions = sum(n for (_, b), n in steps.items() if b == _CONVERSION)
        whole = _chance(steps, touches, None)
        effect = {t: 1 - _chance(steps, touches, t) / whole if whole > 0 else None for t in touches}
        total = sum(e or 0.0 for e in effect.values())
        for t in touches:
            seen = sum(n for (_, b), n in steps.items() if b == t)
            out.append((arm, None if t == _UNKNOWN_TOUCH else t[1:], seen, effect[t], conversions * effect[t] / total if total > 0 else 0.0, conversions))
    table = clean_df.sparkSession.createDataFrame(out, f"test_group string, `{dim}` string, touches long, effect double, credit double, conversions long")
    return table.select(
        "test_group",
        dim,
        "touches",
        rnd("effect", 6).alias("removal_effect"),
        rnd("credit", 4).alias("credited_conversions"),
        rnd(F.col("credit") * 100 / F.nullif(F.col("conversions"), F.lit(0)), 2).alias("pct_of_conversions"),
    ).orderBy("test_group", dim)
