"""Input contracts: required columns, key uniqueness, complete universes, quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel import params as P
from volpanel.functions.num import add


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail at run time if a key repeats.

    The count is a window on the join key, so its shuffle is the one the
    following join on the same key would do anyway.
    """
    listed = ", ".join(keys)
    counted = add(df, {"_copies": f"count(1) OVER (PARTITION BY {listed})"})
    fail = f"boolean(raise_error(concat('key repeats: ', concat_ws(',', {listed}))))"
    return counted.filter(f"CASE WHEN _copies = 1 THEN true ELSE {fail} END").drop("_copies")


def exclude(df: DataFrame, column: str, forbidden: Sequence[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(*forbidden), F.lit(False))) if forbidden else df


def require_members(df: DataFrame, member: str, members: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Fail at run time on a forbidden member, and if one of ``members`` has no rows.

    The counts per member are one map-side-combined row, joined to every row.
    """
    listed = lambda names: ", ".join(f"'{n}'" for n in names) or "NULL"
    seen = df.agg(
        F.expr(f"coalesce(count_if({member} IN ({listed(forbidden)})), 0) AS _forbidden"),
        F.expr(f"array_except(array({listed(members)}), collect_set(CASE WHEN {member} IN ({listed(members)}) THEN {member} END)) AS _missing"),
    )
    fail = "boolean(raise_error(concat('universe broken: ', _forbidden, ' excluded rows, without ', array_join(_missing, ','))))"
    checked = seen.filter(f"CASE WHEN _forbidden = 0 AND size(_missing) = 0 THEN true ELSE {fail} END").select(F.lit(1).alias("_whole"))
    return df.withColumn("_whole", F.lit(1)).join(F.broadcast(checked), "_whole").drop("_whole")


def full_universe(df: DataFrame, group: Sequence[str], member: str, members: Sequence[str]) -> DataFrame:
    """Groups whose set of members is exactly the universe."""
    inside = F.col(member).isin(*members)
    good = (
        df.groupBy(*group)
        .agg(
            F.count_distinct(F.when(inside, F.col(member))).alias("_inside"),
            F.max((~F.coalesce(inside, F.lit(False))).cast("int")).alias("_outside"),
        )
        .filter((F.col("_inside") == len(members)) & (F.col("_outside") == 0))
        .select(*group)
    )
    return df.join(good, list(group), "left_semi")


def validate_quotes(
    quotes: DataFrame,
    *,
    licence_verified: bool,
    universe: P.Universe = P.DEFAULT_UNIVERSE,
    tolerance_seconds: int = 5,
    cutoff_clock: str = "14:56:59",
    zone: str = "Asia/Shanghai",
) -> DataFrame:
    """Point-in-time gate for two-sided quotes: one verdict row per session.

    Every rule is a conditional count, so the gate is one partial-aggregated
    shuffle however many quotes a session has.
    """
    missing = missing_columns(quotes, P.QUOTE_COLUMNS)
    if missing:
        if "session_date" not in quotes.columns:
            raise ValueError(f"missing columns: {missing}")
        label = "MISSING_FIELDS:" + ",".join(missing)
        return quotes.groupBy("session_date").agg(
            F.lit(False).alias("accepted"),
            F.lit(0).cast("long").alias("accepted_rows"),
            F.array().cast("array<string>").alias("carriers"),
            F.array(F.lit(label)).alias("issues"),
        )
    bid, ask = (F.expr(f"try_cast({c} AS DOUBLE)") for c in ("bid", "ask"))
    cutoff = F.to_utc_timestamp(
        F.to_timestamp(F.concat_ws(" ", F.col("session_date").cast("string"), F.lit(cutoff_clock))), zone
    )
    event, available = F.col("event_time"), F.col("available_at")
    age = cutoff.cast("double") - event.cast("double")

    def any_row(bad: Column) -> Column:
        return F.bool_or(F.coalesce(bad, F.lit(True)))

    good_quote = (bid > 0) & (ask >= bid)
    carriers = F.array_sort(F.collect_set("carrier_id"))
    expected = F.array(*[F.lit(c) for c in sorted(universe.carriers)])
    excluded = F.col("carrier_id").isin(*universe.excluded_carriers)
    no_event_time = F.bool_or(event.isNull())
    rules = [
        ("NON_DISPLAY_LICENCE_NOT_VERIFIED", F.lit(not licence_verified)),
        ("FOUR_CARRIER_UNIVERSE_INCOMPLETE", carriers != expected),
        ("EXCLUDED_CARRIER_PRESENT", F.bool_or(F.coalesce(excluded, F.lit(False)))),
        ("INVALID_TWO_SIDED_QUOTE", any_row(~good_quote)),
        ("EVENT_TIME_INVALID", no_event_time),
        ("QUOTE_SYNC_TOLERANCE_FAILED", ~no_event_time & any_row(~age.between(0, tolerance_seconds))),
        ("PIT_AVAILABILITY_FAILED", any_row(available > cutoff)),
        ("FORMAL_VINTAGE_FAILED", any_row(~F.col("vintage_kind").isin(*P.QUOTE_VINTAGES))),
        ("CONTRACT_REVISION_MISSING", any_row(F.length(F.col("revision_id").cast("string")) == 0)),
        ("LICENCE_SCOPE_MISSING", F.bool_or(F.col("licence_scope").isNull())),
    ]
    issues = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return (
        quotes.groupBy("session_date")
        .agg(carriers.alias("carriers"), issues.alias("issues"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "session_date",
            (F.size("issues") == 0).alias("accepted"),
            F.when(F.size("issues") == 0, F.col("_rows")).otherwise(0).cast("long").alias("accepted_rows"),
            "carriers",
            "issues",
        )
    )
