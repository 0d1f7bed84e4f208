"""Usage analytics: totals, groups, gap-filled series.

Filters on time stand directly over the scan; every figure is one aggregation
with map-side combining, and a spine of periods (bounded by the range, not by
the data) is joined to what has been aggregated already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import safe_rate

# Groups of model types in the series, and roles that count as internal.
TYPE_GROUPS = {"chat": "language", "vlm": "vision", "embedding": "embedding", "rerank": "rerank"}
INTERNAL = ("extract",)
RANGE_DAYS = (1, 90, 7)  # least, most, default


def days_or_default(days: int | None) -> int:
    """Days within the allowed range; the default when none are given."""
    low, high, default = RANGE_DAYS
    return default if days is None else min(max(days, low), high)


def since(usage: DataFrame, now: str, days: int | None = None) -> DataFrame:
    """Records of the last ``days`` times 24 hours."""
    start = F.to_timestamp_ntz(F.lit(now)) - F.expr(f"interval {days_or_default(days)} days")
    return usage.where((F.col("created_at") >= start) & (F.col("created_at") <= F.to_timestamp_ntz(F.lit(now))))


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def _calls(outcome: bool | None, name: str) -> Column:
    hit = F.lit(1) if outcome is None else F.when(F.col("success") == outcome, 1)
    return F.count(hit).cast("long").alias(name)


SUMS = ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens")


def totals(usage: DataFrame) -> DataFrame:
    """One row: calls, successes, failures, rate and token sums; zeros without rows."""
    out = usage.agg(_calls(None, "calls"), _calls(True, "successes"), _calls(False, "failures"), *[_total(c) for c in SUMS])
    return out.withColumn("success_rate", safe_rate(F.col("successes"), F.col("calls")))


def by(usage: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """Figures per group, most tokens first, then most calls, then keys."""
    out = usage.groupBy(*keys).agg(_calls(None, "calls"), _calls(True, "successes"), *[_total(c) for c in SUMS])
    out = out.withColumn("success_rate", safe_rate(F.col("successes"), F.col("calls"))).withColumn(
        "cache_rate", safe_rate(F.col("cached_tokens"), F.col("prompt_tokens"))
    )
    return out.orderBy(F.desc("total_tokens"), F.desc("calls"), *keys).limit(top) if top else out


def daily(usage: DataFrame, now: str, days: int | None = None) -> DataFrame:
    """Calls and tokens of each calendar day of the range, zeros for days without rows."""
    n = days_or_default(days)
    spark = usage.sparkSession
    last = F.to_date(F.lit(now))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, n - 1), last)).alias("day"))
    per_day = (
        usage.where(F.to_date("created_at").between(F.date_sub(last, n - 1), last))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(_calls(None, "calls"), _total("total_tokens"))
    )
    joined = spine.join(per_day, "day", "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "total_tokens")]
    return joined.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *filled)


def type_group(c: Column) -> Column:
    pairs = [F.lit(x) for kv in TYPE_GROUPS.items() for x in kv]
    return F.create_map(*pairs)[c]


def series(usage: DataFrame, now: str, hours: int, minutes: int) -> DataFrame:
    """Prompt and cached tokens per bucket of ``minutes`` and type group over the
    last ``hours``, zero-filled, groups with prompt tokens only, with the cache rate."""
    end = F.to_timestamp_ntz(F.lit(now))
    step = F.expr(f"interval {minutes} minutes")
    first = F.window(end - F.expr(f"interval {hours} hours"), f"{minutes} minutes")["start"]
    own = usage.where((F.col("created_at") >= first) & (F.col("created_at") <= end)).withColumn("type_group", type_group(F.col("model_type")))
    own = own.where("type_group is not null")
    per = own.groupBy(F.window("created_at", f"{minutes} minutes")["start"].alias("bucket"), "type_group").agg(
        _total("prompt_tokens"), _total("cached_tokens")
    )
    groups = per.groupBy("type_group").agg(F.sum("prompt_tokens").alias("p")).where("p > 0").select("type_group")
    spine = groups.select("type_group", F.explode(F.sequence(first, end, step)).alias("bucket"))
    joined = spine.join(per, ["bucket", "type_group"], "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("prompt_tokens", "cached_tokens")]
    return joined.select("bucket", "type_group", *filled).withColumn(
        "cache_rate", safe_rate(F.col("cached_tokens"), F.col("prompt_tokens"))
    )


def cache_rates(usage: DataFrame) -> DataFrame:
    """Cache rate per model type, internal roles left out."""
    own = usage.where(~F.col("model_type").isin(*INTERNAL))
    out = own.groupBy("model_type").agg(_total("prompt_tokens"), _total("cached_tokens"))
    return out.withColumn("cache_rate", safe_rate(F.col("cached_tokens"), F.col("prompt_tokens")))


def records(raw: DataFrame) -> DataFrame:
    """Rows as they are written: internal text roles dropped, counts not negative,
    the total defaulting to prompt plus completion, errors cut at 500 characters."""
    clean = raw.where(~F.col("model_type").isin(*INTERNAL))
    for c in ("prompt_tokens", "completion_tokens", "cached_tokens"):
        clean = clean.withColumn(c, F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    total = F.coalesce(F.when(F.col("total_tokens") > 0, F.col("total_tokens")), F.col("prompt_tokens") + F.col("completion_tokens"))
    return clean.withColumn("total_tokens", total).withColumn("error", F.substring(F.coalesce("error", F.lit("")), 1, 500))
