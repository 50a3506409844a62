"""T. Window functions."""

from pyspark.sql import Window, functions as F

from ..operators.windows import rolling_mean_std, with_position
from .registry import query


@query("t01_rolling_global", """
SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w ELSE value END, 4) AS value_rolling_mean,
 round(CASE WHEN count(value) OVER w = 5 THEN stddev_samp(value) OVER w ELSE 0 END, 4) AS value_rolling_std FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def t01(t):
    out = rolling_mean_std(t.events.select("event_id", "ts", "value"), ["value"], ["ts", "event_id"], 5)
    return out.select("event_id", *[F.round(c, 4).alias(c) for c in ("value_rolling_mean", "value_rolling_std")])


@query("t02_number_per_key", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events")
def t02(t):
    out = with_position(t.events.select("user_id", "event_id", "ts"), ["ts", "event_id"], ["user_id"], "number")
    return out.select("user_id", "event_id", (F.col("number") + 1).alias("number"))


@query("t03_first_last", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def t03(t):
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query("t04_share_of_total", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events) * 100, 6) AS percent FROM events GROUP BY event_type")
def t04(t):
    per = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = t.events.agg(F.count(F.lit(1)).alias("total")).scalar()
    return per.select("event_type", "n", F.round(F.col("n") / total * 100, 6).alias("percent"))


@query("t05_rank_by_score", "SELECT p_brand, n, rank() OVER (ORDER BY n DESC) AS rank, dense_rank() OVER (ORDER BY n DESC) AS dense_rank FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def t05(t):
    """Ranks over one row per brand, a small table after the grouping."""
    per = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"))
    return per.select(
        "p_brand", "n", F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense_rank")
    )
