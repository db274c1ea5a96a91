"""Extras beyond batch: the same results from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.plans.base import Registry
from strandloom.session import table
from strandloom.streaming import events as ev

REG = Registry()


@REG.add("x_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_stream_windows(spark, folder):
    """Extra: tumbling windows over the event stream, complete at its end."""
    return ev.drained(ev.window_counts(ev.stream(spark, folder).withWatermark("at", "2 hours")), "complete")


@REG.add("x_stream_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT min(t) AS start_us, max(t) + 1800000000 AS end_us, user_id, count(*) AS n FROM s GROUP BY user_id, g""")
def x_stream_sessions(spark, folder):
    """Extra: session windows over the event stream, complete at its end."""
    return ev.drained(ev.sessions(ev.stream(spark, folder).where("user_id is not null").withWatermark("at", "2 hours")), "complete")


@REG.add("x_approximate_distinct")
def x_approximate_distinct(spark, folder):
    """Extra: approximate distinct counts, within 2 %."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("n_orders"))


QUERIES, SQL = REG.queries, REG.sql
