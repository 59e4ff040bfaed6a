"""Queries that score answers place by place, over groups of rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import physics
from cairn.operators import profiling
from cairn.plans.catalog import query


@query("""with v as (select l_orderkey, list(case when l_linenumber % 2 = 0 then l_returnflag else cast(l_quantity as varchar) end order by l_linenumber, l_quantity, l_returnflag) as w from lineitem group by l_orderkey),
  p as (select l_orderkey, w[1:2] as pred, w[3:4] as truth from v)
  select l_orderkey, len(pred) = len(truth) and len(list_filter(list_zip(pred, truth), lambda z: coalesce(case when try_cast(z[1] as double) is not null and try_cast(z[2] as double) is not null
    then abs(try_cast(z[1] as double) - try_cast(z[2] as double)) / abs(try_cast(z[2] as double)) <= 0.02 else lower(trim(z[1])) = lower(trim(z[2])) end, false))) = len(pred) as alike from p""")
def answers_compared(t):
    """An order's first two lines against its next two: quantities within 2 %, flags as text."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.col("l_quantity").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", text.alias("text"))))
    orders = t("lineitem").groupBy("l_orderkey").agg(lines.alias("lines")).select("l_orderkey", F.col("lines.text").alias("w"))
    return orders.select("l_orderkey", physics.answers_equal(F.slice("w", 1, 2), F.slice("w", 3, 2)).alias("alike"))


@query("""with v as (select user_id, list(event_type order by ts, event_id) as w from events group by user_id)
  select count(*) as total, round(100.0 * avg(case when list_sort(w[1:2]) = list_sort(w[3:4]) then 1 else 0 end), 6) as domain_accuracy,
    round(100.0 * sum(case when w[1] = w[3] then 1 else 0 end) / greatest(1, count(w[3])), 6) as first_accuracy from v""")
def domain_rates(t):
    """How often a user's first two events are of the same kinds as the next two, in any order, and the first of the same kind."""
    events = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    users = t("events").groupBy("user_id").agg(events.alias("e")).select(F.col("e.event_type").alias("w"))
    first, third = F.get("w", F.lit(0)), F.get("w", F.lit(2))
    rates = {"domain_accuracy": (profiling.domains_equal(F.slice("w", 1, 2), F.slice("w", 3, 2)), F.lit(1)), "first_accuracy": (F.coalesce(first == third, F.lit(False)), third.isNotNull())}
    found = profiling.metrics(users, rates)
    return found.select("total", *[F.round(c, 6).alias(c) for c in rates])
