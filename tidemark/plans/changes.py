"""State transitions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import changes as c
from tidemark.registry import query
from tidemark.sources.tables import table


def arrivals(rows):
    """Each event's type and hundredths as a payload for one of 3000 ids, some arriving again, some invalid."""
    amount = F.floor(F.col("value") * 100).cast("long")
    payload = F.concat(F.lit('{"amount":'), F.when(F.col("event_id") % 3 == 0, F.lit(500)).otherwise(amount).cast("string"), F.lit("}"))
    return rows.select(F.col("event_id").alias("seq"), (F.col("event_id") % 3000).cast("string").alias("event_id"), payload.alias("payload"))


_ARRIVALS = """a AS (
  SELECT event_id AS seq, CAST(event_id % 3000 AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN 500 ELSE CAST(floor(value * 100) AS BIGINT) END AS amount FROM events
), v AS (
  SELECT seq, event_id, amount, sha256('{"amount":' || amount || '}') AS digest, amount BETWEEN 1 AND 1000000 AS valid FROM a
), f AS (
  SELECT event_id, min(seq) AS seq, arg_min(digest, seq) AS digest FROM v WHERE valid GROUP BY event_id
)"""


def outcomes_sql() -> str:
    return f"""
WITH {_ARRIVALS}
SELECT v.seq, v.event_id, CASE WHEN NOT valid THEN 'invalid' WHEN v.seq = f.seq THEN 'applied' WHEN v.digest = f.digest THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM v LEFT JOIN f USING (event_id)"""


@query("idempotent_apply", outcomes_sql())
def idempotent_apply(spark, d):
    from tidemark.streaming.inbox import parsed

    return c.applied(parsed(arrivals(table(spark, d, "events")))).select("seq", "event_id", "outcome")


@query("account_balance", f"""
WITH {_ARRIVALS} SELECT CAST(sum(amount) AS BIGINT) AS balance, count(*) AS version FROM v WHERE (event_id, seq) IN (SELECT event_id, seq FROM f)""")
def account_balance(spark, d):
    from tidemark.streaming.inbox import parsed

    rows = c.applied(parsed(arrivals(table(spark, d, "events")))).filter("outcome = 'applied'")
    return rows.agg(F.sum("amount").alias("balance"), F.count(F.lit(1)).alias("version"))


@query("status_upsert", """
SELECT o_orderkey, 'new' AS status, o_totalprice FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM orders WHERE o_orderstatus <> 'O'""")
def status_upsert(spark, d):
    orders = table(spark, d, "orders")
    old = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("new").alias("status"), "o_totalprice")
    return c.upserted(old, new, ["o_orderkey"])


@query("ledger_free_append", """
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE event_type <> 'purchase' AND strftime(ts, '%Y-%m-%d') <> '2024-01-12'
UNION ALL SELECT event_id, '2024-01-12' FROM events WHERE event_type = 'purchase'""")
def ledger_free_append(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    batch = rows.filter("event_type = 'purchase'").select("id")
    return c.ledger_after(rows.filter("event_type <> 'purchase'").select("id", "date"), batch, "2024-01-12", force=True)


@query("reason_union_sorted", """
WITH r AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value > 20) AS a, list(DISTINCT event_type) FILTER (WHERE value < 0.5) AS b FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, []), ['QA']))), ',') AS reasons, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_a FROM r""")
def reason_union_sorted(spark, d):
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 0.5, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.array_join(F.array_sort(F.array_union(F.array_union("a", "b"), F.array(F.lit("QA")))), ",").alias("reasons"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"))


@query("required_keys_subset", """
SELECT event_id, json_keys(props) = ['k'] AS exact, list_has_all(json_keys(props), ['k']) AS covered FROM events""")
def required_keys_subset(spark, d):
    keys, want = F.json_object_keys("props"), F.array(F.lit("k"))
    covered = F.size(F.array_except(want, keys)) == 0
    return table(spark, d, "events").select("event_id", (covered & (F.size(F.array_except(keys, want)) == 0)).alias("exact"), covered.alias("covered"))
