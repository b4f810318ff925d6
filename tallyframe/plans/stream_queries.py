"""Queries for one-shot transactions and ordered state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.queries import query
from tallyframe.plans.views import table
from tallyframe.streaming import transactions

#: A contract is a user's day; views and clicks open it, signups and purchases close it.
ATTEMPTS = """a as (select concat(cast(user_id as varchar), '-', cast(cast(ts as date) as varchar)) as contract, case when event_id % 97 = 5 then null else concat('a', cast(event_id % 3 as varchar)) end as attempt, ts,
  case event_type when 'signup' then 'done' when 'purchase' then 'failed' when 'view' then 'open' when 'click' then 'open' else event_type end as kind from events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = F.when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "purchase", "failed").when(F.col("event_type").isin("view", "click"), "open").otherwise(F.col("event_type"))
    attempt = F.when(F.col("event_id") % 97 != 5, F.concat(F.lit("a"), F.col("event_id") % 3))
    return events.select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("contract"), attempt.alias("attempt"), "ts", kind.alias("kind"))


@query(
    f"""with {ATTEMPTS}, sound as (select * from a where contract is not null and attempt is not null and ts is not null and kind in ('open', 'done', 'failed')),
numbered as (select *, row_number() over (partition by contract order by ts, case kind when 'open' then 0 when 'done' then 1 else 2 end, attempt) as n from sound),
held as (select contract, attempt as holder, ts as opened, ts + interval 6 hours as deadline, row_number() over (partition by contract order by n) as k from numbered where kind = 'open' qualify k = 1),
tried as (select numbered.*, holder, opened, deadline, coalesce(kind <> 'open' and attempt = holder and ts >= opened and ts <= deadline, false) as counts from numbered left join held using (contract)),
ended as (select contract, ts as end_ts, kind as end_kind from tried where counts qualify row_number() over (partition by contract order by n) = 1),
out as (select 'ledger' as part, contract, holder as attempt, opened as ts, 'opened' as code from held
  union all select 'ledger', contract, holder, end_ts, end_kind from held join ended using (contract)
  union all select 'ledger', contract, holder, deadline, 'timed_out' from held where contract not in (select contract from ended) and deadline < (select max(ts) from sound)
  union all select 'audit', contract, attempt, ts, case when kind = 'open' then 'retry_not_permitted' when opened is null or ts < opened then 'no_attempt' when attempt <> holder then 'not_the_attempt' else 'already_closed' end
    from tried left join ended using (contract) where (kind = 'open' and attempt <> holder) or (kind <> 'open' and not (ts >= opened and attempt = holder and end_kind = kind) is true)
  union all select 'audit', contract, attempt, ts, 'malformed' from a where contract is null or attempt is null or ts is null or kind not in ('open', 'done', 'failed'))
select part, contract, attempt, ts, code, count(*) as times from out group by 1, 2, 3, 4, 5"""
)
def one_shot_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transactions.settle(attempts(spark, sf_dir), "6 hours")
    return found.groupBy("part", "contract", "attempt", "ts", "code").agg(F.count("*").alias("times"))
