"""The portfolio at risk over a whole stream.

The state has one entry for each policy: its rows at risk so far and the premium of its first request, by arrival. It lives
in the query's checkpoint, so a repeated policy counts with its first premium however many micro-batches or restarts lie
between. Each micro-batch writes the policies it has changed; the total takes the latest entry of every policy.
"""

from pyspark.sql import functions as F

from policylens.operators.scoring import at_risk_by_policy, at_risk_total
from policylens.operators.validate import check, fill_last_contact, valid_rows
from policylens.schema import POLICY_ID
from policylens.streaming.score_stream import ARRIVAL

ENTRY = f"{POLICY_ID} string, rows_at_risk long, first_premium double, batch_id long"


def portfolio_stream(requests, scorer, entries_path, checkpoint_path, arrival=ARRIVAL):
    """Start a query that takes in what is there and stops; returns it. Records that break a rule count for nothing.

    `scorer` adds `churn_probability`; `arrival` orders the records. A batch that runs again overwrites its own folder.
    """
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{entries_path}/batch_id={batch_id}")

    scored = scorer(fill_last_contact(valid_rows(check(requests))))
    return (
        at_risk_by_policy(scored, arrival).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def portfolio_total(spark, entries_path):
    """Rows at risk and their premiums over all that has arrived, in one row."""
    entries = spark.read.schema(ENTRY).parquet(entries_path)
    latest = F.max_by(F.struct("rows_at_risk", "first_premium"), "batch_id").alias("entry")
    return at_risk_total(entries.groupBy(POLICY_ID).agg(latest).select(POLICY_ID, "entry.*"))
