"""Scoring of a policy stream with the same functions as the batch job.

Stateless: every record is validated, given its features under static medians, scored and written; no
watermark is needed. Records that break a rule go to a sink of their own with the names of the broken
fields. Each micro-batch also yields one summary row. Records are in the order in which they arrived: by
the time of their file, its path, and their place in it.
"""

from pyspark.sql import functions as F

from policylens.functions.nulls import nan_to_null
from policylens.operators.scoring import at_risk_summary, batch_result
from policylens.operators.validate import check, fill_last_contact, rejected_rows, valid_rows
from policylens.schema import REQUEST

ARRIVAL = "_arrival"


def read_stream(spark, path, files_per_batch=None):
    reader = spark.readStream.schema(REQUEST)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    requests = reader.parquet(path)
    arrival = F.struct(*[
        F.col(f"_metadata.{field}").alias(field) for field in ("file_modification_time", "file_path", "row_index")])
    return nan_to_null(requests.select("*", arrival.alias(ARRIVAL)))


def score_stream(requests, scorer, scores_path, summary_path, checkpoint_path, rejects_path=None, arrival=ARRIVAL):
    """Start a query that scores what is there and stops; returns it.

    `scorer` adds `churn_probability`; `arrival` orders the records. Each batch owns one folder in every sink
    and overwrites it, so a batch that runs again after a failure leaves no second copy. Without `rejects_path`
    the rejected records go beside the scores, in a folder whose name ends in `-rejected`.
    """
    rejects_path = rejects_path or f"{scores_path.rstrip('/')}-rejected"

    def write(batch, batch_id):
        checked = check(batch).persist()
        scored = scorer(fill_last_contact(valid_rows(checked))).persist()
        try:
            rejected_rows(checked).drop(arrival).write.mode("overwrite").parquet(f"{rejects_path}/batch_id={batch_id}")
            batch_result(scored).write.mode("overwrite").parquet(f"{scores_path}/batch_id={batch_id}")
            at_risk_summary(scored, arrival).coalesce(1).write.mode("overwrite").parquet(
                f"{summary_path}/batch_id={batch_id}")
        finally:
            scored.unpersist()
            checked.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
