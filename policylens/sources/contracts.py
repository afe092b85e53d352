"""Raw contract files: headerless, tab-separated, rows identified only by their position."""

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from policylens.schema import RAW_TARGET, raw_schema
from policylens.sources.staging import settled


def read_contracts(spark, path, with_target=True):
    """The 86 named columns (85 when the target lies in a file of its own)."""
    return (
        spark.read.schema(raw_schema(with_target))
        .option("sep", "\t").option("mode", "FAILFAST")
        .csv(path)
    )


def read_targets(spark, path):
    schema = T.StructType([T.StructField(RAW_TARGET, T.IntegerType())])
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def _located(scan):
    """The scanned lines with their file block, the task that reads it, and their place in the task."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().alias("_seen"))


SPLIT = ["_file", "_block", "_length", "_task"]


def _count_blocks(scan):
    """Lines of each file block and the place of its first line in the task, from a scan that parses nothing."""
    return settled(_located(scan).groupBy(*SPLIT).agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_seen").alias("_first")))


def file_order(path):
    """Paths with each number padded, so that part 99999 stands before part 100000."""
    pieces = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(pieces, lambda p: F.when(
        p.rlike(r"^\d"), F.lpad(p, F.greatest(F.lit(20), F.char_length(p)), F.lit("0"))).otherwise(p))
    return F.concat_ws("", padded)


def _number(scan, blocks, name):
    """The lines with their number. One row per file block is gathered; rows stay where they are read.

    The scan is split as it was when it was counted; if it is not, as after a change of the session's settings, it fails.
    """
    earlier_in_file = (
        Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    # One row per file.
    earlier_files = Window.orderBy(file_order(F.col("_file")), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("_file").agg(F.sum("_lines").alias("_file_lines")).select(
        "_file", F.coalesce(F.sum("_file_lines").over(earlier_files), F.lit(0)).alias("_file_start"))
    starts = (
        blocks
        .withColumn("_block_start", F.coalesce(F.sum("_lines").over(earlier_in_file), F.lit(0)))
        .join(files, "_file")
        .select(*SPLIT, (F.col("_file_start") + F.col("_block_start") - F.col("_first")).alias("_start"))
    )
    known = F.coalesce("_start", F.raise_error(F.lit("the files are not split as they were counted")).cast("long"))
    return (
        _located(scan).join(settled(starts), SPLIT, "left")
        .withColumn(name, known + F.col("_seen"))
        .drop(*SPLIT, "_seen", "_start")
    )


def with_row_number(scan, name="row_no"):
    """0-based line number over a plain file scan, files in the order of their numbers.

    A first scan counts the lines of each file block; a second one numbers them as it reads. Lines are neither stored nor
    sorted nor shuffled.
    """
    return _number(scan, _count_blocks(scan), name)


def attach_by_position(contracts, targets, row_name="row_no"):
    """Put line i of `targets` beside line i of `contracts`; both are file scans of equal length."""
    sides = [(scan, _count_blocks(scan)) for scan in (contracts, targets)]
    rows, labels = (blocks.agg(F.sum("_lines")).first()[0] or 0 for _, blocks in sides)
    if rows != labels:
        raise ValueError(f"{rows} contract lines but {labels} target lines")
    numbered = [_number(*side, row_name) for side in sides]
    return numbered[0].join(numbered[1], row_name)
