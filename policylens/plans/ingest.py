"""Raw files to the two policy tables."""

from policylens.operators.translate import translate
from policylens.sources.contracts import attach_by_position, read_contracts, read_targets, with_row_number
from policylens.sources.policies import load_summary, write_table


def ingest(spark, train_file, test_file, test_targets, train_out, test_out, seed=42):
    """Translate both files and write them; policy ids of the test part go on where train ends.

    Returns one summary row per dataset.
    """
    train = translate(with_row_number(read_contracts(spark, train_file)), "row_no", seed)
    write_table(train, train_out)
    written = spark.read.schema(train.schema).parquet(train_out)
    test_raw = attach_by_position(
        read_contracts(spark, test_file, with_target=False), read_targets(spark, test_targets))
    test = translate(test_raw, "row_no", seed, id_offset=written.count())
    write_table(test, test_out)
    return load_summary(written, "train").unionByName(
        load_summary(spark.read.schema(test.schema).parquet(test_out), "test"))
