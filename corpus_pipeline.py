"""Cleaning and packing of a corpus: each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of documents. Texts change in one stage: substring dedup takes repeated words out, and a text
that loses some is joined again by single spaces; n_chars stays the length of the text as delivered.
"""

import policylens.llm.decontamination as decontamination
import policylens.llm.packing as packing
import policylens.llm.simhash_dedup as simhash_dedup
import policylens.llm.substring_dedup as substring_dedup
import policylens.llm.toxicity as toxicity
from policylens.sources.staging import stage


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain rejects go. It learns from the labelled ones among `docs`."""
    model = toxicity.fit_toxicity(toxicity.labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of texts whose fingerprints are linked stays, that of the smallest id."""
    return simhash_dedup.keep_one(docs)


def cut_repeats(spark, docs, sf_dir):
    """Words that repeat 13 or more words of a document with a smaller id go; the documents stay."""
    return substring_dedup.dedup_documents(docs, chunk_bytes=2 << 20)  # workers hold other stages' memory as well


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Token sequences of 2048: one row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# A trained classifier chain and a subword vocabulary cannot be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of the last stage over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
