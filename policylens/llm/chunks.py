"""Questions from chunks of rows to all other chunks, answered entry by entry.

Documents are dealt into chunks of bounded bytes by a hash of their rows. A chunk sends each different key once, however
often it holds it; all entries of one key range meet in one bucket, and the bucket sends its answers back, in the order in
which the chunk sent the entries. A key that a third of all rows hold is therefore one entry per chunk, no group of copies
ever meets in one task, and no pairs are made.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from policylens.llm.shipping import ship_package

CHUNK_BYTES = 4 << 20
SENT = "bucket int, chunk long, body binary"
ANSWERED = "chunk long, round int, bucket int, body binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
ANSWERED_ARROW = pa.schema([
    ("chunk", pa.int64()), ("round", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])


def small_batches(spark, rows=256):
    """Get a session ready for Python tasks on texts: bound the rows that go to a worker at once, and ship the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(columns, base):
    """A column name that is not among `columns`, in any case of letters."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(df, names, needed=()):
    """`df` without columns of these names, which the result is about to have itself."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken or c in needed])


def deal(docs, id_col, text_col, chunk_bytes=CHUNK_BYTES):
    """(documents with a `chunk` beside a struct of their columns, number of chunks)."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / chunk_bytes))
    # Rows of one key are spread by their text: no id, nor its absence, can fill a chunk.
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("long")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(
        chunk.alias("chunk"), F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias(free_name(others, "_none"))).alias("rest")), n


def in_order(table):
    """The rows of a chunk in the same order whenever the chunk is read."""
    return table.sort_by([("key", "ascending"), ("text", "ascending")]) if table.num_rows else table


def by_chunk(table):
    """The rows of a bucket in the same order whenever it is answered."""
    return table.sort_by("chunk") if table.num_rows else table


def spread_buckets(sent):
    """The rows to answer, dealt to all shuffle partitions: a bucket's work is not told by its bytes."""
    return sent.repartition(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").groupBy("bucket")


def bucket_cuts(keys, n):
    """Places in the sorted 64-bit `keys` where each of `n` equal key ranges begins, and the end."""
    edges = [min((i << 64) // n, (1 << 64) - 1) for i in range(n)]
    return np.append(np.searchsorted(keys, np.array(edges, dtype=np.uint64)), len(keys))


def bodies(chunk, keys, n, pack):
    """Rows to send: one for each range that has entries; `pack(slice)` gives its bytes."""
    cuts = bucket_cuts(keys, n)
    used = [b for b in range(n) if cuts[b + 1] > cuts[b]]
    return pa.Table.from_arrays([
        pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()),
        pa.array([pack(slice(cuts[b], cuts[b + 1])) for b in used], pa.binary())], schema=SENT_ARROW)


def answers(table, round_no, packed):
    return pa.Table.from_arrays([
        table["chunk"].combine_chunks(), pa.array([round_no] * len(packed), pa.int32()), table["bucket"].combine_chunks(),
        pa.array(packed, pa.binary())], schema=ANSWERED_ARROW)


def read_answers(table, round_no):
    """Bodies of one round in the order of their buckets."""
    mine = [r for r in table.select(["round", "bucket", "body"]).to_pylist() if r["round"] == round_no]
    return [r["body"] for r in sorted(mine, key=lambda r: r["bucket"])]


def planes(numbers):
    """64-bit numbers byte by byte, the first bytes of all before the second: leading zeros then compress away."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data, n):
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).reshape(-1).view(np.uint64)


def groups_of(*sorted_columns):
    """Group number of every row, for columns that are sorted together."""
    n = len(sorted_columns[0])
    new = np.zeros(n, dtype=bool)
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)
