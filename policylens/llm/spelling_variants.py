"""Spelling variants: words that differ by one edit, and the more frequent word each of them stands for.

Method: asymmetric q-chunks. The longer word of a pair (either, if they are of one length) contributes two disjoint chunks, its
first and its last half; the other contributes positional grams of the same length. One edit leaves one of the two chunks as
it is, at the same place or one place on, so the pair meets at a chunk and a gram that are equal and within one place of each
other. Grams elsewhere can meet no chunk and are not made. What the equal half leaves over differs by one edit again, so the
same argument once more gives a second chunk; both are the key of the join, and a frequent half such as a common prefix
brings nobody together by itself. Candidates are verified by their edit distance, and a pair that meets at several keys
is taken at the first of them, so that pairs need not be made distinct.

Words are counted before anything meets: partial counts leave each task, so a word that a third of all texts hold is one row
a task. Roots are found by doubling: each round follows twice as many forms, and a form at least doubles the count, so a
chain is no longer than the logarithm of the largest count.

Results: a null or blank text has no words, a null id reads as an empty one, repeated rows count each time, ties between forms
go to the smallest word in code-point order, and other columns of the input are not read.
"""

from pyspark.sql import functions as F

from policylens.sources.staging import stage

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TYPO_RATE, LEAST_RATIO = 5, 3, 97, 2


def with_typos(words, every=TYPO_RATE):
    """(word) from (doc_id, run): of every so many different (doc_id, run) one loses a letter, told by their checksum."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    rest = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return words.select(F.when(h % every == 0, rest).otherwise(F.col("run")).alias("word"))


def runs_of_letters(docs, id_col="doc_id", text_col="text"):
    """(doc_id, run) for each run of Latin letters, A-Z lower-cased."""
    lowered = F.translate(text_col, UPPER, LOWER)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), 0)).alias("run"))


def count_words(words, least_length=LEAST_LENGTH, least_count=LEAST_COUNT):
    """(word, n) of the words that are long and frequent enough."""
    return (
        words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_count))


def _letters(word, place, n):
    """`n` letters from `place`, counted from 0."""
    return F.substring(word, place + 1, n)


def _keyed(words, name, shift):
    """Rows (name, n, of, chunk, gram, rest_chunk, rest_gram): the four keys of each word for pairs with a longer word of `of` letters.

    With `shift` 0 the word is that longer one, or of its length, and the keys are its chunks; with `shift` 1 it is one letter
    shorter, and its last grams stand one place before the chunk's.
    """
    sized = words.withColumn("of", F.char_length("word") + shift)
    sized = sized.withColumn("q", F.expr("of div 2").cast("int")).withColumn("r", F.expr("(of - of div 2) div 2").cast("int"))
    size, q, r = F.col("of") - shift, F.col("q"), F.col("r")
    begins = {(0, 0): (F.lit(0), q), (0, 1): (F.lit(0), size - r), (1, 0): (size - q, F.lit(0)), (1, 1): (size - q, size - q - r)}
    keys = F.array(*[
        F.struct(
            F.lit(chunk).alias("chunk"), _letters("word", gram, q).alias("gram"),
            F.lit(rest_chunk).alias("rest_chunk"), _letters("word", inner, r).alias("rest_gram"))
        for (chunk, rest_chunk), (gram, inner) in begins.items()])
    return sized.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"), "of", "q", "r", F.inline(keys))


def near_pairs(counted):
    """(a, n_a, b, n_b): the pairs of different words of (word, n) that one inserted, deleted or replaced letter tells apart."""
    key = ["of", "chunk", "gram", "rest_chunk", "rest_gram"]
    chunks = _keyed(counted, "a", 0)
    grams = _keyed(counted, "b", 0).unionByName(_keyed(counted, "b", 1)).drop("q", "r")
    met = chunks.join(grams, key).where((F.char_length("b") < F.col("of")) | (F.col("a") < F.col("b")))
    # A pair counts at its first key: with equal first chunks it has met there, in the whole word as in the rest.
    q, r, rest = F.col("q"), F.col("r"), F.when(F.col("chunk") == 0, F.col("q")).otherwise(0)
    first_whole = (F.col("chunk") == 0) | (_letters("a", F.lit(0), q) != _letters("b", F.lit(0), q))
    first_rest = (F.col("rest_chunk") == 0) | (_letters("a", rest, r) != _letters("b", rest, r))
    return met.where(first_whole & first_rest & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def forms(counted, least_ratio=LEAST_RATIO):
    """(word, n, n_near, form, form_n): near words of each word, and the most frequent if frequent enough."""
    pairs = stage(near_pairs(counted), "near_words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    takes = -F.col("best.minus") >= least_ratio * F.col("n")
    return counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"),
        F.when(takes, -F.col("best.minus")).alias("form_n"))


def with_roots(formed):
    """`formed` and `root`: the word at the end of the chain of forms."""
    jumps = stage(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(jumps.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        jumps = step.select("word", "root")
        if step.where("moved").isEmpty():
            return formed.join(jumps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(counted, least_ratio=LEAST_RATIO):
    """(word, n, n_near, form, form_n, root) for each row of (word, n)."""
    return with_roots(stage(forms(counted, least_ratio), "forms"))


def op11_spelling_variants(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = stage(count_words(with_typos(runs_of_letters(docs))), "words")
    return group_variants(counted).select("word", "form", "root", "n", "n_near", "form_n")
