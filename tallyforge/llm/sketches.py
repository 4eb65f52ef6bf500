"""Document fingerprints: threshold-scaled sketches of word shingles, in built-in functions only.

A text is lower-cased and cut at white space; each word gives the shingle of it and up to four words before it, so a text
of n words has n shingles, however short. Of the distinct 64-bit shingle hashes the sketch keeps every one in the lowest
1/``SCALE`` of the range, and the ``FLOOR`` smallest in any case, so that short texts keep (nearly) all. Below the
smaller of two sketches' bounds both are complete, so shares counted there estimate containment however unequal
the documents are, and the sketch of several documents together is the union of theirs under the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import settle, shards, texts

SCALE, FLOOR = 16, 32
_MIN = -(1 << 63)
#: Kept hashes lie below this bound of the signed range.
BOUND = _MIN + (1 << 64) // SCALE
_TOP = (1 << 63) - 1


def hashes(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"\s+"), ""), lambda w: F.xxhash64(w))


def shingles(words: Column) -> Column:
    """Distinct hashes, ascending, of each word hash with the four before it."""
    return F.sort_array(F.array_distinct(F.transform(
        words, lambda x, i: F.xxhash64(x, F.get(words, i - 1), F.get(words, i - 2), F.get(words, i - 3), F.get(words, i - 4)))))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: struct of the number of shingles ``n`` and the kept hashes ``h``, ascending.

    Each step is a column of its own, so that none is evaluated twice.
    """
    others = list(df.columns)
    df = df.select(*others, hashes(F.col(text)).alias("_words"))
    df = df.select(*others, shingles(F.col("_words")).alias("_all"))
    kept = F.filter("_all", lambda x, i: (x < BOUND) | (i < FLOOR))
    return df.select(*others, F.struct(F.size("_all").alias("n"), kept.alias("h")).alias(name))


def fingerprint(sketch: str) -> Column:
    """Number of shingles and kept hashes in hexadecimal."""
    digits = F.transform(f"{sketch}.h", lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(F.col(f"{sketch}.n")), 8, "0"), F.lit(":"), F.array_join(digits, "")))


def parsed(print_: Column) -> Column:
    """Sketch of a fingerprint string."""
    n = F.length(print_) - 9
    places = F.when(n > 0, F.sequence(F.lit(10), n - 6, F.lit(16))).otherwise(F.array().cast("array<int>"))
    signed = F.transform(places, lambda at: F.conv(F.substring(print_, at, F.lit(16)), 16, -10).cast("long"))
    return F.struct(F.conv(F.substring(print_, 1, 8), 16, 10).cast("int").alias("n"), signed.alias("h"))


def bound(sketch: str) -> Column:
    """Up to where a sketch is complete."""
    h = F.col(f"{sketch}.h")
    return F.when(F.size(h) == F.col(f"{sketch}.n"), F.lit(_TOP)).otherwise(F.greatest(F.lit(BOUND - 1), F.element_at(h, -1)))


def containment(a: str, b: str) -> Column:
    """Share of the smaller of two sketched documents that the other contains, 0 to 1.

    Two empty documents contain each other; an empty one and another share nothing.
    """
    def below(s: str) -> Column:
        return F.size(F.filter(f"{s}.h", lambda x: x <= F.least(bound(a), bound(b))))

    least = F.least(below(a), below(b))
    empty = (F.col(f"{a}.n") == 0) | (F.col(f"{b}.n") == 0)
    both = F.size(F.array_intersect(f"{a}.h", f"{b}.h"))
    return (F.when(empty, (F.col(f"{a}.n") == F.col(f"{b}.n")).cast("double")).when(least == 0, F.lit(0.0))
            .otherwise(both / least))


def merged(a: str, b: str) -> Column:
    """Hashes of the sketch of two documents together, from their sketches."""
    both = F.sort_array(F.array_union(f"{a}.h", f"{b}.h"))
    return F.filter(F.filter(both, lambda x: x <= F.least(bound(a), bound(b))), lambda x, i: (x < BOUND) | (i < FLOOR))


def neighbours(ids: DataFrame) -> DataFrame:
    """``k, before``: per distinct id the struct ``k, n_chars`` of the one before it in ascending order (of the first:
    the last), from rows ``k, n_chars``; of equal ids the longest counts.

    The ids are range-partitioned and written once; a window runs per shard, and one row per shard carries its end over.
    """
    spark = ids.sparkSession
    distinct = ids.groupBy("k").agg(F.max("n_chars").alias("n_chars"))
    placed = settle(
        distinct.repartitionByRange(shards(spark, ids), "k").withColumn("shard", F.spark_partition_id()), "ordered-ids")
    edges = placed.groupBy("shard").agg(F.min("k").alias("k"), F.max(F.struct("k", "n_chars")).alias("last"))
    across = Window.orderBy("shard")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select("k", F.coalesce(F.lag("last").over(across), F.last("last").over(whole)).alias("carried"))
    inside = Window.partitionBy("shard").orderBy("k")
    return placed.select("k", F.lag(F.struct("k", "n_chars")).over(inside).alias("own")).join(carried, "k", "left").select(
        "k", F.coalesce("own", "carried").alias("before"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    The edited text has the last fourth of its characters replaced by as many first ones (or all) of the next document in
    ascending ``doc_id``, of the last by the first's; ``near_edited`` and ``near_next`` are containments. A null text is
    the empty text; a null id stands before all others; of several rows with one id each has its own result, and the one
    whose beginning is least is the next document of the id before. A lone document follows itself.

    Texts are exchanged once, by id; each sends its beginning and sketch to the document before it.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(_MIN)).alias("k"), "text")
    order = neighbours(rows.select("k", F.length("text").alias("n_chars")))
    sketched = with_sketch(rows, "text", "own")
    heads = sketched.join(order, "k").select(
        F.col("before.k").alias("k"),
        F.struct(F.substring(F.col("text"), F.lit(1), F.floor(F.col("before.n_chars") / 4).cast("int")).alias("head"),
                 F.col("own").alias("sketch")).alias("next"))
    heads = heads.groupBy("k").agg(F.min("next").alias("next"))
    met = sketched.join(heads, "k").select("k", "text", "own", "next", F.length("text").alias("n_chars"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - quarter),
                      F.substring(F.col("next.head"), F.lit(1), quarter))
    met = met.select("k", "n_chars", "own", F.col("next.sketch").alias("after"), edited.alias("edited"))
    met = with_sketch(met, "edited", "new")
    return met.select(
        F.nullif(F.col("k"), F.lit(_MIN)).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"),
        fingerprint("new").alias("edited_fingerprint"), containment("own", "new").alias("near_edited"),
        containment("own", "after").alias("near_next"))
