"""Which texts hold which strings, and which texts match which patterns, for any number of either.

Strings are looked up through an inverted index of their grams: each string is filed under the gram of it
that fewest texts hold, each text is sent to the grams it holds that some string is filed under, and what meets is tested.
A pattern is filed under the literals its matches must hold. Nothing is collected and the plan does not grow with
either table. An index of few strings is sent to the texts, which then never leave their tasks; a larger one meets their grams at an
exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.literals import required_literals
from ..functions.rx import ascii_bounds

GRAM = 3
#: Patterns without a literal that are tried together.
BLOCK = 100
#: Strings or patterns up to which their index is broadcast.
SENT = 20_000


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _needle_grams(needle: Column) -> Column:
    """Grams a string may be filed under: of ``GRAM`` characters, or the whole of a shorter one."""
    return F.when(F.length(needle) < GRAM, F.array(needle)).otherwise(_grams(needle, GRAM))


def few(df: DataFrame) -> bool:
    """Whether ``df`` is short enough to be sent to every task."""
    return df.limit(SENT + 1).count() <= SENT


def containing(rows: DataFrame, text: Column, needles: DataFrame) -> DataFrame:
    """Columns of ``rows`` and ``needle``, for each string of needles(needle) that ``text`` holds.

    Null and empty strings are in no text. Rows may repeat; strings count once.
    """
    wanted = needles.select("needle").where(F.col("needle").isNotNull() & (F.col("needle") != "")).distinct()
    # the exchange would carry a text once for each of its grams
    sent = F.broadcast if few(wanted) else (lambda df: df)
    filed = wanted.select("needle", F.explode(_needle_grams(F.col("needle"))).alias("_gram"))
    held = rows.withColumn("_text", text)
    none = F.array().cast("array<string>")
    # grams below full size are made only if some string is that short
    short = [F.when(wanted.select(F.bool_or(F.length("needle") == size)).scalar(), _grams(F.col("_text"), size)).otherwise(none)
             for size in range(1, GRAM)]
    grams = held.withColumn("_gram", F.explode(F.concat(_grams(F.col("_text"), GRAM), *short)))
    known = grams.select("_gram").join(sent(filed.select("_gram").distinct()), "_gram", "left_semi")
    spread = known.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    rarest = filed.join(spread, "_gram", "left").groupBy("needle").agg(
        F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"))
    return grams.join(sent(rarest), "_gram").where(F.contains("_text", F.col("needle"))).select(*rows.columns, "needle")


def _compiled(patterns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in patterns:
        yield pd.DataFrame({"regex": [None if p is None else ascii_bounds(p) for p in part],
                            "literals": [[] if p is None else required_literals(p) for p in part]})


def compiled(rules: DataFrame) -> DataFrame:
    """rules(pattern, ignore_case, ...) with ``regex`` for the JVM and the ``literals`` it requires; patterns the JVM
    refuses are left out, the others still run."""
    compile_ = F.pandas_udf(_compiled, "struct<regex:string,literals:array<string>>")
    parts = rules.withColumn("_c", compile_(F.col("pattern")))
    regex = F.concat(F.when(F.col("ignore_case"), "(?i)").otherwise(""), F.col("_c.regex"))
    out = parts.withColumns({"regex": regex, "literals": F.col("_c.literals")}).drop("_c")
    accepted = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), F.col("regex"), F.lit(""))
    return out.where(accepted.isNotNull())


def matching(rows: DataFrame, text: Column, rules: DataFrame, keep: Column | None = None) -> DataFrame:
    """Columns of ``rows`` and of rules(rule_id, pattern, ignore_case, ...), for each rule whose pattern ``text`` matches.

    ``keep`` is a further condition over the columns of both. Rule ids are distinct; the other columns of both sides must not clash.
    """
    keep = F.lit(True) if keep is None else keep
    book, short = compiled(rules), few(rules)
    sent_rules = F.broadcast if short else (lambda df: df)
    mine = [c for c in book.columns if c not in ("regex", "literals", "pattern", "ignore_case")]
    test = F.rlike("_t", F.col("regex")) & keep
    rows = rows.withColumns({"_t": text, "_row": F.struct(*rows.columns)})
    cols = [c for c in rows.columns if c not in ("_t", "_row")]

    # by literal: a text that holds several literals of one rule meets it once
    literal = book.select("rule_id", F.explode("literals").alias("needle"))
    lowered = rows.select("_t", "_row", F.lower("_t").alias("_low"))
    found = containing(lowered, F.col("_low"), literal.select("needle")).join(sent_rules(literal), "needle")
    met = found.join(sent_rules(book), "rule_id").select("_t", "_row", "needle", *mine, "regex", "literals")
    # of the literals the text holds, the first in the rule's list counts
    first = F.get(F.filter("literals", lambda w: F.contains(F.lower("_t"), w)), F.lit(0))
    by_literal = met.where(F.col("needle") == first).select("_t", *[F.col(f"_row.{c}").alias(c) for c in cols], *mine, "regex").where(test)

    # without: blocks of patterns, each row sent to every block; copies of a block keep any one task from taking all rows
    bare = book.where(F.size("literals") == 0)
    blocks = F.coalesce(bare.select(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")).scalar(), F.lit(0))
    salts = 1 if short else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = bare.withColumn("_block", F.pmod(F.xxhash64("rule_id"), blocks)).groupBy("_block").agg(
        F.collect_list(F.struct(*mine, "regex")).alias("_rules"))
    grouped = grouped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = rows.where(blocks > 0).withColumns({
        "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks, F.lit(1)).cast("long") - 1)),
        "_salt": F.pmod(F.xxhash64("_t"), F.lit(salts)).cast("int")})
    tried = sent.join(sent_rules(grouped), ["_block", "_salt"]).select(
        "_t", *cols, F.explode(F.filter("_rules", lambda r: F.rlike(F.col("_t"), r["regex"]))).alias("_r"))
    by_trial = tried.select("_t", *cols, "_r.*").where(keep)
    return by_literal.select(*cols, *mine).unionByName(by_trial.select(*cols, *mine))
