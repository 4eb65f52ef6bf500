"""Knowledge entries: relevance scoring, ranked queries, practices, tips, statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import rank_of
from ..rules import knowledge as K
from .contain import containing
from .history import first_rows
from .ranked import best_items, counted

#: Query texts that become expressions; more are looked up through the index.
INLINE_QUERIES = 20


def _has(low: Column, needle: str) -> Column:
    return F.contains(low, F.lit(needle))


def _lowered(kb: DataFrame) -> DataFrame:
    """Adds the lower-case fields once; every query of a scan reads these."""
    return kb.withColumns({
        **{f"_{c}": F.lower(c) for c in ("topic", "library", "content")},
        **{f"_{c}": F.transform(c, lambda x: F.lower(x)) for c in ("relevance", "tags")}})


def _array_points(values: Column, query: str, words: Sequence[str], full: int, each: int) -> Column:
    """Per element: ``full`` when it holds the whole query, else ``each`` per contained word."""

    def element(v: Column) -> Column:
        part = F.lit(0)
        for w in words:
            part = part + F.when(_has(v, w), each).otherwise(0)
        return F.when(_has(v, query), full).otherwise(part)

    return F.aggregate(F.transform(values, element), F.lit(0), lambda a, b: a + b)


def relevance_parts(query: str, now: Column) -> tuple[Column, Column]:
    """(content score, recency score) of one query text against a knowledge row.

    Field weights 10/5 topic, 8/4 library, 6/3 relevance, 5/2 tags, 3 content plus one half per
    occurrence up to 5 per word; recency 2 below 30 days, one half below 90.
    """
    text = query.lower()
    words = [w for w in text.split() if len(w) > 2]
    zero = F.lit(0.0)
    if not words:
        return zero, zero
    score = zero
    for field, full, each in (("topic", 10, 5), ("library", 8, 4)):
        score = score + F.when(_has(F.col(f"_{field}"), text), full).otherwise(0)
        for w in words:
            score = score + F.when(_has(F.col(f"_{field}"), w), each).otherwise(0)
    score = score + _array_points(F.col("_relevance"), text, words, 6, 3)
    score = score + _array_points(F.col("_tags"), text, words, 5, 2)
    low = F.col("_content")
    score = score + F.when(_has(low, text), 3).otherwise(0)
    for w in words:
        hits = (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / F.lit(len(w))
        score = score + F.least(hits * 0.5, F.lit(5.0))
    return score, _freshness(now)


def _freshness(now: Column) -> Column:
    days = (F.unix_micros(now) - F.unix_micros("ts")) / F.lit(86_400_000_000.0)
    return F.when(days < 30, 2.0).when(days < 90, 0.5).otherwise(0.0)


def _postings(kb: DataFrame, queries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """items(item, bias, feature, value) and asked(query, size, feature, weight) of ``ranked.best_items``.

    An entry's content score of a query is the sum of weight times value over their features. A string w has up to three: what
    it gives as a word (``w``), what it gives as a whole query (``q``), and, in elements that hold the whole query and so each of
    its words, what these must not add (``e``). Strings are found through the gram index of ``contain``; short fields are
    searched once per distinct value.
    """
    asked = queries.select("query").where(F.col("query").isNotNull()).distinct().withColumn("_low", F.lower("query"))
    words = F.filter(F.split("_low", r"\s+"), lambda w: F.length(w) > 2)
    asked = asked.withColumn("_w", words).where(F.size("_w") > 0)

    def feature(kind: str, needle: Column, weight: Column) -> Column:
        return F.struct(F.concat(F.lit(kind), needle).alias("feature"), weight.cast("double").alias("weight"), needle.alias("needle"))

    needles = asked.select("query", F.size("_w").cast("double").alias("size"), F.explode(F.concat(
        F.array(feature("q", F.col("_low"), F.lit(1)), feature("e", F.col("_low"), -F.size("_w"))),
        F.transform("_w", lambda w: feature("w", w, F.lit(1))))).alias("_n")).select("query", "size", "_n.*")
    wanted = needles.groupBy("query", "size", "feature").agg(F.sum("weight").alias("weight"))
    sought = needles.select("needle").distinct()

    def listed(field: str) -> Column:
        return F.transform(F.coalesce(field, F.array()), lambda v: F.struct(F.lit(field).alias("field"), F.lower(v).alias("value")))

    own = kb.where(F.col("id").isNotNull()).withColumn("_fresh", _freshness(now))
    fields = own.select("id", "_fresh", F.explode(F.concat(
        *[F.array(F.struct(F.lit(f).alias("field"), F.lower(f).alias("value"))) for f in ("topic", "library")],
        listed("relevance"), listed("tags"))).alias("_f")).select("id", "_fresh", "_f.*").where("value is not null")
    whole, each = (F.create_map(*[F.lit(x) for f, p in weights.items() for x in (f, p)])[F.col("field")].cast("double") for weights in (
        {"topic": 10, "library": 8, "relevance": 6, "tags": 5}, {"topic": 5, "library": 4, "relevance": 3, "tags": 2}))
    found = containing(fields.select("field", "value").distinct(), F.col("value"), sought)
    by_field = fields.join(found, ["field", "value"]).select(
        "id", "_fresh", "needle", each.alias("w"), whole.alias("q"), F.when(F.col("field").isin("relevance", "tags"), each).otherwise(0.0).alias("e"))

    # texts are long: what is counted in them leaves at once
    hits = (F.octet_length("_c") - F.octet_length(F.replace(F.col("_c"), F.col("needle"), F.lit("")))) / F.octet_length("needle")
    by_content = containing(own.select("id", "_fresh", F.lower("content").alias("_c")), F.col("_c"), sought).select(
        "id", "_fresh", "needle", F.least(hits * 0.5, F.lit(5.0)).alias("w"), F.lit(3.0).alias("q"), F.lit(0.0).alias("e"))
    kinds = ("w", "q", "e")
    held = by_field.unionByName(by_content).groupBy("id", "needle").agg(F.max("_fresh").alias("bias"), *(F.sum(c).alias(c) for c in kinds))
    points = F.filter(F.array(*(F.struct(F.concat(F.lit(c), "needle").alias("feature"), F.col(c).alias("value")) for c in kinds)), lambda p: p["value"] != 0)
    return held.select(F.col("id").alias("item"), "bias", F.explode(points).alias("_p")).select("item", "bias", "_p.*"), wanted


def relevance_by_table(kb: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """As ``relevance``, for a table queries(query) of any size; ``id`` identifies an entry. Every matching pair is a row;
    the best of each query come cheaper from ``query_knowledge``."""
    items, asked = _postings(kb, queries, now)
    summed = items.join(asked, "feature").groupBy("item", "query").agg(F.sum(F.col("weight") * F.col("value")).alias("_base"))
    scored = kb.join(summed.withColumnRenamed("item", "id"), "id").withColumn("score", F.col("_base") + _freshness(now))
    return scored.where((F.col("_base") > 0) & (F.col("score") >= K.MIN_SCORE)).select("query", "score", *kb.columns)


def _scores(base: np.ndarray, fresh: np.ndarray, size: float) -> np.ndarray:
    score = base + fresh
    return np.where((base > 0) & (score >= K.MIN_SCORE), score, -np.inf)


def _best(kb: DataFrame, queries: Sequence[str] | DataFrame, now: Column, k: int) -> DataFrame:
    """The best ``k`` rows of ``relevance`` per query. Those of a table never become pairs."""
    if not isinstance(queries, DataFrame):
        if len(queries) <= INLINE_QUERIES:
            return first_rows(relevance(kb, queries, now), ["query"], [F.col("score").desc(), F.col("id")], k)
        queries = kb.sparkSession.createDataFrame([(x,) for x in queries], "query string")
    best = best_items(*_postings(kb, queries, now), k, _scores, counted(kb)).withColumnRenamed("item", "id")
    return kb.join(best, "id").select("query", "score", *kb.columns)


def relevance(kb: DataFrame, queries: Sequence[str] | DataFrame, now: Column, compat: bool = False) -> DataFrame:
    """(query, score, entry columns) of every entry matching a query.

    A few query texts are scored in one scan; a table, or more texts than ``INLINE_QUERIES``, through an index. A match
    needs the minimum score and something besides recency; ``compat`` lets recency alone match, which pairs every recent
    entry with every query and so is for a few texts only.
    """
    if isinstance(queries, DataFrame):
        if compat:
            raise ValueError("compat takes a list of query texts")
        return relevance_by_table(kb, queries, now)
    if len(queries) > INLINE_QUERIES and not compat:
        return relevance_by_table(kb, kb.sparkSession.createDataFrame([(x,) for x in queries], "query string"), now)
    rows = _lowered(kb)
    parts = [relevance_parts(text, now) for text in queries]
    # content scores are computed once per query before they are tested
    rows = rows.withColumns({f"_s{i}": base for i, (base, _) in enumerate(parts)})
    scored = []
    for i, text in enumerate(queries):
        base, fresh = F.col(f"_s{i}"), parts[i][1]
        ok = (base + fresh >= K.MIN_SCORE) & (F.lit(compat) | (base > 0))
        scored.append(F.when(ok, F.struct(F.lit(text).alias("query"), (base + fresh).alias("score"))))
    hits = F.filter(F.array(*scored), lambda s: s.isNotNull())
    return rows.withColumn("_q", F.explode(hits)).select("_q.query", "_q.score", *kb.columns)


def query_knowledge(kb: DataFrame, queries: Sequence[str] | DataFrame, now: Column, k: int = K.MAX_RESULTS) -> DataFrame:
    """Best ``k`` entries per query."""
    return _best(kb, queries, now, k)


def knowledge_rows(rows: DataFrame, source: str) -> DataFrame:
    """Knowledge rows for insertion from rows(ts, topic, library, content, url, tags).

    The id is derived from the content, so a retried insert adds nothing new; the relevance terms
    are the lower-case topic words and the library. Rows without content are refused.
    """
    if source not in ("context7", "web", "manual"):
        raise ValueError(f"unknown source {source}")
    identity = F.concat_ws("|", F.lit(source), "library", "topic", "content")
    words = F.filter(F.split(F.lower("topic"), r"\s+"), lambda w: F.length(w) > 2)
    return rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(
        F.concat(F.lit("know-"), F.left(F.sha2(identity, 256), F.lit(16))).alias("id"), "ts", "topic", "library", F.lit(source).alias("source"),
        "content", "url", F.array_distinct(F.concat(words, F.array(F.lower("library")))).alias("relevance"), "tags")


def practices(kb: DataFrame, rules: Sequence[tuple] = K.PRACTICES) -> DataFrame:
    return kb.sparkSession.createDataFrame(list(rules), "task string, framework string, priority string, title string")


def suggest_practices(kb: DataFrame, requests: Sequence[tuple[str, str]] | DataFrame, now: Column) -> DataFrame:
    """Practices per (task, framework) request: rule rows for the framework or ``*``, then
    recommending entries among the best matches; ``rank`` orders by priority. Requests may be a table(task, framework)."""
    texts = None
    if not isinstance(requests, DataFrame):
        # few texts are scored in one scan
        texts = sorted({f"{task.lower()} {framework}" for task, framework in requests})
        requests = kb.sparkSession.createDataFrame(list(requests), "task string, framework string")
    wanted = requests.select("task", "framework").distinct().select(
        F.lower("task").alias("task"), "framework", F.concat_ws(" ", F.lower("task"), "framework").alias("query")).distinct()
    table = practices(kb)
    ruled = (
        wanted.join(table.withColumnRenamed("framework", "_fw"), "task")
        .where((F.col("_fw") == F.col("framework")) | (F.col("_fw") == "*"))
        .select("task", "framework", "title", F.lit("rules").alias("source"), "priority"))
    said = F.lower("content")
    telling = F.lit(False)
    for w in K.ADVICE_WORDS:
        telling = telling | said.contains(w)
    found = (
        query_knowledge(kb, wanted.select("query") if texts is None else texts, now).where(telling)
        .join(wanted, "query")
        .select("task", "framework", F.concat_ws(": ", "library", "topic").alias("title"),
                F.concat_ws(" — ", "source", "library").alias("source"), F.lit("medium").alias("priority")))
    return ruled.unionByName(found).withColumn("rank", rank_of(K.PRIORITIES, F.col("priority")))


def tip_scores(text: Column) -> Column:
    """Array of struct(score, rank, category, tip) per tip; keyword 2 points, each long part 1."""
    low = F.lower(text)
    out = []
    for i, (category, keywords, tip) in enumerate(K.TIPS):
        score = F.lit(0)
        for kw in keywords:
            score = score + F.when(low.contains(kw), 2).otherwise(0)
            for part in kw.split():
                if len(part) > 2:
                    score = score + F.when(low.contains(part), 1).otherwise(0)
        out.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(category).alias("category"), F.lit(tip).alias("tip")))
    return F.array(*out)


def context_tips(contexts: DataFrame, text: str = "content") -> DataFrame:
    """Best tip per context; the earlier tip wins a tie, null when none applies."""
    best = F.array_max(tip_scores(F.col(text)))
    return contexts.withColumn("_b", best).withColumns({
        "category": F.when(F.col("_b.score") > 0, F.col("_b.category")),
        "tip": F.when(F.col("_b.score") > 0, F.col("_b.tip")),
        "tip_score": F.col("_b.score"),
    }).drop("_b")


def first_sentence(content: Column) -> Column:
    return F.trim(F.get(F.filter(F.split(content, r"[.!?\n]"), lambda s: s != ""), F.lit(0)))


def knowledge_sentences(kb: DataFrame, queries: Sequence[str] | DataFrame, now: Column) -> DataFrame:
    """Fallback per query without a tip: the first sentence (under 200 characters) of the best of
    its three top entries."""
    top = _best(kb, queries, now, 3)
    usable = top.withColumn("sentence", first_sentence(F.col("content"))).where(F.length("sentence") < 200)
    return first_rows(usable, ["query"], [F.col("score").desc(), F.col("id")]).select("query", "library", "sentence")


def knowledge_stats(kb: DataFrame, k: int = 10) -> DataFrame:
    """Entries by library, by source (all sources kept) and the ``k`` most frequent topics."""
    named = kb.select(
        F.coalesce(F.nullif("library", F.lit("")), F.lit("unknown")).alias("library"), "source",
        F.coalesce(F.nullif("topic", F.lit("")), F.lit("untagged")).alias("topic"))
    lib = named.groupBy("library").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("library").alias("dim"), F.col("library").alias("key"), "n")
    src = named.agg(*[F.count_if(F.col("source") == s).alias(s) for s in ("context7", "web", "manual")]).unpivot(
        [], ["context7", "web", "manual"], "key", "n").select(F.lit("source").alias("dim"), "key", "n")
    top = named.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "topic").limit(k).select(
        F.lit("topic").alias("dim"), F.col("topic").alias("key"), "n")
    return lib.unionByName(src).unionByName(top)
