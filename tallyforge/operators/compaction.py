"""Context compaction: per-type shortening, savings, original store statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import lookup
from ..functions.hashing import content_hash
from ..functions.maths import half_up
from ..functions.text import code_language, compact_code, compact_prose, content_type
from ..rules import words

# List size from which a schema pays, items kept, clipped text length.
LONG_LIST = 5
ITEMS_KEPT = 30
CLIP = 200


def _quoted(s: Column) -> Column:
    """JSON string literal of a text."""
    j = F.to_json(F.array(s))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _joined(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever loop the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _crushed(rows: Column, keys: Column) -> Column:
    """Key schema, count and first items of a list."""
    schema = _joined(F.transform(keys, lambda k, i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":'), _quoted(k))))

    def cell(m: Column, k: Column) -> Column:
        name = _bound(F.array_position(keys, k), lambda at: F.when(
            at > 0, F.concat(F.lit('"k'), (at - 1).cast("string"), F.lit('"'))).otherwise(_quoted(k)))
        return F.concat(name, F.lit(":"), F.to_json(m[k]))

    def short_item(v: Column) -> Column:
        return _bound(_fields(v), lambda m: F.when(m.isNull(), F.to_json(v)).otherwise(
            _joined(F.transform(F.array_sort(F.map_keys(m)), lambda k: cell(m, k)))))

    n = F.size(rows)
    items = F.array_join(F.transform(F.slice(rows, 1, ITEMS_KEPT), short_item), ",")
    cut = F.when(n > ITEMS_KEPT, F.concat(F.lit(',"_truncated":'), (n - ITEMS_KEPT).cast("string"))).otherwise("")
    return F.concat(F.lit('{"_schema":'), schema, F.lit(',"_count":'), n.cast("string"), F.lit(',"_items":['), items, F.lit("]"), cut, F.lit("}"))


def _shortened(obj: Column) -> Column:
    """An object without empty values, its keys short and its long texts clipped."""
    def cell(k: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        said = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        clipped = lambda s: F.concat(F.left(s, F.lit(CLIP)), F.lit("…[+"), (F.length(s) - CLIP).cast("string"), F.lit("ch]"))
        value = _bound(said, lambda s: F.when(s == "", F.lit(None)).when(F.length(s) > CLIP, _quoted(clipped(s))).otherwise(F.to_json(v)))
        return F.when(kind != "VOID", F.concat(_quoted(F.coalesce(lookup(words.SHORT_KEYS, k), k)), F.lit(":"), value))

    cells = F.transform(F.array_sort(F.map_keys(obj)), lambda k: _bound(obj[k], lambda v: cell(k, v)))
    return _joined(F.filter(cells, lambda c: c.isNotNull()))


def compact_json(content: Column) -> Column:
    """Shorter JSON: long lists as key schema plus the first items, objects with short keys, empty
    values dropped and long texts clipped. Keys come out in sorted order. A text is parsed once."""
    def of_list(doc: Column, rows: Column) -> Column:
        first = _fields(F.get(rows, F.lit(0)))
        return _bound(F.array_sort(F.map_keys(first)), lambda keys: F.when(
            (F.size(rows) > LONG_LIST) & keys.isNotNull(), _crushed(rows, keys)).otherwise(F.to_json(doc)))

    def of(doc: Column) -> Column:
        kind = F.schema_of_variant(doc)
        return (
            F.when(kind.startswith("ARRAY"), _bound(F.try_variant_get(doc, "$", "array<variant>"), lambda rows: of_list(doc, rows)))
            .when(kind.startswith("OBJECT"), _bound(_fields(doc), _shortened)).otherwise(F.to_json(doc)))

    return _bound(F.try_parse_json(content), of)


def compact(df: DataFrame) -> DataFrame:
    """Adds content_type, compacted text, byte sizes, saved ratio and hash to (id, path, content)."""
    c, kind = F.col("content"), F.col("content_type")
    typed = df.withColumn("content_type", content_type(c, F.col("path")))
    short = (
        F.when(kind == "json", compact_json(c)).when(kind == "code", compact_code(c, code_language(F.col("path"))))
        .otherwise(compact_prose(c)))
    sized = typed.withColumn("compacted", short).withColumns({
        "original_size": F.octet_length("content"), "compacted_size": F.octet_length("compacted"), "hash": content_hash(c, 12)})
    ratio = F.when(F.col("original_size") > 0, F.lit(1.0) - F.col("compacted_size") / F.col("original_size")).otherwise(0.0)
    return sized.withColumn("ratio", ratio)


def store_stats(store: DataFrame) -> DataFrame:
    """Entries, bytes and mean saving per content type plus a ``(total)`` row."""
    return (
        store.rollup("content_type")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"),
             half_up(F.avg("ratio"), 2).alias("average_ratio"), F.grouping("content_type").alias("_g"))
        .select(F.when(F.col("_g") == 1, "(total)").otherwise(F.col("content_type")).alias("content_type"), "entries", "bytes", "average_ratio"))
