"""Diffs of schemas and API contracts, and migration statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import lookup, present
from .codestats import key_changes

_ATTRS = ("type", "required", "is_unique", "default_value", "rel_entity", "rel_type")

# Column types per schema type; JSON differs by dialect.
SQL_TYPES = {
    "string": "VARCHAR(255)", "integer": "INTEGER", "float": "FLOAT", "boolean": "BOOLEAN", "datetime": "TIMESTAMP",
    "bigint": "BIGINT", "decimal": "DECIMAL(10,2)", "bytes": "BYTEA",
}
JSON_TYPES = {"postgres": "JSONB", "mysql": "JSON", "sqlite": "TEXT"}
RAW_DEFAULTS = r"^now\(\)|^gen_random_uuid\(\)|^autoincrement\(\)$"

# Change types that do not break clients.
SAFE_CHANGES = ("endpoint-added",)


def _paired(before: DataFrame, after: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
    """(entity, field, b, a, had, has, first): both states of a field, whether its entity existed on each side, and
    whether the row is the entity's first. Each side is read once; fields are paired by mergeable aggregates, and only
    the pairs of an entity meet."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("entity", "field", F.lit(name).alias("_side"), F.struct(*attrs).alias("_v"))

    both = side(before, "b").unionByName(side(after, "a")).groupBy("entity", "field").agg(
        *[F.max(F.when(F.col("_side") == s, F.col("_v"))).alias(s) for s in ("b", "a")])
    mates = W.partitionBy("entity")
    return both.withColumns({
        "had": F.bool_or(F.col("b").isNotNull()).over(mates), "has": F.bool_or(F.col("a").isNotNull()).over(mates),
        "first": F.row_number().over(mates.orderBy("field")) == 1})


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity, field, change, before, after) of two schema_fields tables.

    Added and removed entities give one row without field; fields of kept entities one row per
    kind of change.
    """
    b, a = F.col("b"), F.col("a")

    def opt(side: Column) -> Column:
        return F.concat(side["type"], F.when(side["required"], "").otherwise("?"))

    def rel(side: Column) -> Column:
        return F.when(side["rel_entity"].isNull(), "(none)").otherwise(F.concat(side["rel_type"], F.lit(" -> "), side["rel_entity"]))

    def row(cond: Column, change: Column | str, before_v: Column, after_v: Column, field: Column | None = None) -> Column:
        change = F.lit(change) if isinstance(change, str) else change
        field = F.col("field") if field is None else field
        return F.when(cond, F.struct(field.alias("field"), change.alias("change"), before_v.alias("before"), after_v.alias("after")))

    none = F.lit(None).cast("string")
    stays = F.col("had") & F.col("has")
    kept = b.isNotNull() & a.isNotNull()
    rows = present([
        row(~stays & F.col("first"), F.when(F.col("had"), "entity removed").otherwise("entity added"), none, none, none),
        row(stays & b.isNull(), "added", none, opt(a)),
        row(stays & a.isNull(), "removed", opt(b), none),
        row(kept & (b["type"] != a["type"]), "type changed", b["type"], a["type"]),
        row(kept & (b["required"] != a["required"]), F.when(a["required"], "changed to required").otherwise("changed to optional"),
            F.when(b["required"], "required").otherwise("optional"), F.when(a["required"], "required").otherwise("optional")),
        row(kept & (b["is_unique"] != a["is_unique"]), F.when(a["is_unique"], "unique constraint added").otherwise("unique constraint removed"),
            F.when(b["is_unique"], "unique").otherwise("not unique"), F.when(a["is_unique"], "unique").otherwise("not unique")),
        row(kept & ~b["default_value"].eqNullSafe(a["default_value"]), "default changed",
            F.coalesce(b["default_value"], F.lit("(none)")), F.coalesce(a["default_value"], F.lit("(none)"))),
        row(kept & (rel(b) != rel(a)), "relation changed", rel(b), rel(a)),
    ])
    return _paired(before, after, _ATTRS).select("entity", F.explode(rows).alias("_r")).select("entity", "_r.*")


def schema_evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """(field, type, change) for name/type models: added, removed, modified; whole models as
    ``X (model)``."""
    b, a = F.col("b.type"), F.col("a.type")
    stays = F.col("had") & F.col("has")
    model = F.struct(F.concat("entity", F.lit(" (model)")).alias("field"), F.lit("model").alias("type"),
                     F.when(F.col("had"), "removed").otherwise("added").alias("change"))
    field = F.struct(
        F.concat_ws(".", "entity", "field").alias("field"),
        F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.concat(b, F.lit(" -> "), a)).alias("type"),
        F.when(b.isNull(), "added").when(a.isNull(), "removed").otherwise("modified").alias("change"))
    change = F.when(~stays & F.col("first"), model).when(stays & ~b.eqNullSafe(a), field)
    return _paired(before, after, ("type",)).select(change.alias("_r")).where("_r is not null").select("_r.*")


def _quote(name: Column, dialect: str) -> Column:
    mark = F.lit("`" if dialect == "mysql" else '"')
    return F.concat(mark, name, mark)


def sql_type(t: Column, dialect: str) -> Column:
    base = F.regexp_replace(F.regexp_replace(t, r"\?$", ""), r"<.*>$", "")
    table = {**SQL_TYPES, "json": JSON_TYPES[dialect]}
    return (
        F.when(lookup(table, F.lower(base)).isNotNull(), lookup(table, F.lower(base)))
        .when(base.rlike("^[A-Z]"), "INTEGER").otherwise(F.upper(base)))


def migration_ddl(diff: DataFrame, fields: DataFrame, dialect: str) -> DataFrame:
    """(entity, field, change, statement) for a diff; ``fields`` is the after table with ``pos``.

    New entities become one CREATE TABLE with their columns in order.
    """
    if dialect not in JSON_TYPES:
        raise ValueError(f"unknown dialect {dialect}")
    t, f = _quote(F.col("entity"), dialect), _quote(F.col("field"), dialect)
    lite = dialect == "sqlite"

    def words(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    raw = F.col("default_value").rlike(RAW_DEFAULTS)
    default = F.when(F.col("default_value").isNotNull(), F.concat(
        F.lit("DEFAULT "), F.when(raw, F.col("default_value")).otherwise(F.concat(F.lit("'"), "default_value", F.lit("'")))))
    nullable = F.when(F.col("required"), "NOT NULL").otherwise("NULL")
    fk = F.col("rel_entity").isNotNull()
    fk_name = _quote(F.concat("field", F.lit("Id")), dialect)
    col = F.when(fk, F.concat_ws(" ", fk_name, F.lit("INTEGER"), nullable, default)).otherwise(
        F.concat_ws(" ", f, sql_type(F.col("type"), dialect), F.when(F.col("is_unique"), "UNIQUE"), nullable, default))
    ref = F.when(fk, words("FOREIGN KEY (", fk_name, ") REFERENCES ", _quote(F.col("rel_entity"), dialect), "(id)"))
    added = diff.where(F.col("change") == "entity added").select("entity")
    create = (
        fields.join(added, "entity", "left_semi")
        .groupBy("entity")
        .agg(F.array_sort(F.collect_list(F.struct("pos", col.alias("c")))).alias("_c"),
             F.array_sort(F.collect_list(F.when(fk, F.struct("pos", ref.alias("c"))))).alias("_r"))
        .select("entity", F.lit(None).cast("string").alias("field"), F.lit("entity added").alias("change"),
                words("CREATE TABLE ", t, " (\n", F.array_join(F.transform(F.concat("_c", "_r"), lambda x: F.concat(F.lit("  "), x["c"])), ",\n"),
                      "\n);").alias("statement")))
    change = F.col("change")
    uq = _quote(F.concat(F.lit("uq_"), "entity", F.lit("_"), "field"), dialect)
    new_type = sql_type(F.col("after"), dialect)
    rebuild = lambda why: words("-- SQLite: ALTER TABLE ", t, " requires full table rebuild ", why)
    typed = (
        rebuild(words("for type change on ", F.col("field"))) if lite
        else words("ALTER TABLE ", t, " MODIFY COLUMN ", f, " ", new_type, ";") if dialect == "mysql"
        else words("ALTER TABLE ", t, " ALTER COLUMN ", f, " TYPE ", new_type, ";"))
    not_null = rebuild(words("to set ", F.col("field"), " NOT NULL")) if lite else words("ALTER TABLE ", t, " ALTER COLUMN ", f, " SET NOT NULL;")
    optional = rebuild(words("to drop NOT NULL on ", F.col("field"))) if lite else words(
        "ALTER TABLE ", t, " ALTER COLUMN ", f, " DROP NOT NULL;")
    drop = (words("-- SQLite does not support DROP COLUMN directly; recreate table to remove ", F.col("field")) if lite
            else words("ALTER TABLE ", t, " DROP COLUMN ", f, ";"))
    statement = (
        F.when(change == "entity removed", words("DROP TABLE IF EXISTS ", t, ";"))
        .when(change == "added", words("ALTER TABLE ", t, " ADD COLUMN ", f, " ", new_type, ";"))
        .when(change == "removed", drop).when(change == "type changed", typed)
        .when(change == "changed to required", not_null).when(change == "changed to optional", optional)
        .when(change == "unique constraint added", words("CREATE UNIQUE INDEX ", uq, " ON ", t, " (", f, ");"))
        .when(change == "unique constraint removed", words("DROP INDEX IF EXISTS ", uq, ";"))
        .otherwise(words("-- ", change, ": ", F.col("field"), " ", F.coalesce("before", F.lit("")), " => ", F.coalesce("after", F.lit("")))))
    rest = diff.where(change != "entity added").select("entity", "field", "change", statement.alias("statement"))
    return create.unionByName(rest)


# --- API contracts -------------------------------------------------------------------


def api_diff(operations: DataFrame, before: str, after: str) -> DataFrame:
    """(type, path, method, detail, breaking) between two versions of operations(version, path, method, params, responses).

    Removed and added endpoints, removed or newly required parameters, removed or changed
    responses of endpoints present on both sides. An empty side makes everything added or removed. One aggregate gathers
    both versions of an operation in a row; all changes are read off that row.
    """
    old, new = F.col("version") == before, F.col("version") == after

    def gathered(side: Column, col: str, name: str) -> Column:
        return F.flatten(F.collect_list(F.when(side, F.col(col)))).alias(name)

    pair = operations.where(old | new).groupBy("path", "method").agg(
        F.bool_or(old).alias("had"), F.bool_or(new).alias("has"), gathered(old, "params", "pb"), gathered(new, "params", "pa"),
        gathered(old, "responses", "rb"), gathered(new, "responses", "ra"))

    def change(kind: Column | str, detail: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), detail.alias("detail"))

    word = F.when(F.col("has"), "added").otherwise("removed")
    ends = F.array(change(F.concat(F.lit("endpoint-"), word), F.concat(
        F.lit("Endpoint "), F.upper("method"), F.lit(" "), "path", F.lit(" was "), word)))

    def named(params: str, key: Column) -> Column:
        return F.get(F.filter(params, lambda p: (p["name"] == key["name"]) & (p["location"] == key["location"])), F.lit(0))["required"]

    def both_params(key: Column) -> Column:
        return F.struct(key["name"].alias("name"), key["location"].alias("location"), named("pb", key).alias("b"), named("pa", key).alias("a"))

    def param(p: Column) -> Column:
        label = F.concat(F.lit("'"), p["name"], F.lit("' ("), p["location"], F.lit(")"))
        b, a = p["b"], p["a"]
        said = F.when(a.isNull(), F.concat(F.when(b, "Required").otherwise("Optional"), F.lit(" parameter "), label, F.lit(" was removed"))).when(
            b.isNull() & a, F.concat(F.lit("New required parameter "), label, F.lit(" was added")))
        return F.when(said.isNotNull(), change("param-removed", said))

    keys = F.array_distinct(F.transform(F.concat("pb", "pa"), lambda p: F.struct(p["name"].alias("name"), p["location"].alias("location"))))

    def of_code(responses: str, code: Column) -> Column:
        return F.get(F.filter(responses, lambda r: r["code"] == code), F.lit(0))

    def both_responses(code: Column) -> Column:
        return F.struct(code.alias("code"), of_code("rb", code).alias("b"), of_code("ra", code).alias("a"))

    def response(r: Column) -> Column:
        b, a = r["b"], r["a"]
        lost = F.size(F.array_except(F.map_keys(b["props"]), F.map_keys(a["props"]))) > 0
        retyped = F.exists(F.map_entries(b["props"]), lambda e: F.try_element_at(a["props"], e["key"]) != e["value"])
        relaxed = F.size(F.array_except(b["required"], a["required"])) > 0
        differs = (b["type"] != a["type"]) | ~b["ref"].eqNullSafe(a["ref"]) | lost | F.coalesce(retyped, F.lit(False)) | relaxed
        said = F.when(a.isNull(), " was removed").when(differs, " schema changed")
        return F.when(said.isNotNull(), change("response-changed", F.concat(F.lit("Response "), r["code"], said)))

    codes = F.array_distinct(F.transform("rb", lambda r: r["code"]))
    within = F.filter(F.concat(F.transform(F.transform(keys, both_params), param), F.transform(F.transform(codes, both_responses), response)),
                      lambda x: x.isNotNull())
    out = pair.select("path", "method", F.explode(F.when(F.col("had") & F.col("has"), within).otherwise(ends)).alias("_c"))
    return out.select("_c.type", "path", "method", "_c.detail", (~F.col("_c.type").isin(*SAFE_CHANGES)).alias("breaking"))


def api_verdict(diff: DataFrame) -> DataFrame:
    """Number of changes and whether any breaks clients."""
    return diff.agg(F.count(F.lit(1)).alias("changes"), F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("breaking"))


def route_drift(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added (+) and removed (-) route strings between two refs."""
    return key_changes(base, head, ["repo", "route"]).select(
        "repo", F.concat(F.when(F.col("change") == "added", "+ ").otherwise("- "), "route").alias("change"))
