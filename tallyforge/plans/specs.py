"""Coverage, schema, API, config, locale, import, bundle and record queries.

File texts are rendered from the given tables, one per row, then read back by the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config as CF, coverage as CV, i18n as I, imports as IM, scan as S, specdiff as D
from ..sources import config as SC, coverage as SV, locales as SL, reports as SR, specs as SS
from . import bindings as B
from .bindings import define, pick, with_sql
from .registry import query
from .scans import _strings_sql


def s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def lit(x):
    return F.lit(x)


# --- coverage ------------------------------------------------------------------------


def istanbul_files(t):
    """One JSON report per part: its file with 4 statements, 2 functions, 3 branches, 5 lines."""
    pk, z = F.col("p_partkey"), F.col("p_size")

    def bit(k: int):
        return ((pk / k).cast("bigint") % 2).cast("string")

    text = F.concat(
        lit('{"src/p'), s("p_partkey"), lit('.ts":{"s":{"0":'), s(z % 3), lit(',"1":1,"2":'), bit(1), lit(',"3":0},"f":{"0":'), bit(2), lit(',"1":2},"b":{"0":['), bit(3),
        lit(',1],"1":['), s(z % 2), lit(']},"l":{"1":1,"2":'), bit(1), lit(',"3":'), bit(2), lit(',"4":0,"10":'), s(z % 2), lit('}},"broken.ts":{"s":{}}}'))
    return B.dealt(t.part, "p_partkey").select(F.col("p_type").alias("repo"), F.concat(lit("r"), s("p_partkey"), lit("/coverage-final.json")).alias("path"),
                         F.when(pk % 41 == 0, "{nope").otherwise(text).alias("content"))


define("istanbul", """
SELECT p_type AS repo, 'src/p' || p_partkey || '.ts' AS path, 4 AS total_statements, (p_size % 3 > 0)::INT + 1 + (p_partkey % 2)::INT AS covered_statements,
 3 AS total_branches, ((p_partkey // 3) % 2)::INT + 1 + (p_size % 2) AS covered_branches, 2 AS total_functions, ((p_partkey // 2) % 2)::INT + 1 AS covered_functions,
 5 AS total_lines, 1 + (p_partkey % 2)::INT + ((p_partkey // 2) % 2)::INT + p_size % 2 AS covered_lines,
 list_filter([CASE WHEN p_partkey % 2 = 0 THEN 2 END, CASE WHEN (p_partkey // 2) % 2 = 0 THEN 3 END, 4, CASE WHEN p_size % 2 = 0 THEN 10 END], lambda x: x IS NOT NULL) AS missed
FROM part WHERE p_partkey % 41 <> 0""")


@query("istanbul_coverage", with_sql("istanbul", """
SELECT * EXCLUDE (missed), array_to_string(missed, ',') AS missed FROM istanbul"""))
def istanbul_coverage(t):
    return SV.read_istanbul(istanbul_files(t)).drop("tool").withColumn("missed", F.array_join("uncovered_lines", ",")).drop("uncovered_lines")


def lcov_files(t):
    pk, z = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        lit("TN:\nSF:lib/p"), s("p_partkey"), lit(".js\nFN:1,foo\nFN:5,bar\nFNDA:"), s(z % 2), lit(",foo\nFNDA:0,bar\nFNDA:"), s(pk % 2), lit(",bar\nDA:1,3\nDA:2,"), s(pk % 2),
        lit("\nDA:7,"), s(z % 3), lit("\nBRDA:1,0,0,-\nBRDA:1,0,1,"), s(z % 2), lit("\nBRDA:9\nend_of_record\nSF:empty.js\nend_of_record\n"))
    return B.dealt(t.part, "p_partkey").select(F.col("p_type").alias("repo"), F.concat(lit("r"), s("p_partkey"), lit("/lcov.info")).alias("path"), text.alias("content"))


@query("lcov_coverage", """
SELECT p_type AS repo, 'lib/p' || p_partkey || '.js' AS path, 3 AS total_lines, 1 + (p_partkey % 2)::INT + (p_size % 3 > 0)::INT AS covered_lines, 2 AS total_functions,
 p_size % 2 + (p_partkey % 2)::INT AS covered_functions, 2 AS total_branches, p_size % 2 AS covered_branches,
 array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 2 END, CASE WHEN p_size % 3 = 0 THEN 7 END], lambda x: x IS NOT NULL), ',') AS missed FROM part""")
def lcov_coverage(t):
    return SV.read_lcov(lcov_files(t)).select("repo", "path", "total_lines", "covered_lines", "total_functions", "covered_functions", "total_branches",
                                              "covered_branches", F.array_join("uncovered_lines", ",").alias("missed"))


@query("detected_coverage", with_sql("istanbul", """
SELECT repo, 'istanbul-json' AS format, path, covered_statements AS covered, total_statements AS total, floor(covered_statements / 4.0::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS pct FROM istanbul
UNION ALL SELECT p_type, 'lcov', 'lib/p' || p_partkey || '.js', 1 + (p_partkey % 2)::INT + (p_size % 3 > 0)::INT, 3, floor((1 + (p_partkey % 2)::INT + (p_size % 3 > 0)::INT)::DOUBLE / 3.0::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE FROM part
UNION ALL SELECT p_brand, CASE p_partkey % 2 WHEN 0 THEN 'clover' ELSE 'cobertura' END, 'x' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '/clover.xml' ELSE '/cobertura-coverage.xml' END, NULL, NULL,
 floor(('0.' || (p_size + 10))::DOUBLE * 10000::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE FROM part"""))
def detected_coverage(t):
    xml = B.dealt(t.part, "p_partkey").select(
        F.col("p_brand").alias("repo"),
        F.concat(lit("x"), s("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "/clover.xml").otherwise("/cobertura-coverage.xml")).alias("path"),
        F.concat(lit('<coverage line-rate="0.'), s(F.col("p_size") + 10), lit('" branch-rate="1"/>')).alias("content"))
    return SV.read_coverage(istanbul_files(t).unionByName(lcov_files(t)).unionByName(xml)).where("format != 'istanbul-json' OR path != 'broken.ts'")


def coverage(t):
    q = F.col("l_quantity").cast("int")
    ln = F.col("l_linenumber")
    part = lambda k: F.least(q + k, F.lit(50))
    return B.dealt(t.lineitem, "l_suppkey", "l_partkey").select(
        F.concat(lit("r"), s(F.col("l_suppkey") % 2)).alias("repo"), F.col("l_returnflag").alias("tool"), F.concat(lit("p"), s("l_partkey")).alias("path"),
        lit(50).alias("total_statements"), part(0).alias("covered_statements"), lit(50).alias("total_branches"), part(1).alias("covered_branches"),
        lit(50).alias("total_functions"), part(2).alias("covered_functions"), lit(50).alias("total_lines"), part(3).alias("covered_lines"),
        F.sequence(ln, ln + 40).alias("uncovered_lines"))


define("coverage", """
SELECT 'r' || (l_suppkey % 2) AS repo, l_returnflag AS tool, 'p' || l_partkey AS path, least(l_quantity::INT, 50) AS c0, least(l_quantity::INT + 1, 50) AS c1, least(l_quantity::INT + 2, 50) AS c2, least(l_quantity::INT + 3, 50) AS c3,
 generate_series(l_linenumber, l_linenumber + 40) AS u FROM lineitem""")


@query("merged_coverage", with_sql("coverage", """
, k AS (SELECT repo, path, count(*) AS n, max(c0) AS c0, max(c1) AS c1, max(c2) AS c2, max(c3) AS c3 FROM coverage GROUP BY ALL),
l AS (SELECT repo, path, line, count(*) AS n FROM (SELECT repo, path, unnest(u) AS line FROM coverage) GROUP BY ALL),
m AS (SELECT repo, path, string_agg(line::VARCHAR, ',' ORDER BY line) AS missed FROM l JOIN k USING (repo, path, n) GROUP BY ALL)
SELECT repo, path, floor(c0 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE AS statements_pct, floor(c1 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE AS branches_pct, floor(c2 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE AS functions_pct,
 floor(c3 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE AS lines_pct, coalesce(missed, '') AS missed FROM k LEFT JOIN m USING (repo, path)"""))
def merged_coverage(t):
    return CV.merge_coverage(coverage(t)).withColumn("missed", F.array_join("uncovered_lines", ",")).drop("uncovered_lines")


@query("merged_coverage_compat", with_sql("coverage", """
, k AS (SELECT repo, path, max(floor(c0 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE) AS statements_pct, max(floor(c1 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE) AS branches_pct, max(floor(c2 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE) AS functions_pct,
 max(floor(c3 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE) AS lines_pct FROM coverage GROUP BY ALL), m AS (SELECT repo, path, string_agg(line::VARCHAR, ',' ORDER BY line) AS missed FROM (SELECT DISTINCT repo, path, unnest(u) AS line FROM coverage) GROUP BY ALL)
SELECT k.*, missed FROM k JOIN m USING (repo, path)"""))
def merged_coverage_compat(t):
    return CV.merge_coverage(coverage(t), compat=True).withColumn("missed", F.array_join("uncovered_lines", ",")).drop("uncovered_lines")


@query("coverage_totals", with_sql("coverage", """
SELECT tool, 50 * count(*)::BIGINT AS total_statements, sum(c0)::BIGINT AS covered_statements, 50 * count(*)::BIGINT AS total_branches, sum(c1)::BIGINT AS covered_branches, 50 * count(*)::BIGINT AS total_functions,
 sum(c2)::BIGINT AS covered_functions, 50 * count(*)::BIGINT AS total_lines, sum(c3)::BIGINT AS covered_lines, floor(sum(c3)::DOUBLE / (50 * count(*))::DOUBLE * 100 + 0.5)::DOUBLE AS overall_percent FROM coverage GROUP BY 1"""))
def coverage_totals(t):
    return CV.coverage_totals(coverage(t), ("tool",))


@query("coverage_failures", with_sql("coverage", """
SELECT repo, path, max(floor(c3 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE) AS percent, 99.0::DOUBLE AS threshold FROM coverage GROUP BY 1, 2 HAVING max(floor(c3 / 50.0::DOUBLE * 100 + 0.5)::DOUBLE) < 99"""))
def coverage_failures(t):
    return CV.coverage_failures(CV.merged_shares(coverage(t)), 99)


# --- database schemas ----------------------------------------------------------------

TYPES = ["string", "integer", "datetime", "json", "User"]


def _fields(t, after: bool):
    """Fields of two schema versions: entity per part size, field per part."""
    pk, z = F.col("p_partkey"), F.col("p_size")
    shift = 1 if after else 0
    keep = (pk % 9 != 3) & (z % 13 != 5) if after else (pk % 9 != 1) & (z % 13 != 7)
    return B.dealt(t.part, "p_partkey").where(keep).select(
        F.concat(lit("E"), s("p_size"), lit("_"), s(pk % 7)).alias("entity"), F.concat(lit("f"), s("p_partkey")).alias("field"), pk.alias("pos"),
        pick(TYPES, (pk + F.when(pk % 5 == 0, shift).otherwise(0)) % 5).alias("type"),
        ((pk + F.when(pk % 6 == 0, shift).otherwise(0)) % 2 == 0).alias("required"),
        ((pk + F.when(pk % 8 == 0, shift).otherwise(0)) % 4 == 0).alias("is_unique"),
        F.when(pk % 3 == 0, F.when(pk % 10 == 0, "now()").otherwise(F.concat(lit("d"), s(F.when(pk % 12 == 0, shift).otherwise(0))))).alias("default_value"),
        F.when((pk + F.when(pk % 14 == 0, shift * 5).otherwise(0)) % 11 == 0, "Owner").alias("rel_entity"),
        F.when((pk + F.when(pk % 14 == 0, shift * 5).otherwise(0)) % 11 == 0, "one-to-many").alias("rel_type"))


def _fields_sql(after: bool) -> str:
    k = 1 if after else 0
    keep = "p_partkey % 9 <> 3 AND p_size % 13 <> 5" if after else "p_partkey % 9 <> 1 AND p_size % 13 <> 7"
    return f"""
SELECT 'E' || p_size || '_' || (p_partkey % 7) AS entity, 'f' || p_partkey AS field, p_partkey AS pos,
 list_extract({B.lit_list(TYPES)}, ((p_partkey + CASE WHEN p_partkey % 5 = 0 THEN {k} ELSE 0 END) % 5)::INT + 1) AS type,
 (p_partkey + CASE WHEN p_partkey % 6 = 0 THEN {k} ELSE 0 END) % 2 = 0 AS required, (p_partkey + CASE WHEN p_partkey % 8 = 0 THEN {k} ELSE 0 END) % 4 = 0 AS is_unique,
 CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 10 = 0 THEN 'now()' ELSE 'd' || CASE WHEN p_partkey % 12 = 0 THEN {k} ELSE 0 END END END AS default_value,
 CASE WHEN (p_partkey + CASE WHEN p_partkey % 14 = 0 THEN {k * 5} ELSE 0 END) % 11 = 0 THEN 'Owner' END AS rel_entity,
 CASE WHEN (p_partkey + CASE WHEN p_partkey % 14 = 0 THEN {k * 5} ELSE 0 END) % 11 = 0 THEN 'one-to-many' END AS rel_type FROM part WHERE {keep}"""


define("f_before", _fields_sql(False))
define("f_after", _fields_sql(True))
define("schema_changes", """
WITH j AS (SELECT coalesce(b.entity, a.entity) AS entity, coalesce(b.field, a.field) AS field, b.field IS NOT NULL AS hb, a.field IS NOT NULL AS ha, b AS b, a AS a FROM f_before b FULL JOIN f_after a ON a.entity = b.entity AND a.field = b.field),
e AS (SELECT entity, bool_or(hb) AS had, bool_or(ha) AS has FROM j GROUP BY 1), k AS (SELECT j.* FROM j JOIN e USING (entity) WHERE had AND has), c AS (SELECT * FROM k WHERE ha AND hb)
SELECT entity, NULL::VARCHAR AS field, CASE WHEN had THEN 'entity removed' ELSE 'entity added' END AS change, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM e WHERE NOT (had AND has)
UNION ALL SELECT entity, field, 'added', NULL, a.type || CASE WHEN a.required THEN '' ELSE '?' END FROM k WHERE NOT hb
UNION ALL SELECT entity, field, 'removed', b.type || CASE WHEN b.required THEN '' ELSE '?' END, NULL FROM k WHERE NOT ha
UNION ALL SELECT entity, field, 'type changed', b.type, a.type FROM c WHERE a.type <> b.type
UNION ALL SELECT entity, field, CASE WHEN a.required THEN 'changed to required' ELSE 'changed to optional' END, CASE WHEN b.required THEN 'required' ELSE 'optional' END, CASE WHEN a.required THEN 'required' ELSE 'optional' END FROM c WHERE a.required <> b.required
UNION ALL SELECT entity, field, CASE WHEN a.is_unique THEN 'unique constraint added' ELSE 'unique constraint removed' END, CASE WHEN b.is_unique THEN 'unique' ELSE 'not unique' END, CASE WHEN a.is_unique THEN 'unique' ELSE 'not unique' END FROM c WHERE a.is_unique <> b.is_unique
UNION ALL SELECT entity, field, 'default changed', coalesce(b.default_value, '(none)'), coalesce(a.default_value, '(none)') FROM c WHERE a.default_value IS DISTINCT FROM b.default_value
UNION ALL SELECT entity, field, 'relation changed', coalesce(b.rel_type || ' -> ' || b.rel_entity, '(none)'), coalesce(a.rel_type || ' -> ' || a.rel_entity, '(none)') FROM c WHERE a.rel_entity IS DISTINCT FROM b.rel_entity""", ("f_before", "f_after"))


@query("schema_diff", with_sql("schema_changes", "SELECT * FROM schema_changes"))
def schema_diff(t):
    return D.schema_diff(_fields(t, False), _fields(t, True))


def _ddl_sql(dialect: str) -> str:
    o = "`" if dialect == "mysql" else '"'
    js = {"postgres": "JSONB", "mysql": "JSON", "sqlite": "TEXT"}[dialect]
    ty = lambda c: f"CASE replace({c}, '?', '') WHEN 'string' THEN 'VARCHAR(255)' WHEN 'integer' THEN 'INTEGER' WHEN 'datetime' THEN 'TIMESTAMP' WHEN 'json' THEN '{js}' ELSE 'INTEGER' END"
    tb, fd = f"'{o}' || entity || '{o}'", f"'{o}' || field || '{o}'"
    lite = dialect == "sqlite"
    re = lambda why: f"'-- SQLite: ALTER TABLE ' || {tb} || ' requires full table rebuild {why}"
    typed = (re("for type change on ' || field") if lite else f"'ALTER TABLE ' || {tb} || ' MODIFY COLUMN ' || {fd} || ' ' || {ty('after')} || ';'" if dialect == "mysql"
             else f"'ALTER TABLE ' || {tb} || ' ALTER COLUMN ' || {fd} || ' TYPE ' || {ty('after')} || ';'")
    uq = f"'{o}uq_' || entity || '_' || field || '{o}'"
    col = f"""CASE WHEN rel_entity IS NOT NULL THEN concat_ws(' ', '{o}' || field || 'Id{o}', 'INTEGER', CASE WHEN required THEN 'NOT NULL' ELSE 'NULL' END, CASE WHEN default_value = 'now()' THEN 'DEFAULT now()' WHEN default_value IS NOT NULL THEN 'DEFAULT ''' || default_value || '''' END)
 ELSE concat_ws(' ', {fd}, {ty('type')}, CASE WHEN is_unique THEN 'UNIQUE' END, CASE WHEN required THEN 'NOT NULL' ELSE 'NULL' END, CASE WHEN default_value = 'now()' THEN 'DEFAULT now()' WHEN default_value IS NOT NULL THEN 'DEFAULT ''' || default_value || '''' END) END"""
    return f"""
SELECT entity, NULL AS field, 'entity added' AS change, 'CREATE TABLE ' || {tb} || ' (' || chr(10) || string_agg('  ' || x, ',' || chr(10) ORDER BY k, pos) || chr(10) || ');' AS statement FROM (
 SELECT entity, 0 AS k, pos, {col} AS x FROM f_after UNION ALL SELECT entity, 1, pos, 'FOREIGN KEY ({o}' || field || 'Id{o}) REFERENCES {o}' || rel_entity || '{o}(id)' FROM f_after WHERE rel_entity IS NOT NULL)
 WHERE entity IN (SELECT entity FROM schema_changes WHERE change = 'entity added') GROUP BY entity
UNION ALL SELECT entity, field, change, CASE change WHEN 'entity removed' THEN 'DROP TABLE IF EXISTS ' || {tb} || ';' WHEN 'added' THEN 'ALTER TABLE ' || {tb} || ' ADD COLUMN ' || {fd} || ' ' || {ty('after')} || ';'
 WHEN 'removed' THEN {"'-- SQLite does not support DROP COLUMN directly; recreate table to remove ' || field" if lite else f"'ALTER TABLE ' || {tb} || ' DROP COLUMN ' || {fd} || ';'"}
 WHEN 'type changed' THEN {typed} WHEN 'changed to required' THEN {re("to set ' || field || ' NOT NULL'") if lite else f"'ALTER TABLE ' || {tb} || ' ALTER COLUMN ' || {fd} || ' SET NOT NULL;'"}
 WHEN 'changed to optional' THEN {re("to drop NOT NULL on ' || field") if lite else f"'ALTER TABLE ' || {tb} || ' ALTER COLUMN ' || {fd} || ' DROP NOT NULL;'"}
 WHEN 'unique constraint added' THEN 'CREATE UNIQUE INDEX ' || {uq} || ' ON ' || {tb} || ' (' || {fd} || ');' WHEN 'unique constraint removed' THEN 'DROP INDEX IF EXISTS ' || {uq} || ';'
 ELSE '-- ' || change || ': ' || field || ' ' || before || ' => ' || after END FROM schema_changes WHERE change <> 'entity added'"""


def _ddl(dialect: str):
    @query("migration_ddl_" + dialect, with_sql("schema_changes", _ddl_sql(dialect)))
    def run(t):
        after = _fields(t, True)
        return D.migration_ddl(D.schema_diff(_fields(t, False), after), after, dialect)

    return run


for _d in ("postgres", "mysql", "sqlite"):
    _ddl(_d)


def model_files(t, after: bool):
    """Two models per part with a closing brace, an attribute line and text outside any block."""
    pk = F.col("p_partkey")
    kind = pick(["string", "Int?", "DateTime"], (pk + (F.when(pk % 4 == 0, 1).otherwise(0) if after else 0)) % 3)
    extra = F.when(pk % 5 == (2 if after else 3), "\n  extra Json @db").otherwise("")
    second = F.when(pk % 7 == (1 if after else 2), "").otherwise("\ntable Log { \n  at DateTime\n}\n")
    text = F.concat(lit("generator x\n\nmodel M"), s("p_partkey"), lit(" {\n  id String @id\n  value "), kind, lit("\n  value "), kind, extra,
                    lit("\n  @@index([id])\n}\nloose field here"), second)
    return B.dealt(t.part, "p_partkey").select(F.concat(lit("r"), s("p_partkey")).alias("repo"), lit("schema.prisma").alias("path"), text.alias("content"))


def _model_sql(after: bool) -> str:
    return f"""
SELECT 'r' || p_partkey AS repo, 'M' || p_partkey AS entity, 'id' AS field, 'String' AS type FROM part
UNION ALL SELECT 'r' || p_partkey, 'M' || p_partkey, 'value', ['string', 'Int?', 'DateTime'][((p_partkey + {"CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END" if after else "0"}) % 3)::INT + 1] FROM part
UNION ALL SELECT 'r' || p_partkey, 'M' || p_partkey, 'extra', 'Json' FROM part WHERE p_partkey % 5 = {2 if after else 3}
UNION ALL SELECT 'r' || p_partkey, 'Log', 'at', 'DateTime' FROM part WHERE p_partkey % 7 <> {1 if after else 2}"""


define("m_before", _model_sql(False))
define("m_after", _model_sql(True))


@query("schema_models", with_sql("m_after", "SELECT * FROM m_after"))
def schema_models(t):
    return SS.read_schema_models(model_files(t, True)).drop("path")


@query("schema_evolution", with_sql("m_before m_after", """
, j AS (SELECT coalesce(b.entity, a.entity) AS entity, coalesce(b.field, a.field) AS field, b.type AS b, a.type AS a FROM (SELECT repo || '.' || entity AS entity, field, type FROM m_before) b FULL JOIN (SELECT repo || '.' || entity AS entity, field, type FROM m_after) a USING (entity, field)),
e AS (SELECT entity, bool_or(b IS NOT NULL) AS had, bool_or(a IS NOT NULL) AS has FROM j GROUP BY 1)
SELECT entity || ' (model)' AS field, 'model' AS type, CASE WHEN had THEN 'removed' ELSE 'added' END AS change FROM e WHERE NOT (had AND has)
UNION ALL SELECT entity || '.' || field, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE b || ' -> ' || a END, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'modified' END FROM j JOIN e USING (entity) WHERE had AND has AND a IS DISTINCT FROM b"""))
def schema_evolution(t):
    def read(after):
        return SS.read_schema_models(model_files(t, after)).withColumn("entity", F.concat_ws(".", "repo", "entity"))

    return D.schema_evolution(read(False), read(True))


# --- API contracts -------------------------------------------------------------------


def api_specs(t):
    """Two versions of one OpenAPI document per part, with one path each."""
    pk = F.col("p_partkey")

    def doc(version: str):
        new = version == "v2"
        q2 = F.when(pk % 3 == 0, "").otherwise(',{"name":"q"}') if new else lit(',{"name":"q"}')
        z = F.when(pk % 4 == 0, ',{"name":"z","in":"header","required":true}').otherwise("") if new else lit("")
        btype = F.when((pk % 6 == 0) & lit(new), "integer").otherwise("string")
        extra = F.when(pk % 8 == 0, "").otherwise(',"c":{"type":"number"}') if new else lit(',"c":{"type":"number"}')
        req = F.when((pk % 10 == 0) & lit(new), "[]").otherwise('["a"]')
        ok = F.concat(lit('"200":{"content":{"application/json":{"schema":{"type":"object","properties":{"a":{"type":"string"},"b":{"type":"'), btype, lit('"}'), extra, lit('},"required":'), req, lit("}}}}"))
        resp = F.when((pk % 11 == 0) & lit(new), '"404":{}').otherwise(ok)
        ref = F.when((pk % 13 == 0) & lit(new), "#/B").otherwise("#/A")
        text = F.concat(
            lit('{"paths":{"/items/'), s("p_partkey"), lit('":{"get":{"parameters":[{"name":"id","in":"path","required":true}'), q2, z, lit('],"responses":{'), resp,
            lit(',"default":{"schema":{"$ref":"'), ref, lit('"}}}},"x-note":{}'), F.when(pk % 7 == (3 if new else 5), "").otherwise(',"POST":{}'), lit("}}}"))
        return B.dealt(t.part, "p_partkey").where(pk % 9 != (4 if new else 2)).select(lit(version).alias("version"), F.when(pk % 53 == 0, "{bad").otherwise(text).alias("content"))

    return doc("v1").unionByName(doc("v2"))


define("ops", """
SELECT 'v1' AS version, p_partkey AS k, '/items/' || p_partkey AS path, m AS method FROM part, (VALUES ('get'), ('post')) v(m) WHERE p_partkey % 9 <> 2 AND p_partkey % 53 <> 0 AND (m = 'get' OR p_partkey % 7 <> 5)
UNION ALL SELECT 'v2', p_partkey, '/items/' || p_partkey, m FROM part, (VALUES ('get'), ('post')) v(m) WHERE p_partkey % 9 <> 4 AND p_partkey % 53 <> 0 AND (m = 'get' OR p_partkey % 7 <> 3)""")
define("api_changes", """
WITH b AS (SELECT * FROM ops WHERE version = 'v1'), a AS (SELECT * FROM ops WHERE version = 'v2'), g AS (SELECT k, path FROM b JOIN a USING (k, path, method) WHERE method = 'get')
SELECT 'endpoint-removed' AS type, path, method, 'Endpoint ' || upper(method) || ' ' || path || ' was removed' AS detail FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = b.path AND a.method = b.method)
UNION ALL SELECT 'endpoint-added', path, method, 'Endpoint ' || upper(method) || ' ' || path || ' was added' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.path = b.path AND a.method = b.method)
UNION ALL SELECT 'param-removed', path, 'get', 'Optional parameter ''q'' (query) was removed' FROM g WHERE k % 3 = 0
UNION ALL SELECT 'param-removed', path, 'get', 'New required parameter ''z'' (header) was added' FROM g WHERE k % 4 = 0
UNION ALL SELECT 'response-changed', path, 'get', 'Response 200 was removed' FROM g WHERE k % 11 = 0
UNION ALL SELECT 'response-changed', path, 'get', 'Response 200 schema changed' FROM g WHERE k % 11 <> 0 AND (k % 6 = 0 OR k % 8 = 0 OR k % 10 = 0)
UNION ALL SELECT 'response-changed', path, 'get', 'Response default schema changed' FROM g WHERE k % 13 = 0""", ("ops",))


def api_changes(t, before="v1", after="v2"):
    specs = api_specs(t)
    return D.api_diff(SS.read_openapi(specs), before, after)


@query("openapi_endpoints", with_sql("ops", "SELECT version, path, method FROM ops"))
def openapi_endpoints(t):
    return SS.read_openapi_endpoints(api_specs(t))


@query("openapi_params", with_sql("ops", """
SELECT version, path, method, 'id' AS name, 'path' AS location, true AS required FROM ops WHERE method = 'get'
UNION ALL SELECT version, path, method, 'q', 'query', false FROM ops WHERE method = 'get' AND NOT (version = 'v2' AND k % 3 = 0)
UNION ALL SELECT version, path, method, 'z', 'header', true FROM ops WHERE method = 'get' AND version = 'v2' AND k % 4 = 0"""))
def openapi_params(t):
    return SS.read_openapi_params(api_specs(t))


@query("api_diff", with_sql("api_changes", "SELECT *, type <> 'endpoint-added' AS breaking FROM api_changes"))
def api_diff(t):
    return api_changes(t)


@query("api_verdict", with_sql("api_changes", "SELECT count(*) AS changes, coalesce(bool_or(type <> 'endpoint-added'), false) AS breaking FROM api_changes"))
def api_verdict(t):
    return D.api_verdict(api_changes(t))


@query("api_diff_missing_spec", with_sql("ops", """
SELECT 'endpoint-added' AS type, path, method, 'Endpoint ' || upper(method) || ' ' || path || ' was added' AS detail, false AS breaking FROM ops WHERE version = 'v2'"""))
def api_diff_missing_spec(t):
    """The earlier ref holds no spec: every endpoint is new."""
    return api_changes(t, "v0", "v2")


@query("route_drift", """
WITH b AS (SELECT DISTINCT source AS repo, '"get /d/' || doc_id || '"' AS route FROM documents WHERE doc_id % 3 <> 0 UNION SELECT DISTINCT source, '''POST /l/' || lang || '''' FROM documents WHERE doc_id % 3 <> 0),
a AS (SELECT DISTINCT source AS repo, '"get /d/' || doc_id || '"' AS route FROM documents WHERE doc_id % 4 <> 0 UNION SELECT DISTINCT source, '''POST /l/' || lang || '''' FROM documents WHERE doc_id % 4 <> 0)
SELECT repo, '+ ' || route AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT repo, '- ' || route FROM (FROM b EXCEPT FROM a)""")
def route_drift(t):
    def routes(keep):
        text = F.concat(lit('app("get /d/'), s("doc_id"), lit("\"); r('POST /l/"), "lang", lit("')"))
        return SS.route_strings(t.documents.where(keep).select(F.col("source").alias("repo"), text.alias("content")))

    return D.route_drift(routes("doc_id % 3 <> 0"), routes("doc_id % 4 <> 0"))


# --- configuration -------------------------------------------------------------------


def env_files(t, example: bool = False):
    k = F.col("c_custkey")
    if example:
        text = F.concat(lit("PORT=8080\nDEBUG=true\nURL=https://x.example\n"), F.when(k % 3 == 0, "ONLY_EXAMPLE=1\n").otherwise(""), lit("NAME=x"))
    else:
        text = F.concat(
            lit("# local\n\nPORT="), F.when(k % 5 == 0, "80a").otherwise("8080"), lit("\n DEBUG = \"true\"\nNO_EQUALS\nURL="), F.when(k % 7 == 0, "ftp://x").otherwise("'https://x.example'"),
            lit("\nNAME=first\nNAME="), F.when(k % 4 == 0, "").otherwise(F.col("c_name")), F.when(k % 6 == 0, "\nEXTRA=a=b").otherwise(""))
    return B.dealt(t.customer, "c_custkey").select(F.col("c_name").alias("repo"), lit(".env").alias("path"), text.alias("content"))


define("env", """
SELECT c_custkey AS k, c_name AS service, 'PORT' AS key, CASE WHEN c_custkey % 5 = 0 THEN '80a' ELSE '8080' END AS value FROM customer UNION ALL SELECT c_custkey, c_name, 'DEBUG', 'true' FROM customer
UNION ALL SELECT c_custkey, c_name, 'URL', CASE WHEN c_custkey % 7 = 0 THEN 'ftp://x' ELSE 'https://x.example' END FROM customer UNION ALL SELECT c_custkey, c_name, 'NAME', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END FROM customer
UNION ALL SELECT c_custkey, c_name, 'EXTRA', 'a=b' FROM customer WHERE c_custkey % 6 = 0""")


@query("env_values", with_sql("env", "SELECT service, key, value FROM env"))
def env_values(t):
    return SC.read_env(env_files(t)).drop("path")


@query("env_drift", with_sql("env", """
SELECT service, key, 'extra' AS state FROM env WHERE key = 'EXTRA' UNION ALL SELECT c_name, 'ONLY_EXAMPLE', 'missing' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT service, key, 'drifted' FROM env WHERE (key = 'PORT' AND value <> '8080') OR (key = 'URL' AND value <> 'https://x.example') OR (key = 'NAME' AND value <> 'x')"""))
def env_drift(t):
    return CF.env_drift(SC.read_env(env_files(t)), SC.read_env(env_files(t, True)))


@query("env_drift_compat", with_sql("env", """
, d AS (SELECT k, service, key, 'extra' AS state FROM env WHERE key = 'EXTRA' UNION ALL SELECT c_custkey, c_name, 'ONLY_EXAMPLE', 'missing' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT k, service, key, 'drifted' FROM env WHERE (key = 'PORT' AND value <> '8080') OR (key = 'URL' AND value <> 'https://x.example') OR (key = 'NAME' AND value <> 'x'))
SELECT service, key, state FROM d WHERE k % 3 = 0"""))
def env_drift_compat(t):
    return CF.env_drift(SC.read_env(env_files(t)), SC.read_env(env_files(t, True)), compat=True)


@query("env_key_check", with_sql("env", """
SELECT service, key, 'extra (not in schema)' AS problem FROM env WHERE key = 'EXTRA' UNION ALL SELECT c_name, 'ONLY_EXAMPLE', 'missing' FROM customer WHERE c_custkey % 3 = 0"""))
def env_key_check(t):
    return CF.env_key_check(SC.read_env(env_files(t)), SC.read_env(env_files(t, True)))


RULES = (CF.ConfigRule("PORT", "number", True), CF.ConfigRule("DEBUG", "boolean", True), CF.ConfigRule("URL", "url", False, r"example$"),
         CF.ConfigRule("NAME", "string", True), CF.ConfigRule("EXTRA", "string", False))


@query("config_issues", with_sql("env", """
SELECT service, 'PORT' AS key, 'number' AS expected, value AS actual, 'error' AS severity FROM env WHERE key = 'PORT' AND value = '80a'
UNION ALL SELECT service, 'URL', 'url', value, 'error' FROM env WHERE key = 'URL' AND value = 'ftp://x' UNION ALL SELECT service, 'URL', 'match pattern example$', value, 'warning' FROM env WHERE key = 'URL' AND value = 'ftp://x'
UNION ALL SELECT service, 'NAME', 'required string', '', 'error' FROM env WHERE key = 'NAME' AND value = '' UNION ALL SELECT c_name, 'EXTRA', 'optional', '(missing)', 'notice' FROM customer WHERE c_custkey % 6 <> 0"""))
def config_issues(t):
    return CF.validate_config(SC.read_env(env_files(t)), RULES)


@query("missing_variables", with_sql("env", """
SELECT service, 'NAME' AS key, '(empty)' AS actual FROM env WHERE key = 'NAME' AND value = '' UNION ALL SELECT c_name, 'EXTRA', '(missing)' FROM customer WHERE c_custkey % 6 <> 0"""))
def missing_variables(t):
    return CF.missing_variables(SC.read_env(env_files(t)), ["NAME", "EXTRA"])


JSON_RULES = (CF.ConfigRule("k", "number"), CF.ConfigRule("user.name", "string"), CF.ConfigRule("tags", "array"), CF.ConfigRule("flag", "boolean"))


@query("json_config_issues", """
WITH e AS (SELECT event_id AS id, event_id % 6 AS k FROM events)
SELECT id, '(parse)' AS key, 'valid JSON' AS expected, 'invalid' AS actual FROM e WHERE k = 0 UNION ALL SELECT id, '(root)', 'object', 'number' FROM e WHERE k = 1
UNION ALL SELECT id, x, y, '(missing)' FROM e, (VALUES ('user.name', 'string'), ('tags', 'array'), ('flag', 'boolean')) v(x, y) WHERE k IN (2, 5)
UNION ALL SELECT id, 'k', 'number', 'string' FROM e WHERE k = 3 UNION ALL SELECT id, 'flag', 'boolean', 'object' FROM e WHERE k = 3 UNION ALL SELECT id, 'tags', 'array', 'object' FROM e WHERE k = 4 UNION ALL SELECT id, 'user.name', 'string', '(missing)' FROM e WHERE k = 4""")
def json_config_issues(t):
    k = F.col("event_id") % 6
    text = (F.when(k == 0, F.concat(lit("{oops "), "props")).when(k == 1, s("event_id"))
            .when(k == 3, F.concat(lit('{"k":"'), s("user_id"), lit('","user":{"name":"n"},"tags":[1],"flag":null}')))
            .when(k == 4, F.concat(lit('{"k":'), s("value"), lit(',"user":{},"tags":{},"flag":true}'))).otherwise(F.col("props")))
    return CF.validate_json(t.events.select(F.col("event_id").alias("id"), text.alias("content")), JSON_RULES)


# --- locales -------------------------------------------------------------------------


def locale_files(t):
    d = F.col("doc_id")
    word = F.regexp_replace(F.left("text", lit(20)), "[^A-Za-z ]", "")
    js = F.concat(lit("export default { 'top': \""), word, lit("\", "), F.concat(lit("k"), s(d % 5)), lit(": 'x' }"))
    js_like = F.concat(lit('{"top":"'), word, lit('","menu":{"k'), s(d % 5), lit('":"v","deep":{"n":5,"leaf":"z'), s("doc_id"), lit('"}},"list":["a"]}'))
    return t.documents.select(
        F.concat(lit("d"), s("doc_id")).alias("repo"),
        F.concat(lit("locales/"), F.when(d % 17 == 0, "README").otherwise(F.col("lang")), F.when(d % 3 == 0, ".js").otherwise(".json")).alias("path"),
        F.when(d % 3 == 0, js).otherwise(js_like).alias("content"))


@query("locale_entries", """
WITH b AS (SELECT 'd' || doc_id AS repo, doc_id AS d, lang, regexp_replace(left(text, 20), '[^A-Za-z ]', '', 'g') AS w FROM documents WHERE doc_id % 17 <> 0)
SELECT repo, lang, 'top' AS key, w AS value FROM b UNION ALL SELECT repo, lang, 'k' || (d % 5), 'x' FROM b WHERE d % 3 = 0
UNION ALL SELECT repo, lang, 'menu.k' || (d % 5), 'v' FROM b WHERE d % 3 <> 0 UNION ALL SELECT repo, lang, 'menu.deep.leaf', 'z' || d FROM b WHERE d % 3 <> 0""")
def locale_entries(t):
    return SL.read_locales(locale_files(t))


def locales(t):
    return t.documents.select(F.col("source").alias("repo"), "lang", F.concat(lit("k"), s(F.col("doc_id") % 400)).alias("key"),
                              F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.left("text", lit(20))).alias("value"))


define("locales", """
SELECT source AS repo, lang, 'k' || (doc_id % 400) AS key, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE left(text, 20) END AS value FROM documents""")
define("gaps", """
SELECT k.repo, k.key, l.lang FROM (SELECT DISTINCT repo, key FROM locales) k JOIN (SELECT DISTINCT repo, lang FROM locales) l ON l.repo = k.repo
WHERE NOT EXISTS (SELECT 1 FROM locales x WHERE x.repo = k.repo AND x.key = k.key AND x.lang = l.lang AND trim(x.value) <> '')""", ("locales",))


@query("missing_translations", with_sql("gaps", "SELECT * FROM gaps"))
def missing_translations(t):
    return I.missing_translations(locales(t))


@query("untranslated_keys", with_sql("gaps", """
, n AS (SELECT repo, count(DISTINCT lang) AS n FROM locales GROUP BY 1) SELECT g.repo, g.key FROM gaps g JOIN n USING (repo) GROUP BY g.repo, g.key, n HAVING (n - count(*)) * 2 < n"""))
def untranslated_keys(t):
    return I.untranslated_keys(locales(t))


def string_locales(t):
    """Locale rows for the page strings' own keys: three languages, each missing some keys."""
    strings = S.hardcoded_strings(B.page_files(t)).select("repo", "key", "path")
    langs = F.array(*[F.struct(lit(i).alias("i"), lit(x).alias("lang")) for i, x in enumerate(("de", "en", "fr"))])
    rows = strings.where(F.length("key") % 5 != 0).select("repo", "key", F.explode(langs).alias("l"))
    return strings, rows.select("repo", "key", "l.lang", F.when((F.length("key") + F.col("l.i") * (F.length("key") % 3)) % 4 == 0, "").otherwise("t").alias("value"))


_STR = _strings_sql("page_files")
_SLOC = """
, st AS (SELECT repo, key, path FROM r WHERE rn = 1), lo AS (SELECT repo, key, lang, CASE WHEN (length(key) + i * (length(key) % 3)) % 4 = 0 THEN '' ELSE 't' END AS value FROM st, (VALUES (0, 'de'), (1, 'en'), (2, 'fr')) v(i, lang) WHERE length(key) % 5 <> 0),
ln AS (SELECT DISTINCT repo, lang FROM lo), h AS (SELECT repo, key, count(*) FILTER (value <> '') AS have FROM lo GROUP BY ALL), na AS (SELECT repo, count(*) AS n FROM ln GROUP BY 1)
"""
_STR = _STR[: _STR.rindex("SELECT repo, path, line, value, context, key FROM r")].rstrip()


@query("untranslated_strings", with_sql("page_files", _STR + _SLOC + """
SELECT st.repo, st.key, ln.lang, st.path FROM st JOIN h ON h.repo = st.repo AND h.key = st.key JOIN na ON na.repo = st.repo JOIN ln ON ln.repo = st.repo
WHERE have * 2 < n OR NOT EXISTS (SELECT 1 FROM lo WHERE lo.repo = st.repo AND lo.key = st.key AND lo.lang = ln.lang AND value <> '')"""))
def untranslated_strings(t):
    return I.untranslated_strings(*string_locales(t))


@query("strings_with_gaps", with_sql("page_files", _STR + _SLOC + """
SELECT st.repo, st.key, ln.lang, st.path FROM st JOIN h ON h.repo = st.repo AND h.key = st.key JOIN na ON na.repo = st.repo JOIN ln ON ln.repo = st.repo WHERE have < n"""))
def strings_with_gaps(t):
    return I.strings_with_gaps(*string_locales(t))


# --- imports -------------------------------------------------------------------------

define("code_imports", r"""
SELECT repo, path AS src_path, unnest(regexp_extract_all(content, 'from\s+[''"]([^''"]+)[''"]', 1)) AS target FROM code_files WHERE regexp_matches(path, '\.(ts|tsx|js|jsx)$')""", ("code_files",))


@query("import_edges", with_sql("code_imports", "SELECT repo, src_path, target, count(*) AS n FROM code_imports GROUP BY ALL"))
def import_edges(t):
    return IM.read_imports(B.code_files(t)).groupBy("repo", "src_path", "target").agg(F.count(lit(1)).alias("n"))


def page_imports(t):
    from ..functions.text import captures

    return B.dealt(t.pages, "page_id").select(F.col("page_id").alias("p"), F.explode(captures(F.col("html"), 'href="([^"]*)"')).alias("target")).select(
        lit("web").alias("repo"), F.concat(lit("page"), s("p")).alias("src_path"), "target")


define("page_imports", """
SELECT 'web' AS repo, 'page' || page_id AS src_path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
define("word_files", """
SELECT DISTINCT 'web' AS repo, 'dir/' || w || '.ts' AS path, w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)""")


def word_files(t):
    from ..functions.text import captures

    words = B.dealt(t.documents, "source", "doc_id").select(F.explode(captures(F.col("text"), "([A-Za-z]+)")).alias("w")).distinct()
    return words.select(lit("web").alias("repo"), F.concat(lit("dir/"), "w", lit(".ts")).alias("path"))


@query("dead_files", with_sql("page_imports word_files", """
SELECT repo, path FROM word_files WHERE 'dir/' || w NOT IN (SELECT target FROM page_imports) AND w NOT IN (SELECT regexp_extract(target, '([^/]*)$', 1) FROM page_imports WHERE contains(target, '/'))"""))
def dead_files(t):
    return IM.dead_files(word_files(t), page_imports(t))


@query("dependents", with_sql("page_imports", "SELECT DISTINCT repo, src_path FROM page_imports WHERE target = '/the'"))
def dependents(t):
    return IM.dependents(page_imports(t), "/the")


@query("module_coupling", with_sql("page_imports", """
SELECT m AS module, count(DISTINCT src_path) AS imported_by FROM page_imports JOIN (VALUES ('the'), ('and'), ('la'), ('die'), ('ion')) v(m) ON contains(target, m) GROUP BY 1"""))
def module_coupling(t):
    return IM.coupling(page_imports(t), ["the", "and", "la", "die", "ion"])


@query("module_coupling_by_table", with_sql("page_imports", """
, m AS (SELECT DISTINCT regexp_extract(target, '([^/]*)$', 1) AS module FROM page_imports),
u AS (SELECT DISTINCT src_path, target FROM page_imports)
SELECT module, count(DISTINCT src_path) AS imported_by FROM m JOIN u ON contains(target, module) WHERE module <> '' GROUP BY 1"""))
def module_coupling_by_table(t):
    """Every last segment of an import as a module name."""
    from ..sources.files import base_name

    imports = page_imports(t)
    return IM.coupling(imports, imports.select(base_name(F.col("target")).alias("module")).distinct())


define("bare", r"""
SELECT DISTINCT repo, path FROM code_files f WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches(path, '\.(test|spec)\.(ts|tsx)$|\.(test|spec)\.js$')
 AND NOT EXISTS (SELECT 1 FROM code_files g WHERE g.repo = f.repo AND regexp_matches(g.path, '\.(test|spec)\.(ts|tsx)$|\.(test|spec)\.js$') AND regexp_replace(regexp_replace(g.path, '\.[^./]+$', ''), '\.(test|spec)$', '') = regexp_replace(f.path, '\.[^./]+$', ''))""", ("code_files",))


@query("untested_files", with_sql("bare", "SELECT repo, path FROM bare"))
def untested_files(t):
    return IM.untested(B.code_files(t)).distinct()


@query("tested_ratio", with_sql("code_files bare", r"""
, n AS (SELECT repo, count(*) AS sources FROM code_files WHERE regexp_matches(path, '\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches(path, '\.(test|spec)\.(ts|tsx)$|\.(test|spec)\.js$') GROUP BY 1),
u AS (SELECT f.repo, count(*) AS u FROM code_files f JOIN bare b ON b.repo = f.repo AND b.path = f.path GROUP BY 1)
SELECT n.repo, sources, coalesce(u, 0) AS untested, floor((sources - coalesce(u, 0))::DOUBLE / sources::DOUBLE * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::DOUBLE / 100::DOUBLE AS tested_ratio FROM n LEFT JOIN u USING (repo)"""))
def tested_ratio(t):
    return IM.tested_ratio(B.code_files(t))


# --- reports and records -------------------------------------------------------------


@query("bundle_modules", """
SELECT 'b' || p_partkey AS build, n AS name, z AS size, floor(z * 0.3::DOUBLE + 0.5::DOUBLE)::BIGINT AS gzip_size FROM (
 SELECT p_partkey, 'main.js' AS n, p_size * 1001::BIGINT AS z FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'alt.css', 0 FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT p_partkey, 'chunk.js', p_size * 77::BIGINT FROM part WHERE p_partkey % 2 = 1)""")
def bundle_modules(t):
    z = F.col("p_size")
    web = F.concat(lit('{"assets":[{"name":"main.js","size":'), s(z * 1001), lit('},{"filename":"alt.css"},{"size":9}]}'))
    vite = F.concat(lit('{"output":[{"fileName":"chunk.js","size":'), s(z * 77), lit("}]}"))
    return SR.read_bundles(B.dealt(t.part, "p_partkey").select(F.concat(lit("b"), s("p_partkey")).alias("repo"), F.when(F.col("p_partkey") % 2 == 0, web).otherwise(vite).alias("content")))


@query("lighthouse_metrics", """
SELECT 's' || s_suppkey AS repo, 'Performance' AS name, ('0.' || (s_suppkey % 90 + 10))::DOUBLE AS score, floor(('0.' || (s_suppkey % 90 + 10))::DOUBLE * 100::DOUBLE + 0.5::DOUBLE)::BIGINT::VARCHAR AS display FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'seo', 1.0, '100' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'FCP', 0.5, (s_suppkey % 5) || ' s' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'speed-index', 0.25, '' FROM supplier""")
def lighthouse_metrics(t):
    k = F.col("s_suppkey")
    text = F.concat(lit('{"categories":{"perf":{"title":"Performance","score":0.'), s(k % 90 + 10), lit('},"seo":{"score":1}},"audits":{"first-contentful-paint":{"title":"FCP","score":0.5,"displayValue":"'), s(k % 5),
                    lit(' s"},"speed-index":{"score":0.25},"interactive":{"score":null},"other":{"score":1}}}'))
    return SR.read_lighthouse(t.supplier.select(F.concat(lit("s"), s("s_suppkey")).alias("repo"), text.alias("content")))


def adr_files(t):
    k = F.col("c_custkey")
    text = F.concat(
        F.when(k % 2 == 0, F.concat(lit("# "), s(k), lit(". Use "), "c_mktsegment", lit("  \n\n"))).otherwise(lit("intro\n")), lit("**Status:** "), pick(["Accepted", "proposed", "Deprecated by X", "superseded", "odd"], k % 5),
        lit("\n**Date:** 2024-01-02\n"), F.when(k % 3 == 0, F.concat(lit("This Supersedes decision ADR-"), s(k - 1), lit("\n"))).otherwise(""))
    return B.dealt(t.customer, "c_custkey").select(F.col("c_mktsegment").alias("repo"), F.concat(lit("docs/adr/"), F.when(k % 11 == 0, "x").otherwise(""), F.when(F.length(s(k)) < 4, F.lpad(s(k), 4, "0")).otherwise(s(k)), lit("-use-it-now.md")).alias("path"), text.alias("content"))


define("adrs", """
SELECT c_mktsegment AS repo, c_custkey::INT AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Use ' || c_mktsegment ELSE 'use it now' END AS title, ['accepted', 'proposed', 'deprecated', 'superseded', 'proposed'][(c_custkey % 5)::INT + 1] AS status, '2024-01-02' AS date,
 CASE WHEN c_custkey % 3 = 0 THEN (c_custkey - 1)::INT END AS supersedes FROM customer WHERE c_custkey % 11 <> 0 AND length(c_custkey::VARCHAR) <= 4""")


@query("decision_records", with_sql("adrs", "SELECT * FROM adrs"))
def decision_records(t):
    return SR.read_adrs(adr_files(t))


@query("decision_record_edges", with_sql("adrs", "SELECT repo, id, supersedes FROM adrs WHERE supersedes IS NOT NULL"))
def decision_record_edges(t):
    return SR.adr_edges(SR.read_adrs(adr_files(t)))


@query("memory_notes", r"""
SELECT source AS repo, 'n' || doc_id AS name, left(CASE WHEN doc_id % 2 = 0 THEN 'Note ' || doc_id ELSE regexp_replace(regexp_extract(text, '^(.+)', 1), '^\s+|\s+$', '', 'g') END, 200) AS description FROM documents WHERE contains(lower('n' || doc_id || ' ' || text || CASE WHEN doc_id % 2 = 0 THEN ' # Note ' || doc_id ELSE '' END), 'the')""")
def memory_notes(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", lit("\n# Note "), s("doc_id"))).otherwise(F.col("text"))
    docs = SR.read_memory_docs(t.documents.select(F.col("source").alias("repo"), F.concat(lit("m/n"), s("doc_id"), lit(".md")).alias("path"), text.alias("content")))
    return SR.search_docs(docs, "The").drop("content")


@query("deferred_bugs", """
SELECT 'c' || c_custkey AS repo, p AS pos, '{"id":' || (c_custkey + p) || '}' AS item FROM customer, (VALUES (0), (1)) v(p) WHERE c_custkey % 5 <> 4 AND c_custkey % 5 <> 3""")
def deferred_bugs(t):
    k = F.col("c_custkey")
    rows = F.concat(lit('[{"id":'), s(k), lit('},{"id":'), s(k + 1), lit("}]"))
    text = (F.when(k % 5 == 0, rows).when(k % 5 == 1, F.concat(lit('{"bugs":'), rows, lit("}"))).when(k % 5 == 2, F.concat(lit('{"items":'), rows, lit("}")))
            .when(k % 5 == 3, '{"other":1}').otherwise("{bad"))
    return SR.read_deferred_bugs(t.customer.select(F.concat(lit("c"), s(k)).alias("repo"), text.alias("content")))
