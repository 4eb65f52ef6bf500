"""Line and file scanners: flags, query and async risks, events, permissions, migrations,
hard-coded strings, keyword search. All are single passes over lines or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rx import ascii_bounds
from ..functions.text import captures, kebab
from .history import distinct_first
from .match import strip

# Flag patterns as (regex, capture group with the name; 0 = whole match).
FLAG_PATTERNS = (
    (r"(?i)(?:feature|flag|toggle|experiment|FF)_[A-Z0-9_]+", 0),
    (r"featureFlag\[['\"]?([^'\"\]]+)['\"]?\]", 1),
    (r"flags?\.(?:isEnabled|isActive|getValue)\(['\"]([^'\"]+)['\"]\)", 1),
    (r"process\.env\.(?:NEXT_PUBLIC_)?FF_", 0),
    (r"(?i)LaunchDarkly|Unleash|Flagsmith|splitio", 0),
)
FLAG_OFF = r"(?i)false|disabled|off|0"
FLAG_ON = r"(?i)true|enabled|on|1"

# Query calls and loop signs.
QUERY_CALLS = (
    ("findMany", r"\.findMany\s*\("), ("find", r"\.find\w*\s*\("), ("query", r"\.query\s*\("),
    ("aggregate", r"\.aggregate\s*\("),
)
LOOP_SIGN = r"(?i)(?:for|while|forEach|\.map\s*\(|Promise\.all)"

# Async risk signs.
CATCH_SIGNS = (r"catch\s*\(", r"\.catch\s*\(")
PROMISE_SIGNS = (r"Promise\s*\(", r"new Promise", r"\.then\s*\(")

# Event roles.
EMIT_SIGNS = (r"\.emit\s*\(", r"\.publish\s*\(", r"EventEmitter")
LISTEN_SIGNS = (r"\.on\s*\(", r"\.subscribe\s*\(", r"\.addListener\s*\(", r"\.once\s*\(")

# Permission assignments, and words of risky names.
PERMISSION_PATTERNS = (
    r"(?i)(?:permission|scope|role)[s:]?\s*[:=]\s*[\"']([^\"']+)[\"']",
    r"(?i)(?:can|allow|grant|access)\s*[:=]\s*[\"']([^\"']+)[\"']",
)
PERMISSION_FILE = r"(?i)\.(ts|js|json|yaml|yml|toml)$"

# Structural weights of a SQL migration.
MIGRATION_WEIGHTS = (
    (r"(?i)ALTER\s+TABLE", 2),
    (r"(?i)CREATE\s+(?:INDEX|TRIGGER|FUNCTION|PROCEDURE)", 3),
    (r"(?i)DROP\s+(?:TABLE|INDEX|COLUMN)", 2),
    (r"(?i)FOREIGN\s+KEY", 1),
)

# Texts that are never user-facing.
SKIP_STRINGS = (
    r"^import\s", r"^(from|require)\s", r"^https?://", r"^//", r"^[./]", r"(?i)\.[a-z]{2,4}$",
    r"^@[a-z0-9-]+/", r"^[a-z0-9-]+/[a-z0-9-]+", r"^node:",
    r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s", r"(?i)^[a-z_$][a-z0-9_$]*$",
    r"^[A-Z][A-Z_0-9]+$", r"^\d", r"(?i)^[a-z][a-z0-9]+$",
    r"(?i)^(TODO|FIXME|HACK|XXX|WORKAROUND):", r"^[<>]", r"^['\"`]",
)
QUOTED_TEXT = r"([\"'`])([A-Z][a-zA-Z\s,;:!?']{10,})\1"
SPOKEN_TEXT = (
    r"(?:console\.(?:log|message|warn|error|info|debug)|throw)\s*\(?\s*([\"'`])([A-Z][\s\S]*?)\1"
)
MARKUP_LINE = r"</?[A-Z][a-zA-Z]*\b|>[\s\S]*</"


def _count_matching(text: Column, patterns: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(p).cast("int")
    return total


def flag_sightings(lines: DataFrame) -> DataFrame:
    """(repo, path, line, seq, flag, enabled) for every flag mention."""
    text = F.col("text")
    found = F.concat(*[captures(text, p, g) for p, g in FLAG_PATTERNS])
    enabled = ~text.rlike(FLAG_OFF) & text.rlike(FLAG_ON)
    return lines.select(
        "repo", "path", "line", enabled.alias("enabled"), F.posexplode(found).alias("seq", "flag")
    )


def feature_flags(lines: DataFrame) -> DataFrame:
    """Per flag: mentions, files, and whether its first sighting looks enabled."""
    return flag_sightings(lines).groupBy("flag").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.countDistinct("repo", "path").alias("files"),
        F.min_by("enabled", F.struct("repo", "path", "line", "seq")).alias("enabled"),
    )


def nplus1_risks(lines: DataFrame) -> DataFrame:
    """Query calls on a line that also shows a loop: (repo, path, line, pattern)."""
    text = F.col("text")
    calls = F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in QUERY_CALLS])
    return (
        lines.where(text.contains(".") & text.rlike(LOOP_SIGN))
        .select("repo", "path", "line", F.explode(calls).alias("pattern"))
        .where(F.col("pattern").isNotNull())
    )


def lines_ahead(files: DataFrame, n: int = 5) -> DataFrame:
    """Lines with ``ahead``: the line and its n-1 successors joined; built inside the row."""
    split = files.withColumn("_ls", F.split("content", "\n"))
    row = F.transform(
        "_ls",
        lambda x, i: F.struct(
            (i + 1).alias("line"), x.alias("text"),
            F.array_join(F.slice(F.col("_ls"), i + 1, n), "\n").alias("ahead"),
        ),
    )
    return split.select("repo", "path", F.explode(row).alias("_r")).select("repo", "path", "_r.*")


def async_risks(files: DataFrame) -> DataFrame:
    """risky_catch and unhandled_promise lines: (repo, path, line, risk, hits)."""
    text, ahead = F.col("text"), F.col("ahead")
    catches = F.when(
        text.contains("{}") | text.rlike(r"catch\s*\)"), _count_matching(text, CATCH_SIGNS)
    ).otherwise(0)
    promises = F.when(
        ~text.contains(".catch") & ~text.contains("await") & ~ahead.contains(".catch"),
        _count_matching(text, PROMISE_SIGNS),
    ).otherwise(0)
    kinds = F.array(
        F.struct(F.lit("risky_catch").alias("risk"), catches.alias("hits")),
        F.struct(F.lit("unhandled_promise").alias("risk"), promises.alias("hits")),
    )
    return (
        lines_ahead(files, 5)
        .select("repo", "path", "line", F.explode(kinds).alias("_k"))
        .select("repo", "path", "line", "_k.risk", "_k.hits")
        .where(F.col("hits") > 0)
    )


def event_sites(lines: DataFrame) -> DataFrame:
    """Emitter and listener sites: (repo, path, line, event, emits, listens)."""
    text = F.col("text")
    name = F.regexp_extract(text, r"['\"]([^'\"]+)['\"]", 1)
    return lines.select(
        "repo", "path", "line", name.alias("event"),
        _count_matching(text, EMIT_SIGNS).alias("emits"),
        _count_matching(text, LISTEN_SIGNS).alias("listens"),
    ).where((F.col("event") != "") & ((F.col("emits") > 0) | (F.col("listens") > 0)))


def event_map(lines: DataFrame) -> DataFrame:
    """Emitters and listeners per event name."""
    return event_sites(lines).groupBy("event").agg(
        F.sum("emits").cast("bigint").alias("emitters"),
        F.sum("listens").cast("bigint").alias("listeners"),
        F.countDistinct("repo", "path").alias("files"),
    )


def permission_risk(name: Column) -> Column:
    low = F.lower(name)
    high = low.contains("admin") | low.contains("root") | low.contains("superuser") | low.contains("*") | (low == "all")
    medium = low.contains("write") | low.contains("delete") | low.contains("manage")
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def permission_sites(files: DataFrame) -> DataFrame:
    """Distinct (permission, repo, path) of config and script files, whatever their size."""
    content = F.col("content")
    scripts = files.where(F.col("path").rlike(PERMISSION_FILE))
    names = F.concat(*[captures(content, p) for p in PERMISSION_PATTERNS])
    return scripts.select("repo", "path", F.explode(names).alias("permission")).distinct()


def permission_audit(files: DataFrame) -> DataFrame:
    """Files per permission with its risk."""
    return (
        permission_sites(files).groupBy("permission").agg(F.count(F.lit(1)).alias("files"))
        .withColumn("risk", permission_risk(F.col("permission")))
    )


def migration_complexity(files: DataFrame) -> DataFrame:
    """Size, statements, structural score and rating of SQL files."""
    content = F.col("content")
    # possessive, or the engine takes a stack frame for each character of a quoted text
    bare = F.regexp_replace(content, r"'(?:[^'\\]++|\\.)*+'", "")
    bare = F.regexp_replace(bare, r"\"(?:[^\"\\]++|\\.)*+\"", "")
    score = F.col("statements")
    for pattern, w in MIGRATION_WEIGHTS:
        score = score + F.regexp_count(content, F.lit(pattern)) * w
    small = (F.col("score") <= 5) & (F.col("size") <= 2000)
    middle = (F.col("score") <= 15) & (F.col("size") <= 10000)
    return (
        files.where(F.col("path").rlike(r"(?i)\.sql$"))
        .withColumn("size", F.length(content))
        .withColumn("statements", F.regexp_count(bare, F.lit(";")))
        .withColumn("score", score)
        .select("repo", "path", "size", "statements", "score",
                F.when(small, "low").when(middle, "medium").otherwise("high").alias("complexity"))
    )


def keyword_search(lines: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """Lines containing the text, ignoring case, with a 200-character snippet; with ``k`` the first k in order."""
    found = (
        lines.where(F.contains(F.lower("text"), F.lit(query.lower())))
        .select("repo", "path", "line", F.left(strip(F.col("text")), F.lit(200)).alias("content"))
    )
    return found if k is None else found.orderBy("repo", "path", "line").limit(k)


def hardcoded_candidates(files: DataFrame) -> DataFrame:
    """Every candidate text with its place: (repo, path, line, kind, seq, value, context, key).

    kind 0 = between markup tags outside code blocks, 1 = spoken by console/throw, 2 = quoted
    sentence on lines that speak nothing. The code-block state looks at the ten lines above.
    """
    split = files.withColumn("_ls", F.split("content", "\n")).withColumn(
        "_tagged", F.contains("content", F.lit("<code")))

    def in_code(x: Column, i: Column) -> Column:
        above = F.slice(F.col("_ls"), F.greatest(i - 9, F.lit(1)), F.least(i, F.lit(10)))
        opened = F.aggregate(
            above, F.lit(False),
            lambda acc, line: F.when(line.contains("</code>"), F.lit(False))
            .when(line.rlike(r"<code[\s>]"), F.lit(True)).otherwise(acc),
        )
        return F.when(F.col("_tagged"), x.rlike(r"<code[\s>]") | opened).otherwise(F.lit(False)) | x.contains("</code>")

    row = F.transform(
        "_ls", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), in_code(x, i).alias("code"))
    )
    lines = split.select("repo", "path", F.explode(row).alias("_r")).select("repo", "path", "_r.*")
    text = F.col("text")
    spoken = F.col("_spoken")

    def tagged(values: Column, kind: int) -> Column:
        # stripped before the explode, so that the skip tests read a finished column
        return F.transform(
            values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("seq"), strip(v).alias("value")))

    markup = F.when(
        text.contains("<") & ~F.col("code") & text.rlike(ascii_bounds(MARKUP_LINE)),
        F.filter(F.transform(captures(text, r">([^<]+)<"), strip), lambda v: v != ""),
    ).otherwise(F.array().cast("array<string>"))
    said = F.when(spoken, F.array(F.regexp_extract(text, SPOKEN_TEXT, 2))).otherwise(
        F.array().cast("array<string>")
    )
    quoted = F.when(~spoken, captures(text, QUOTED_TEXT, 2)).otherwise(F.array().cast("array<string>"))
    skip = F.length("value") <= 15
    for p in SKIP_STRINGS:
        skip = skip | F.col("value").rlike(p)
    return (
        lines.withColumn("_spoken", (text.contains("console.") | text.contains("throw")) & text.rlike(SPOKEN_TEXT))
        .select("repo", "path", "line", F.left(strip(text), F.lit(120)).alias("context"),
                F.explode(F.concat(tagged(markup, 0), tagged(said, 1), tagged(quoted, 2))).alias("_c"))
        .select("repo", "path", "line", "_c.kind", "_c.seq", "_c.value", "context")
        .where(~skip)
        .withColumn("key", kebab(F.col("value")))
    )


def hardcoded_strings(files: DataFrame) -> DataFrame:
    """User-facing texts, one row per (repo, key): the first sighting."""
    order = [F.col(c) for c in ("path", "line", "kind", "seq")]
    return distinct_first(hardcoded_candidates(files), ["repo", "key"], order)
