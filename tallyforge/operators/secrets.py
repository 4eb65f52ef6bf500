"""Secret findings: token formats, key/value rule, entropy, hidden base64, path risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import half_up
from ..functions.text import captures, shannon_entropy
from ..rules import secrets as R


def path_risk(path: Column) -> Column:
    out = F.lit(R.OTHER_PATH_RISK)
    for pattern, risk in reversed(R.PATH_RISK):
        out = F.when(path.rlike(pattern), risk).otherwise(out)
    return out


def entropy_score(bits: Column) -> Column:
    low = bits / F.lit(R.HIGH_BITS) * F.lit(R.ENTROPY_LOW_SCORE)
    out = low
    for bound, score in reversed(R.ENTROPY_SCORES):
        out = F.when(bits > bound, score).otherwise(out)
    return out


def decoded(token: Column) -> Column:
    """UTF-8 text hidden in a base64 token, null when it is none."""
    shape = token.rlike(R.BASE64_PATTERN) & (F.length(token) % 4 == 0)
    return F.when(shape, F.try_validate_utf8(F.try_to_binary(token, F.lit("base64")).cast("string")))


def _looks_secret(text: Column) -> Column:
    hit = F.lit(False)
    for p in R.TOKEN_PATTERNS.values():
        hit = hit | (F.size(captures(text, f"({p})")) > 0)
    return hit


def secret_findings(lines: DataFrame) -> DataFrame:
    """(repo, path, line, type, token, entropy, hidden, score, severity) per candidate.

    UUIDs and bare hashes in commit context are left out; a key/value token whose decoded
    base64 meets two of (random, has a colon, is a known format) is marked hidden.
    """
    text = F.col("text")
    token = F.col("token")

    def typed(values: Column, name: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("type"), v.alias("token")))

    groups = [typed(captures(text, f"({p})"), name) for name, p in R.TOKEN_PATTERNS.items()]
    groups.append(typed(captures(text, R.KEY_VALUE_PATTERN), "generic_secret"))
    hash_in_commit = token.rlike(R.HASH_PATTERN) & F.lower(text).contains("commit")
    plain = decoded(token)
    signs = (
        F.coalesce((shannon_entropy(F.col("_plain")) > R.HIGH_BITS).cast("int"), F.lit(0))
        + F.coalesce(F.col("_plain").contains(":").cast("int"), F.lit(0))
        + F.coalesce(_looks_secret(F.col("_plain")).cast("int"), F.lit(0))
    )
    pattern_match = F.when((F.col("type") != "generic_secret") | F.col("hidden"), 1.0).otherwise(0.5)
    score = (
        entropy_score(F.col("bits")) * R.WEIGHTS["entropy"]
        + pattern_match * R.WEIGHTS["pattern"]
        + path_risk(F.col("path")) * R.WEIGHTS["context"]
    )
    band = F.lit("LOW")
    for bound, name in reversed(R.BANDS):
        band = F.when(F.col("score") >= bound, name).otherwise(band)
    return (
        lines.select("repo", "path", "line", "text", F.explode(F.concat(*groups)).alias("_g"))
        .select("repo", "path", "line", "text", "_g.type", "_g.token")
        .where(~token.rlike(R.UUID_PATTERN) & ~hash_in_commit)
        .withColumn("bits", shannon_entropy(token))
        .withColumn("_plain", plain)
        .withColumn("hidden", signs >= 2)
        .withColumn("score", half_up(score, 4))
        .select("repo", "path", "line", "type", "token", half_up(F.col("bits"), 4).alias("entropy"),
                "hidden", "score", band.alias("severity"))
    )


def secret_summary(findings: DataFrame) -> DataFrame:
    """Findings and files per severity, zero rows kept."""
    levels = findings.sparkSession.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "severity string")
    counts = findings.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("repo", "path").alias("files"))
    return levels.join(counts, "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"))
