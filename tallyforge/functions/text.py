"""Text column functions: normalisation keys, names, tokens, compaction, entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..rules import words
from .arrays import lookup
from .dates import ISO_STAMP
from .rx import ascii_bounds


def _sub(col: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(col, ascii_bounds(pattern), to)


def squeeze(col: Column) -> Column:
    """Runs of blanks become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


# --- grouping keys -------------------------------------------------------------------


def fingerprint(msg: Column) -> Column:
    """Grouping key of an error: stamps and integers masked, punctuation blanked, lower case.

    Keys shorter than five characters fall back to the first 80 characters of the message.
    """
    key = _sub(msg, ISO_STAMP, "<TS>")
    key = _sub(key, r"\b\d+\b", "<N>")
    key = F.lower(squeeze(F.regexp_replace(key, r"[^\w\s]", " ")))
    return F.when(F.length(key) < 5, F.left(msg, F.lit(80))).otherwise(key)


def failure_key(error: Column) -> Column:
    """Digit runs as 0, first 80 characters."""
    return F.left(F.regexp_replace(error, r"\d+", "0"), F.lit(80))


def pattern_name(key: Column) -> Column:
    """First five words of a failure key as a snake-case name of at most 60 characters."""
    kept = F.split(F.regexp_replace(key, r"[^a-zA-Z0-9 ]", ""), r"\s+")
    name = F.lower(F.array_join(F.slice(kept, 1, 5), "_"))
    return F.left(F.regexp_replace(name, "_+", "_"), F.lit(60))


def escaped_symptom(error: Column) -> Column:
    """First 100 characters of the error text, regex-escaped after the cut."""
    return F.regexp_replace(F.left(error, F.lit(100)), r"([|\\{}()\[\]^$+?.])", r"\\$1")


def topic(text: Column) -> Column:
    """Up to four distinct content words joined by ``_``; URLs, paths, stack frames and ids removed."""
    t = F.regexp_replace(text, r"(?:https?|ftp)://[\n\S]+", " ")
    t = F.regexp_replace(t, r"(?:/[a-zA-Z0-9_.-]+)+", " ")
    t = F.regexp_replace(t, r"at\s+.*:\d+:\d+", " ")
    t = F.regexp_replace(t, r"[a-fA-F0-9-]{16,}", " ")
    t = F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", " ")
    kept = F.filter(
        F.split(t, r"\s+"),
        lambda w: (F.length(w) > 2) & ~w.isin(*words.TOPIC_STOP_WORDS) & ~w.rlike(r"^\d+$"),
    )
    named = F.array_join(F.slice(F.array_distinct(kept), 1, 4), "_")
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("general_operations"))


# --- names ---------------------------------------------------------------------------


def kebab(col: Column) -> Column:
    t = F.regexp_replace(F.trim(col), r"[^a-zA-Z0-9\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-")
    return F.lower(F.regexp_replace(t, "^-|-$", ""))


def slug(col: Column) -> Column:
    """Lower-case, non-alphanumerics as single dashes, no dash at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-"), "^-|-$", "")


def norm_name(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"[^a-z0-9]", "")


def sanitize_id(col: Column) -> Column:
    clean = F.regexp_replace(col, r"[^a-zA-Z0-9_]", "_")
    return F.when(clean.rlike(r"^\d"), F.concat(F.lit("_"), clean)).otherwise(clean)


def naming_style(name: Column) -> Column:
    """First style whose pattern matches, else ``unknown``."""
    out = F.lit("unknown")
    for style, pattern in reversed(list(words.NAMING_STYLES.items())):
        out = F.when(name.rlike(pattern), style).otherwise(out)
    return out


def clean_comment(col: Column) -> Column:
    """Comment text without its opening and closing markers."""
    t = F.regexp_replace(col, r"^\s*(?://|#|<!--?|/\*+|\*+)\s*", "")
    return F.trim(F.regexp_replace(t, r"\s*(?:\*/|-->)?\s*$", ""))


def captures(col: Column, pattern: str, group: int = 1) -> Column:
    """All captures of a group, in text order."""
    return F.regexp_extract_all(col, F.lit(ascii_bounds(pattern)), F.lit(group))


def identifiers(content: Column) -> Column:
    """Distinct declared names: classes, functions, types, then variables."""
    found = [captures(content, p) for p in words.DECLARATION_PATTERNS]
    return F.array_distinct(F.concat(*found))


def imports_of(content: Column) -> Column:
    """Import statements at line starts, trimmed."""
    found = captures(content, r"(?m)(^import\s+[\s\S]*?from\s+['\"][^'\"]+['\"];?)")
    return F.transform(found, lambda x: F.trim(x))


def used_libraries(content: Column) -> Column:
    """Package names in from/require clauses, relative paths excluded, repeats kept."""
    names = F.concat(
        captures(content, r"from\s+['\"]([^'\"/]+)['\"]"),
        captures(content, r"require\s*\(\s*['\"]([^'\"/]+)['\"]"),
    )
    return F.filter(names, lambda n: ~n.startswith(".") & ~n.startswith("/"))


def commit_parts(message: Column) -> Column:
    """struct(valid, type, scope, breaking, subject) of a conventional commit message."""
    first = F.get(F.split(F.trim(message), "\n"), F.lit(0))
    types = "|".join(words.COMMIT_TYPES)
    kind = F.regexp_extract(first, rf"^({types})(?:\(.+\))?!?:\s.+", 1)
    passes = first.rlike(r"^(fixup!|squash!|Merge|merge)")
    return F.struct(
        (passes | (kind != "")).alias("valid"),
        F.nullif(kind, F.lit("")).alias("type"),
        F.nullif(F.regexp_extract(first, rf"^(?:{types})\((.+)\)!?:\s.+", 1), F.lit("")).alias("scope"),
        first.rlike(rf"^(?:{types})(?:\(.+\))?!:\s.+").alias("breaking"),
        F.trim(F.regexp_replace(first, rf"^(?:{types})(?:\(.+\))?!?:\s", "")).alias("subject"),
    )


def prompt_version(path: Column) -> Column:
    """x.y.z found in the path, else a 1.0.0 label made of the markdown file name."""
    semver = F.regexp_extract(path, r"v?(\d+\.\d+\.\d+)", 1)
    name = F.regexp_extract(path, r"[\\/]([^\\/]+?)\.md$", 1)
    return (
        F.when(semver != "", semver)
        .when(name != "", F.concat(F.lit("1.0.0-"), F.regexp_replace(F.lower(name), r"\s+", "-")))
        .otherwise("1.0.0-unversioned")
    )


# --- sizes ---------------------------------------------------------------------------


def human_bytes(n: Column) -> Column:
    """B without decimals, KB/MB/GB with one, powers of 1024."""
    x = n.cast("double")

    def unit(scale: float, name: str) -> Column:
        return F.concat(F.format_string("%.1f", x / F.lit(scale)), F.lit(" " + name))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, unit(1024.0, "KB"))
        .when(n < 1024**3, unit(1024.0**2, "MB"))
        .otherwise(unit(1024.0**3, "GB"))
    )


def size_advice(n_bytes: Column) -> Column:
    """small below 5 KB, split_consider below 15 KB, else split; sizes rounded half-up to KB."""
    kb = F.floor(n_bytes / F.lit(1024.0) + F.lit(0.5))
    return F.when(kb < 5, "small").when(kb < 15, "split_consider").otherwise("split")


# --- tokens and similarity -----------------------------------------------------------


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII tokens longer than two characters."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two token arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common.cast("double") / both
    )


def shannon_entropy(token: Column) -> Column:
    """Bits per character of the character distribution; 0 for empty text."""
    n = F.length(token).cast("double")
    chars = F.array_sort(F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")))

    def add(acc: Column, c: Column) -> Column:
        p = (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double") / n
        return acc - p * F.log2(p)

    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(F.lit(0.0))


# --- compaction ----------------------------------------------------------------------


def code_language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return lookup(words.COMPACTION_LANGUAGES, ext)


def compact_code(content: Column, lang: Column) -> Column:
    """Comments stripped by language family, blank runs collapsed, long identifiers shortened."""
    slashes = F.regexp_replace(
        F.regexp_replace(content, r"(?m)(?<!https?:)//.*$", ""), r"/\*[\s\S]*?\*/", ""
    )
    hashes = F.regexp_replace(content, r"(?m)(?<!['\"])#.*$", "")
    bare = (
        F.when(lang.isin(*words.HASH_COMMENT_LANGUAGES), hashes)
        .when(lang.isNotNull(), slashes)
        .otherwise(content)
    )
    short = F.regexp_replace(bare, r"\n{3,}", "\n\n")
    short = _sub(short, r"\b([a-zA-Z_][a-zA-Z0-9_]{17})[a-zA-Z0-9_]{3,}\b", "$1…")
    return F.when(lang.isNull(), content).otherwise(short)


def compact_prose(content: Column, keep: int = 250) -> Column:
    """First and last ``keep`` lines around a marker when there are more than twice as many."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    marker = F.concat(F.lit("… ["), (n - 2 * keep).cast("string"), F.lit(" lines collapsed]"))
    cut = F.concat(F.slice(lines, 1, keep), F.array(marker), F.slice(lines, -keep, keep))
    return F.when(n > 2 * keep, F.array_join(cut, "\n")).otherwise(content)


def content_type(content: Column, path: Column) -> Column:
    """json when the text opens like JSON and parses, code by extension, else prose."""
    looks = F.trim(content).rlike(r"^[{\[]") & F.try_parse_json(content).isNotNull()
    return (
        F.when(looks, "json").when(code_language(path).isNotNull(), "code").otherwise("prose")
    )


def align_prefix(
    content: Column, project: str, task: Column | None = None, mode: Column | None = None
) -> Column:
    """struct(aligned, prefix_hash): a stable header in front of the text and its 8-digit hash."""
    pieces: list[Column] = [F.lit(f"[PROJECT] {project} | ")]
    if task is not None:
        pieces.append(F.when(task.isNotNull(), F.concat(F.lit("task:"), task, F.lit(" | "))).otherwise(""))
    if mode is not None:
        pieces.append(F.when(mode.isNotNull(), F.concat(F.lit("mode:"), mode, F.lit(" | "))).otherwise(""))
    head = F.concat(*pieces)
    return F.struct(
        F.concat(head, F.lit("\n"), F.ltrim(content)).alias("aligned"),
        F.left(F.sha2(head, 256), F.lit(8)).alias("prefix_hash"),
    )


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True when any literal term occurs in the text."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit
