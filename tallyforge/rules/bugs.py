"""Line rules for bug and risk patterns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    pattern: str
    languages: tuple[str, ...]
    active: bool = True
    fix: str = ""
    ignore_case: bool = False


_WIDE = ("ts", "js", "java", "kt", "go", "rs", "cpp", "py", "rb", "php")

# Rule ids, categories, severities, patterns and languages.
RULES = (
    Rule("null-nullable-no-check", "null-safety", "critical",
         r"\b(\w+)(\.\w+)+\b(?!\s*\?\.)(?<![?!])", ("ts", "js", "kt", "swift"), False,
         "guard the value or use ?."),
    Rule("null-bang-without-guard", "null-safety", "high", r"\b\w+!\s*\.", ("ts",), True,
         "guard the value instead of asserting"),
    Rule("null-assign-nullable-to-nonnull", "null-safety", "high",
         r"const\s+\w+\s*[=:]\s*\w+\??\.", ("ts", "js", "kt"), True, "give a default with ??"),
    Rule("err-empty-catch", "error-handling", "medium", r"catch\s*\([^)]*\)\s*\{\s*\}",
         ("ts", "js", "java", "kt", "cpp", "swift", "rb", "php"), True, "log or rethrow"),
    Rule("err-promise-without-catch", "error-handling", "high",
         r"\.then\s*\([^)]*\)\s*(?!\s*\.\s*catch\b)", ("ts", "js"), False, "add a rejection handler"),
    Rule("err-async-without-try", "error-handling", "medium",
         r"async\s+(?:function\s+\w+\s*)?\([^)]*\)\s*\{[^}]*(?!try)", ("ts", "js", "py"), False,
         "wrap the awaits in try/catch"),
    Rule("err-throw-literal", "error-handling", "medium",
         r"throw\s+(['\"`]|\d+|null\b|undefined\b)", ("ts", "js", "java", "kt", "cpp"), True,
         "throw an Error object"),
    Rule("bnd-array-index-without-length", "boundary", "high", r"\b\w+\[\s*\w+\s*\]", _WIDE, False,
         "check the length first"),
    Rule("bnd-division-without-zero-guard", "boundary", "critical", r"\b\w+\s*\/\s*\w+\b", _WIDE,
         False, "check the divisor"),
    Rule("bnd-substring-without-length", "boundary", "medium",
         r"\.substring\s*\(|\.substr\s*\(|\.slice\s*\(", ("ts", "js", "java", "kt"), True,
         "clamp the bounds"),
    Rule("sec-sql-concatenation", "security", "critical",
         r"(?:query|execute|run)\s*\(\s*[`'\"]\s*\+\s*",
         ("ts", "js", "py", "rb", "php", "java", "go"), True, "bind parameters"),
    Rule("sec-eval-usage", "security", "critical", r"\beval\s*\(|\bnew\s+Function\s*\(",
         ("ts", "js", "py"), True, "parse instead of evaluating"),
    Rule("sec-innerhtml", "security", "critical",
         r"\.innerHTML\s*=|\.outerHTML\s*=|\.insertAdjacentHTML\s*\(",
         ("ts", "js", "tsx", "jsx"), True, "assign text or sanitise"),
    Rule("sec-hardcoded-secret", "security", "critical",
         r"(?:api[_-]?key|apikey|secret|password|token|credential)\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}['\"]",
         ("ts", "js", "py", "go", "rs", "java", "rb", "php"), True, "read it from the environment", True),
    Rule("async-callback-without-error", "async", "medium",
         r"\bcb\s*\([^)]*\w+\s*\)|\bcallback\s*\([^)]*\w+\s*\)", ("ts", "js"), True,
         "pass the error first"),
    Rule("async-missing-await", "async", "high",
         r"(?:await\s+)?\b\w+\s*=\s*\w+\([^)]*\)\s*;\s*\n\s*\w+\.(?:then|catch|finally)\b(?!.*\bawait\b)",
         ("ts", "js"), True, "await the call"),
    Rule("async-promise-in-promise", "async", "low",
         r"new\s+Promise\s*\([^)]*\)[^;]*\bnew\s+Promise\b", ("ts", "js"), True, "chain instead of nesting"),
    Rule("perf-nested-loops", "performance", "low",
         r"(?:for\s*\([^)]+\)[\s\S]*?for\s*\(|forEach\s*\([^)]*\)[\s\S]*?forEach\s*\()", _WIDE, True,
         "look values up in a map"),
    Rule("perf-large-array-spread", "performance", "low",
         r"\[\s*\.\.\.\s*\w+\s*,\s*\.\.\.\s*\w+", ("ts", "js", "tsx", "jsx"), True,
         "append instead of copying"),
)
