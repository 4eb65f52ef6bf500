"""Debt comment dialects, classification patterns and ageing bands.

Fixed values: results depend on these exact tags, patterns and weights.
"""

# Tags per dialect.
TODO_TAGS = ("TODO", "FIXME", "HACK", "NOTE", "XXX", "FOR NOW", "TEMP", "WIP", "TBD")
DEBT_TAGS = (
    "TODO", "FIXME", "HACK", "XXX", "OPTIMIZE", "REVIEW", "SECURITY", "PERF", "WORKAROUND",
    "KLUDGE", "TEMP", "WIP", "TBD",
)
INLINE_TAGS = (
    "TODO", "FIXME", "HACK", "XXX", "OPTIMIZE", "SECURITY", "WORKAROUND", "KLUDGE", "TEMP", "WIP",
)

# Severity weights of the debt score.
SEVERITY_WEIGHTS = {"critical": 10, "major": 5, "minor": 1}

# Debt types in order, each with its patterns (two points per match).
TYPE_PATTERNS = {
    "bug": (
        r"\b(bug|buggy|broken|crash|error|fails?|wrong|incorrect|fixme)\b",
        r"\b(not work|doesn't work|unexpected|glitch|malfunction)\b",
        r"\b(hotfix|workaround|patch|issue|problem|fault)\b",
        r"\b(null|undefined|exception|throw|fail)\b",
    ),
    "security": (
        r"\b(security|secure|vuln|cve|xss|csrf|sqli|injection|sanitize)\b",
        r"\b(escape|validate input|auth|authorization|permission|sensitive)\b",
        r"\b(encrypt|decrypt|hash|password|token|secret|key)\b",
        r"\b(SECURITY|SEC|CWE|OWASP)\b",
    ),
    "performance": (
        r"\b(perform|slow|fast|speed|optimize|bottleneck|latency|n\+1)\b",
        r"\b(cache|memoize|lazy|debounce|throttle|timeout|async)\b",
        r"\b(memory|leak|cpu|disk|io|network|expensive|heavy)\b",
        r"\b(PERF|OPTIMIZE|OPT|EFFICIENCY)\b",
    ),
    "refactor": (
        r"\b(refactor|cleanup|duplicate|redundant|mess|legacy)\b",
        r"\b(tech.debt|works but|ugly|hack|kludge|workaround|temp)\b",
        r"\b(HACK|TEMP|WIP|TBD|TODO|XXX|simplify|extract|split)\b",
        r"\b(magic.number|hardcoded|coupling|cohesion|spaghetti)\b",
    ),
    "documentation": (
        r"\b(doc|comment|document|readme|README|api.doc|jsdoc)\b",
        r"\b(explain|clarify|describe|note|example|usage)\b",
        r"\b(why|how|what|missing doc|undocumented|incomplete)\b",
    ),
    "enhancement": (
        r"\b(feature|enhance|improve|better|support|add|future)\b",
        r"\b(should|could|would|need to|want|nice.to.have|todo)\b",
        r"\b(implement|wire.up|integrate|connect|expose|allow)\b",
    ),
}

# Severities in order, each with its patterns (one point per match).
SEVERITY_PATTERNS = {
    "critical": (
        r"\b(critical|urgent|blocker|crash|security|data.loss|data loss)\b",
        r"\b(immediate|asap|ASAP|P0|P-0|showstopper|production)\b",
        r"\b(FIXME|fix.me|broken|vuln|exploit|downtime)\b",
    ),
    "major": (
        r"\b(major|important|should fix|significant|high)\b",
        r"\b(P1|P-1|bug|error|refactor|cleanup|slow)\b",
        r"\b(need to|must|required|necessary|essential)\b",
    ),
    "minor": (
        r"\b(minor|trivial|cosmetic|nit|style|cosmetic)\b",
        r"\b(nice.to.have|optional|maybe|could|suggestion)\b",
        r"\b(P2|P-2|P3|polish|typo|format|rename|TODO)\b",
    ),
}

# Type favoured (three points) by a leading tag.
PREFIX_TYPES = {
    "FIXME": "bug", "SECURITY": "security", "PERF": "performance", "OPTIMIZE": "performance",
    "REVIEW": "refactor", "HACK": "refactor", "XXX": "refactor",
}

# Fixed values: (prefixes, type, severity) used when no type pattern matches.
PREFIX_DEFAULTS = (
    (("FIXME",), "bug", "major"),
    (("SECURITY", "SEC"), "security", "critical"),
    (("PERF", "OPTIMIZE"), "performance", "major"),
    (("HACK", "KLUDGE", "WORKAROUND"), "refactor", "major"),
    (("TODO",), "enhancement", "minor"),
)

# Ageing bands by upper bound in days, and the last band.
AGE_BANDS = ((30, "normal"), (90, "validate"), (180, "yellow"))
AGE_LAST = "must_fix"
