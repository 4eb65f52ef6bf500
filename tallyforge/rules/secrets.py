"""Secret formats, entropy thresholds and path risk.

Fixed values: results depend on these exact patterns and numbers.
"""

# Token formats.
TOKEN_PATTERNS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36}\b",
    "jwt": r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*",
    "ssh_key": r"-----BEGIN\s[A-Z]+\sPRIVATE\sKEY-----",
    "slack_token": r"xox[baprs]-[0-9A-Za-z-]{10,72}",
    "pypi_token": r"pypi-AgEIcHlwaS5vcm[0-9A-Za-z_-]{50,150}",
}

# key/value rule; the value is the capture.
KEY_VALUE_PATTERN = (
    r"(?i)(?:api[_-]?key|apikey|secret|password|token|credential)\s*[:=]\s*['\"]([A-Za-z0-9_\-]{16,})['\"]"
)

# Bits per character, and the score each threshold reaches.
ENTROPY_SCORES = ((5.5, 1.0), (4.5, 0.8), (4.2, 0.6))
# below the lowest threshold the score grows linearly up to this value
ENTROPY_LOW_SCORE = 0.5
HIGH_BITS = 4.2

# Severity weights and bands.
WEIGHTS = {"entropy": 0.4, "pattern": 0.3, "context": 0.3}
BANDS = ((0.7, "HIGH"), (0.4, "MEDIUM"))

# Values never reported.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HASH_PATTERN = r"^[0-9a-fA-F]{40,64}$"
BASE64_PATTERN = r"^[A-Za-z0-9+/]{16,}={0,2}$"

# Risk by path, first match wins.
PATH_RISK = (
    (r"(^|/)(dist|node_modules|vendor|generated)/|\.min\.", 0.1),
    (r"(^|/)\.env|(^|/)config/.*prod|credentials", 1.0),
    (r"\.(test|spec)\.|(^|/)(test|tests|fixtures?)/", 0.5),
    (r"\.md$|(^|/)docs/|README", 0.3),
    (r"\.(ts|tsx|py|js|jsx|go|rs|java|rb|php)$", 0.7),
)
OTHER_PATH_RISK = 1.0
