"""Patterns of the project profile and library alternatives.

Fixed values: results depend on these exact patterns, ratios and names.
"""

# Counted per file; the pattern applies to the whole text.
COUNTS = {
    "default_imports": (r"(?m)^import\s+[A-Za-z_$][\w$]*\s+from\s+", r"(?m)^import\s+\*\s+as\s+"),
    "named_imports": (r"(?m)^import\s+\{[\s\S]*?\}\s+from\s+",),
    "try_catch": (r"\btry\s*\{",),
    "callback": (r"\(err(?:or)?\s*(?:,|\))", r"\b(?:err|error)\s*=>"),
    "result_type": (r"\bResult\b", r"\bOk\b|\bErr\b", r"\bEither\b"),
    "function_components": (r"\bfunction\s+[A-Z][a-zA-Z0-9]*\s*\(",),
    "class_components": (r"\bclass\s+[A-Z][a-zA-Z0-9]*",),
    "describe_it": (r"\bdescribe\s*\(", r"\bit\s*\("),
    "test_global": (r"\btest\s*\(",),
    "asserts": (r"\bassert\s*\.", r"\bexpect\s*\(", r"\bassert\s*\("),
}
ARROW_COMPONENT = r"\bconst\s+[A-Z][a-zA-Z0-9]*\s*=\s*(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"
ARROW_EXTENSIONS = (".tsx", ".jsx")

# Names feeding the naming statistics.
CLASS_NAME = r"\bclass\s+([A-Z][a-zA-Z0-9]+)\b"
NAME_PATTERNS = (
    r"\bfunction\s+([a-zA-Z_$][\w$]+)\b",
    r"\b(?:const|let|var)\s+([a-zA-Z_$][\w$]*)\s*[=:]",
    r"\bexport\s+(?:const|let|var|function|class|interface|type)\s+([a-zA-Z_$][\w$]*)",
)
STYLES = ("PascalCase", "camelCase", "snake_case", "kebab-case", "UPPER_CASE", "unknown")

# Top folders that speak for a layout.
FEATURE_DIR = r"(?i)^(users|orders|auth|payments|products|carts|admin|api|modules|features|domains)"
TYPE_DIR = r"(?i)^(components|services|utils|hooks|helpers|middlewares|controllers|models|views|templates)"

# Preferred library -> its alternatives.
ALTERNATIVES = {
    "lodash": ("lodash-es",), "moment": ("date-fns", "dayjs"), "axios": ("fetch", "ky"),
    "express": ("fastify", "hono"), "redux": ("zustand", "jotai"),
    "styled-components": ("tailwindcss", "css-modules"), "enzyme": ("@testing-library/react",),
    "mocha": ("vitest", "jest"), "chai": ("vitest", "jest"), "sinon": ("vitest", "jest"),
    "request": ("node-fetch", "undici"), "bluebird": ("native-promise",),
}

# Test files, and deductions of the consistency score.
TEST_FILE = (
    r"\.(test|spec|e2e|integration)\.(ts|js|tsx|jsx)$|\.(test|spec)\.(py|go|rs)$|^test_|_test\.(go|rs)$"
)
DEDUCTIONS = {"error": 15, "warning": 5, "info": 1}
FULL_AGE_DAYS = 7
