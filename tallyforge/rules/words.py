"""Word lists, patterns and name tables.

Fixed values: results depend on these exact words and patterns.
"""

# Words that never become part of a topic.
TOPIC_STOP_WORDS = (
    "error failed failure while trying cannot could not during the a an is are was were to from "
    "in on at by for with about against between into through after before of and or but if then "
    "else when where why how all any both each few more most other some such no nor only own same "
    "so than too very can will just should now it this that these those we you they has have had "
    "do does did be been being am as their there here occurred happened found unexpected invalid "
    "undefined null missing provided expected received returned called execution execute run "
    "running start starting stop stopping fail fails crashing crashed issue problem bug fix fixed "
    "resolving resolved"
).split()

# Naming styles, tested in this order.
NAMING_STYLES = {
    "PascalCase": r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)*$",
    "camelCase": r"^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)*$",
    "snake_case": r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$",
    "kebab-case": r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$",
    "UPPER_CASE": r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$",
}

# Declarations that introduce a name.
DECLARATION_PATTERNS = (
    r"\bclass\s+([a-zA-Z_$][\w$]*)",
    r"\bfunction\s+([a-zA-Z_$][\w$]*)",
    r"\b(?:interface|type)\s+([a-zA-Z_$][\w$]*)",
    r"\b(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_$][\w$]*)",
)

# Conventional commit types.
COMMIT_TYPES = (
    "feat", "fix", "chore", "docs", "refactor", "test", "style", "perf", "ci", "build", "revert",
)

# Language by extension for code compaction.
COMPACTION_LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".swift": "swift", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c",
    ".hpp": "cpp", ".cs": "csharp",
}
HASH_COMMENT_LANGUAGES = ("python", "ruby")

# Language name by extension for code statistics.
LANGUAGE_BY_EXTENSION = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript",
    ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".go": "Go", ".rs": "Rust",
    ".java": "Java", ".md": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".css": "CSS", ".scss": "SCSS", ".sass": "SCSS", ".html": "HTML", ".sql": "SQL",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".rb": "Ruby", ".php": "PHP",
    ".swift": "Swift", ".kt": "Kotlin", ".dart": "Dart", ".lua": "Lua", ".ex": "Elixir",
    ".exs": "Elixir", ".vue": "Vue", ".svelte": "Svelte", ".astro": "Astro",
}

# Short language codes used by the rule tables.
RULE_LANGUAGE_BY_EXTENSION = {
    ".ts": "ts", ".js": "js", ".tsx": "tsx", ".jsx": "jsx", ".py": "py", ".go": "go", ".rs": "rs",
    ".java": "java", ".rb": "rb", ".php": "php", ".swift": "swift", ".kt": "kt", ".cpp": "cpp",
    ".c": "c", ".h": "c",
}

# Folders never scanned, and source extensions of a scan.
SKIP_DIRS = (
    "node_modules", "dist", ".git", "build", ".next", "vendor", ".gradle", "generated", "coverage",
)
SOURCE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".rb",
    ".php", ".swift", ".c", ".cpp", ".h", ".sql", ".sh", ".json", ".yaml", ".yml", ".md", ".css",
    ".html", ".vue", ".svelte",
)

# Terms that make any error critical.
CRITICAL_TERMS = ("fatal", "crash", "out of memory", "segfault", "panic", "emergency")

# Key abbreviations of JSON compaction.
SHORT_KEYS = {
    "description": "desc", "summary": "sum", "properties": "props", "arguments": "args",
    "parameters": "params", "configuration": "config", "environment": "env", "directory": "dir",
    "filename": "file", "extension": "ext", "language": "lang", "statusCode": "code",
    "message": "msg", "response": "res", "request": "req", "previous": "prev", "current": "cur",
    "original": "orig", "reference": "ref",
}
