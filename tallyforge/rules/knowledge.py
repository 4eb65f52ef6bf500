"""Tips and practices offered for a task context.

Fixed values: categories, keywords, tasks, frameworks and priorities; the sentences are ours.
"""

# Fixed values: (category, keywords), tested in this order; the sentence is free text.
TIPS = (
    ("TypeScript", ("typescript", "ts", "type", "interface", "generic"), "Prefer standard decorators in new code."),
    ("Next.js", ("nextjs", "next.js", "next", "ssr", "server component"), "Render on the server unless a page is interactive."),
    ("React", ("react", "component", "hook", "state", "useEffect"), "Fetch data with a query cache, not in effects."),
    ("Prisma", ("prisma", "orm", "database", "schema", "migration"), "Declare composite indexes for combined filters."),
    ("Express", ("express", "middleware", "route", "api"), "Forward async errors to one handler."),
    ("Docker", ("docker", "container", "image", "dockerfile"), "Keep the build context small."),
    ("Testing", ("test", "testing", "jest", "vitest", "unit test"), "Run only the tests of changed files while editing."),
    ("Node.js", ("node", "nodejs", "node.js", "backend", "server"), "Use the built-in fetch for plain requests."),
    ("Performance", ("perf", "performance", "optimization", "bundle", "lazy"), "Load hidden components lazily."),
    ("CSS", ("css", "styling", "tailwind", "responsive"), "Configure styles in CSS first."),
    ("Git", ("git", "commit", "branch", "version control"), "Write conventional commits for generated changelogs."),
    ("Security", ("security", "auth", "jwt", "token", "password", "encrypt"), "Keep secrets out of the source tree."),
    ("Database", ("database", "query", "sql", "index", "n+1"), "Join or batch instead of querying per row."),
    ("State Management", ("state", "redux", "context", "global state", "zustand"), "Pick the smallest store that fits."),
    ("API Design", ("api", "rest", "graphql", "endpoint", "route"), "Version the API explicitly."),
)

# Fixed values: (task, framework, priority) with a short title of ours.
PRACTICES = (
    ("authentication", "Next.js", "high", "Use an integrated auth library"),
    ("authentication", "Next.js", "high", "Protect routes in middleware"),
    ("authentication", "Express", "high", "Use strategy-based auth middleware"),
    ("authentication", "Express", "medium", "Rotate refresh tokens"),
    ("authentication", "Prisma", "medium", "Audit access in client middleware"),
    ("database", "Prisma", "high", "Pool connections"),
    ("database", "Prisma", "medium", "Select only needed fields"),
    ("database", "Prisma", "high", "Wrap related writes in a transaction"),
    ("database", "PostgreSQL", "high", "Index frequently filtered columns"),
    ("database", "PostgreSQL", "medium", "Partition very large tables"),
    ("testing", "Vitest", "high", "Mock modules with the runner"),
    ("testing", "Vitest", "medium", "Set a coverage threshold"),
    ("testing", "Jest", "high", "Mock modules with the runner"),
    ("deployment", "Docker", "high", "Build in stages"),
    ("deployment", "Docker", "medium", "Declare a health check"),
    ("deployment", "Node.js", "high", "Run under a process manager"),
    ("api", "Express", "high", "Validate input"),
    ("api", "Express", "high", "Limit request rates"),
    ("api", "Next.js", "high", "Use route handlers"),
    ("error_handling", "Node.js", "high", "Install one global error handler"),
    ("error_handling", "Node.js", "medium", "Return structured errors"),
)
PRIORITIES = ("high", "medium", "low")

# Words that make a knowledge entry a recommendation.
ADVICE_WORDS = ("best practice", "recommend", "should")

# Result size and match threshold of a knowledge query.
MAX_RESULTS = 20
MIN_SCORE = 2
