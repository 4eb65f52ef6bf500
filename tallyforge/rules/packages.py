"""Licence lists, known packages, advisories and sizes.

Fixed values: results depend on these exact lists.
"""

# Licence categories, looked up in this order.
LICENSES = {
    "copyleft": (
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-2.1", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0", "EUPL-1.2", "CeCILL-2.1",
    ),
    "restrictive": (
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "LGPL-3.0", "MPL-2.0", "BSL-1.0", "EUPL-1.2", "CC-BY-NC-4.0", "SSPL-1.0", "BUSL-1.1",
    ),
    "permissive": (
        "MIT", "Apache-2.0", "Apache 2.0", "Apache2", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause",
        "ISC", "Unlicense", "CC0-1.0", "0BSD", "WTFPL", "Python-2.0", "PostgreSQL", "Zlib",
        "Unicode-DFS-2016", "Unicode-DFS-2015",
    ),
}

# Shapes recognised when a licence is in no list.
SPDX_LIKE = r"(?i)^\(?(MIT|Apache-2\.0|BSD-\d-Clause|ISC|GPL|LGPL|AGPL|MPL|CC0|Unlicense)"

# Licences of well-known Python packages.
PIP_LICENSES = {
    "requests": "Apache-2.0", "flask": "BSD-3-Clause", "django": "BSD-3-Clause",
    "numpy": "BSD-3-Clause", "pandas": "BSD-3-Clause", "scipy": "BSD-3-Clause", "sqlalchemy": "MIT",
    "sqlalchemy-utils": "MIT", "celery": "BSD-3-Clause", "redis": "MIT", "jinja2": "BSD-3-Clause",
    "click": "BSD-3-Clause", "werkzeug": "BSD-3-Clause", "itsdangerous": "BSD-3-Clause",
    "gunicorn": "MIT", "uvicorn": "BSD-3-Clause", "fastapi": "MIT", "pydantic": "MIT",
    "psycopg2": "LGPL-2.1", "psycopg2-binary": "LGPL-2.1", "boto3": "Apache-2.0",
    "botocore": "Apache-2.0", "pytest": "MIT", "mypy": "MIT", "black": "MIT", "isort": "MIT",
    "flake8": "MIT", "pylint": "GPL-2.0", "tox": "MIT", "coverage": "Apache-2.0",
    "sphinx": "BSD-2-Clause", "python-dateutil": "Apache-2.0", "pytz": "MIT", "pyyaml": "MIT",
    "pillow": "Historical", "python-dotenv": "BSD-3-Clause", "attrs": "MIT", "urllib3": "MIT",
    "certifi": "MPL-2.0", "chardet": "LGPL-2.1", "idna": "BSD-3-Clause",
}

# Advisories as (package, id, severity, title, fixed_in, cvss).
ADVISORIES = (
    ("lodash", "CVE-2021-23337", "CRITICAL", "Prototype Pollution", "4.17.21", 9.1),
    ("nodemailer", "CVE-2024-26485", "CRITICAL", "Command Injection", "6.9.9", 9.8),
    ("next", "CVE-2024-46982", "CRITICAL", "Denial of Service", "14.2.21", 7.5),
    ("express", "CVE-2024-29041", "HIGH", "Path Traversal", "4.20.0", 7.5),
    ("axios", "CVE-2024-39338", "HIGH", "SSRF Vulnerability", "1.7.4", 7.5),
    ("fast-xml-parser", "CVE-2024-37460", "HIGH", "Prototype Pollution", "4.4.1", 7.5),
    ("tar", "CVE-2024-28863", "HIGH", "Arbitrary File Creation", "6.2.1", 7.5),
    ("follow-redirects", "CVE-2024-28849", "HIGH", "Credentials Leak", "1.15.6", 7.5),
    ("undici", "CVE-2024-30260", "HIGH", "HTTP Request Smuggling", "6.19.2", 7.5),
    ("cookiejar", "CVE-2023-26136", "HIGH", "ReDoS", "2.1.4", 7.5),
    ("ws", "CVE-2024-37890", "HIGH", "Heap Overflow", "8.17.1", 7.5),
    ("semver", "CVE-2024-4068", "MEDIUM", "ReDoS", "7.6.2", 5.3),
    ("path-to-regexp", "CVE-2024-52798", "HIGH", "ReDoS", "3.3.0", 7.5),
    ("minimatch", "CVE-2022-3517", "HIGH", "ReDoS", "9.0.0", 7.5),
    ("cross-spawn", "CVE-2024-21538", "CRITICAL", "Shell Injection", "7.0.5", 9.1),
    ("http-proxy-middleware", "CVE-2024-21536", "HIGH", "Path Traversal", "3.0.3", 7.5),
)
ADVISORY_SCHEMA = (
    "package string, id string, severity string, title string, fixed_in string, cvss double"
)
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Severity names of external audits.
AUDIT_SEVERITY = {"critical": "CRITICAL", "high": "HIGH", "moderate": "MEDIUM", "low": "LOW"}

# Estimated minified sizes in bytes, and the size of an unknown package.
PACKAGE_SIZES = {
    "react": 6832, "react-dom": 130912, "react-router-dom": 21600, "vue": 33500, "vue-router": 21000,
    "pinia": 3700, "svelte": 4600, "angular": 197000, "@angular/core": 87000,
    "@angular/common": 83000, "next": 294000, "nuxt": 168000, "gatsby": 232000, "express": 218000,
    "lodash": 71000, "lodash-es": 28600, "axios": 32500, "dayjs": 6900, "datefns": 29000,
    "moment": 230000, "chartjs": 63000, "d3": 274000, "three": 606000, "jquery": 87000,
    "bootstrap": 195000, "bootstrap-icons": 160000, "tailwindcss": 6500, "core-js": 175000,
    "rxjs": 95000, "uuid": 3800, "zod": 10300, "immer": 11000, "zustand": 2600, "clsx": 400,
    "@emotion/react": 33300, "framer-motion": 140000, "react-hook-form": 15000, "react-query": 23000,
}
UNKNOWN_PACKAGE_SIZE = 5000
GZIP_SHARE = 0.3
LARGE_BUNDLE = 100_000

# Package name shapes of elevated trust risk.
TRUST_HIGH = r"^@deprecated/|^@babel/plugin-|^@types/"
TRUST_MEDIUM = r"^eslint-plugin-|^jest-|^@storybook/"
