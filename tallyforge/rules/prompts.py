"""Prompt intents, language and risk signs, task complexity words, command guards.

``INTENTS`` is a short default of the keyword intents; callers pass their own rule table for wider vocabularies.
"""

# Default rules as (intent, alternation), in priority order.
INTENTS = (
    ("deploy", r"deploy|deployment|docker|container|kubernetes|release|hosting"),
    ("security", r"security|vulnerability|exploit|xss|oauth|jwt|permission|secret leak"),
    ("audit", r"audit|review|assess|evaluate|inspect|dead code|circular dependency"),
    ("refactor", r"refactor|refactoring|cleanup|rewrite|restructure|modular"),
    ("batch", r"batch|bulk|mass|parallel|concurrent"),
    ("export", r"export|visualize|diagram|mermaid"),
    ("test", r"test|testing|coverage|mock|fixture|pytest"),
    ("docs", r"readme|documentation|docs|changelog|tutorial"),
    ("database", r"database|sql|schema|migration|index|query"),
    ("performance", r"performance|optimize|slow|latency|bottleneck|cache"),
    ("frontend", r"frontend|react|vue|css|component|layout"),
    ("backend", r"backend|api|server|endpoint|middleware"),
    ("ml", r"machine learning|model|inference|embedding|classifier"),
    ("implement", r"implement|build|create|add|fix|bug|error|crash"),
    ("plan", r"planning|roadmap|strategy|steps"),
    ("ask", r"what is|how does|why|explain|describe"),
)

# Intents that call for no skill of their own, and words that make such a prompt code work.
NO_SKILL = ("batch", "export", "plan", "ask")
CODE_WORDS = (
    r"code|kode|file|folder|function|fungsi|class|module|modul|endpoint|api|route|rute|"
    r"handler|component|komponen|script|config|konfigurasi|package\.json|tsconfig|dockerfile|"
    r"\.ts|\.tsx|\.js|\.jsx|\.py|\.go|\.rs|\.java|\.php|\.sh|\.sql|\.ya?ml|\.json")

# Skill, intent and alternation of both languages, in order; the last counts only if no other does.
CONTEXT_SKILLS = (
    ("deploy-docker", "deploy", r"deploy|deployment|docker|traefik|vps|ci.cd|github.*action|container|compose|nginx|containerize|dockerize|kubernetes|k8s|helm|terraform"),
    ("refraktor", "refactor", r"refactor|refactoring|reorganize|restructure|extract|modular|modularize|mvc|rewrite|cleanup|layer.*separation|susun.*ulang|struktur.*ulang|rapikan|solid|dry|yagni"),
    ("auditor", "audit", r"audit|review|assess|evaluate|inspect|layer.*violation|fat.*controller|coupling|circular.*dependency|code.*smell|cek.*struktur|kelemahan|weakness|quality|kualitas|health"),
    ("coder", "implement", r"implement|create|add|build|develop|buat|bikin|tambah|endpoint|route|handler|controller|service|repository|component|api|function|class|module|pagination|cursor|migration"),
    ("coder", "implement", r"fix|bug|patch|repair|resolve|debug|troubleshoot|perbaiki|benahi|error|crash|broken|fail|gagal|exception|panic|segfault|null|undefined|race.condition|memory.*leak|timeout"),
    ("brainstorming", "brainstorm", r"brainstorm|design|spec|idea|requirement|fitur|rekomendasi|solution.*approach|alternatif|trade.?off"),
    ("planner", "plan", r"plan|roadmap|decompose|break.*down|strategy|steps|rencana|tahapan|langkah|task|subtask|milestone|sprint|backlog"),
    ("tester", "test", r"test|testing|unit.*test|integration.*test|e2e|coverage|mock|stub|assert|tdd|bdd|uji|pengujian|vitest|jest|mocha|pytest|playwright|cypress"),
    ("diagram", "diagram", r"diagram|visual|visualization|mermaid|graph.*viz|arsitektur.*diagram|module.*map|dependency.*graph|call.*graph"),
    ("docs", "docs", r"doc|documentation|readme|readme|pr.*description|changelog|release.*note|adr|contributing|migration.*guide|api.*spec|openapi|swagger"),
    ("memory", "memory", r"memory|lesson|learn|experience|journal|knowledge|cross.?agent|store.*lesson|simpan.*pelajaran|ingat"),
    ("secrets", "security", r"secrets|api.*key|token|password|credential|private.*key|certificate.*pem|secret.*scan|hardcoded.*credential|env.*file|.env"),
    ("vuln", "security", r"vuln|vulnerability|cve|sbom|supply.*chain|dependency.*check|snyk|npm.*audit"),
    ("deadcode", "audit", r"dead.*code|unused.*export|orphan.*file|uncalled.*function|tree.?shake|mati.*kode|tak.*terpakai"),
    ("performance", "perf", r"performance|perf|bundle.*size|lighthouse|load.*time|slow.*query|n+1|index.*strategy|optimization|optimasi|cepat|lambat"),
    ("deploy-docker", "deploy", r"docker|compose|container|vps|server.*production|ci.cd|github.*action|deploy|traefik|nginx|ghcr|production"),
)
# Words of large and of ordinary tasks, and the words an ordinary one has more than.
LARGE_WORDS = r"multi|architecture|migration|platform|scalab|distribut|event.*driven|refactor|restructure|modular|multiple.*module|schema.*design|auth|authentication|authorization"
ORDINARY_WORDS = r"feature|endpoint|service|repository|controller|module|komponen|fitur"
ORDINARY_LENGTH = 20

# Risk signs with their level, words of the second language, word-count bounds.
RISKS = (
    ("file", "critical", r"rf.*/ | rm.*-rf.*/ | rm.*-rf.*~|hapus.*semua.*file|delete.*all.*file|wipe.*filesystem|format.*disk"),
    ("git", "critical", r"force.*push.*main|force.*push.*master|push.*-f.*main|reset.*main.*--hard|delete.*git.*history"),
    ("database", "critical", r"drop.*table.*prod|drop.*database.*prod|truncate.*all|hancurkan.*database"),
    ("secret", "high", r"print.*env.*token|echo.*password|cat.*\.env|commit.*secret|upload.*secret|commit.*private.*key"),
    ("production", "high", r"deploy.*prod|push.*production|live.*server|production.*database|migrate.*prod"),
)
SECOND_LANGUAGE = (
    "id", r"(kerjakan|implementasi|perbaiki|buat|tambah|apa|bagaimana|jelaskan|fitur|kode|saya|kita|tolong|bisa|analisis|kelemahan|cek|susun|struktur|rapikan)")
COMPLEX_WORDS = 150
STANDARD_WORDS = 50

# Task complexity signs.
FILE_MENTION = r"src/|lib/|app/|test/|\.ts|\.js|\.py|\.go|\.rs|\.java|\.kt"
COMPLEX_TASK = (
    r"(?i)refactor|architect|migration|multi.file|new.module|implement.*feature|add.*endpoint|database.*schema|authentication|"
    r"authorization|middleware|circuit.breaker|event.bus|websocket|real.time|deployment|ci.cd|docker|kubernetes")
SIMPLE_TASK = r"(?i)fix typo|update readme|rename|rename.*variable|add.*comment|format|whitespace|remove.*unused"

# Recursive deletion targets that are refused.
ROOT_TARGETS = ("/", "*", ".", "./", "./*", "/*", "~", "~/", "~/*", "$HOME", "$HOME/", "$HOME/*")
