"""Declared schemas of the canonical tables, as Spark DDL.

Readers take them instead of inferring; rows that do not fit are kept in ``_corrupt_record``.
"""

SCHEMAS = {
    "files": "repo string, path string, ext string, content string, n_bytes bigint",
    "lines": "repo string, path string, line int, text string",
    "log_entries": (
        "service string, line bigint, ts_raw string, ts timestamp, level string, message string, is_raw boolean, "
        "attrs map<string,string>"),
    "spans": "trace_id string, start_time double, end_time double",
    "debt_items": (
        "id string, repo string, path string, line int, type string, severity string, description string, author string, "
        "age_days int, status string, detected_at timestamp, resolved_at timestamp"),
    "blame": "repo string, path string, line int, author string, last_changed timestamp",
    "findings": "repo string, path string, line int, rule_id string, severity string, content string, ts timestamp",
    "functions": "repo string, path string, name string, line int, complexity int, params int, n_lines int",
    "commits": "repo string, hash string, author string, ts timestamp, message string",
    "commit_files": "repo string, hash string, path string, additions bigint, deletions bigint",
    "dependencies": "repo string, name string, version string, ecosystem string, kind string, manifest string",
    "advisories": "package string, id string, severity string, title string, fixed_in string, cvss double",
    "licenses": "repo string, package string, version string, license string, path string",
    "coverage": (
        "repo string, tool string, path string, total_statements int, covered_statements int, total_branches int, "
        "covered_branches int, total_functions int, covered_functions int, total_lines int, covered_lines int, "
        "uncovered_lines array<int>"),
    "imports": "repo string, src_path string, target string",
    "schema_fields": (
        "version string, entity string, field string, pos int, type string, required boolean, is_unique boolean, "
        "default_value string, rel_entity string, rel_type string"),
    "config_kv": "service string, key string, value string",
    "locales": "repo string, lang string, key string, value string",
    "bundle_modules": "build string, name string, size bigint, gzip_size bigint",
    "bench_runs": "name string, duration double, ts timestamp, seq bigint, commit string",
    "quality_snapshots": (
        "module string, ts timestamp, seq bigint, typecheck_errors int, lint_warnings int, test_pass_rate double, "
        "test_coverage double, debt_items int, consistency_score double"),
    "memories": (
        "id string, name string, description string, content string, "
        "provenance array<struct<agent:string,platform:string,ts:timestamp>>, tags array<string>, platform string, "
        "memory_type string, created_at timestamp, updated_at timestamp, content_hash string"),
    "knowledge": (
        "id string, ts timestamp, topic string, library string, source string, content string, url string, "
        "relevance array<string>, tags array<string>"),
    "experiences": (
        "id string, ts timestamp, task_type string, task_desc string, outcome string, root_cause string, "
        "lessons array<string>, patterns array<string>, tags array<string>, processed_at timestamp"),
    "decisions": (
        "id string, ts timestamp, context string, options array<string>, selected string, rationale string, outcome string"),
    "failures": (
        "id string, ts timestamp, type string, tool string, error string, context string, resolved boolean, "
        "resolution string, processed_at timestamp"),
    "corrections": (
        "id string, scope string, seq int, pattern string, symptom string, fix string, source string, applied_count int, "
        "failure_count int, last_applied_at timestamp"),
    "tradeoffs": (
        "id string, ts timestamp, context string, approaches array<struct<name:string,n_pros:int,n_cons:int,"
        "complexity:string,performance:string,maintainability:string,security:string>>, recommended string, outcome string"),
    "messages": "id string, ts timestamp, sender string, recipient string, content string",
    "thoughts": (
        "session string, seq int, thought_number int, total int, is_revision boolean, revises int, branch_from int, "
        "branch_id string, next_needed boolean, text string"),
}
