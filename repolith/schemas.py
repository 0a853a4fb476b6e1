"""Table schemas. Every table leads with ``repo_id``; times are zone-less timestamps."""

COMMITS = (
    "repo_id STRING, commit_id STRING, author STRING, email STRING, "
    "committed_at TIMESTAMP_NTZ, subject STRING, body STRING, is_merge BOOLEAN"
)
CHANGES = (
    "repo_id STRING, commit_id STRING, committed_at TIMESTAMP_NTZ, path STRING, "
    "insertions BIGINT, deletions BIGINT, is_binary BOOLEAN"
)
FILES = "repo_id STRING, path STRING"
CONTENTS = "repo_id STRING, path STRING, text STRING"
MARKS = "repo_id STRING, last_commit_id STRING, last_updated TIMESTAMP_NTZ"
PULL_REQUEST_JSON = (
    "number BIGINT, title STRING, body STRING, author STRUCT<login: STRING>, mergedAt STRING, "
    "baseRefName STRING, additions BIGINT, deletions BIGINT, "
    "files ARRAY<STRUCT<path: STRING>>, labels ARRAY<STRUCT<name: STRING>>, "
    "reviews ARRAY<STRUCT<author: STRUCT<login: STRING>>>, comments ARRAY<STRUCT<body: STRING>>"
)
ANSWERS = (
    "repo_id STRING, project_description STRING, build_commands ARRAY<STRING>, "
    "architecture_notes STRING, code_patterns ARRAY<STRING>, domain_context ARRAY<STRING>, "
    "testing_notes STRING, domain_qa ARRAY<STRUCT<question: STRING, answer: STRING>>"
)
DECISIONS = (
    "repo_id STRING, id STRING, status STRING, session STRING, supersedes STRING, superseded_by STRING"
)
ASKED = "repo_id STRING, asked_on STRING, id STRING, question STRING, status STRING"
