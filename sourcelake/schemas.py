"""Schemas of the tables the operators exchange, as DDL text."""

from __future__ import annotations

FILES = "repo STRING, path STRING, content STRING, mtime TIMESTAMP"
IGNORE_RULES = "repo STRING, ord INT, regex STRING, ignore BOOLEAN"
STRUCTURES = (
    "repo STRING, path STRING, mtime TIMESTAMP, n_chars BIGINT, language STRING, extractor_version STRING, "
    "functions ARRAY<STRING>, classes ARRAY<STRING>, imports ARRAY<STRING>, exports ARRAY<STRING>, "
    "interfaces ARRAY<STRING>, types ARRAY<STRING>, enums ARRAY<STRING>"
)
SYMBOLS = "repo STRING, path STRING, kind STRING, pos INT, name STRING"
EDGES = "repo STRING, src STRING, dst STRING, pos INT"
EXTERNAL_IMPORTS = "repo STRING, path STRING, pos INT, import_text STRING"
TREE_NODES = (
    "tree_id STRING, node_id BIGINT, parent_id BIGINT, child_ord INT, visit_ord BIGINT, type STRING"
)
FINGERPRINT_SETS = "repo STRING, path STRING, hashes ARRAY<BIGINT>"
CLUSTER_MEMBERS = "repo STRING, representative STRING, member STRING"
CLUSTERS = (
    "repo STRING, cluster_id STRING, representative STRING, size BIGINT, threshold DOUBLE, fingerprint STRING"
)
SUMMARY_CACHE = "key STRING, summary STRING"
QUESTIONS = "repo STRING, q_no INT, question STRING"
ARTIFACT_NODES = (
    "_name STRING, _type STRING, depends_on STRUCT<dep: ARRAY<STRING>>"
)
ARTIFACT_MODULES = (
    "_path STRING, classes STRUCT<class: ARRAY<STRING>>, functions STRUCT<function: ARRAY<STRING>>, "
    "imports STRUCT<import: ARRAY<STRING>>, summary STRING"
)
ARTIFACT_CLUSTERS = (
    "_id STRING, _representative STRING, _threshold DOUBLE, _fingerprint STRING, "
    "members STRUCT<member: ARRAY<STRING>>"
)
