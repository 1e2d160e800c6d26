"""Declared schemas of the tables that come as files."""

from __future__ import annotations

RAW_COMMIT = "commit_id string, owner string, repo string, commit_message string, diff string"
COMMIT = "commit_id string, repo string, commit_message string, diff string, label int"
ADVISORY = "cve string, desc string"
MAPPING = "cve string, commit_id string, label int"
LEXICAL_SCORES = "cve string, repo string, commit_id string, similarity double, label int"
SEMANTIC_SCORES = ("cve string, repo string, commit_id string, label int, recall double, precision double, "
                   "f1 double")
PREDICTIONS = "cve string, commit_id string, label int, prediction double"
RESULTS = ("subset string, model string, correct_cves bigint, total_cves bigint, cve_accuracy double, "
           "accuracy double, precision double, recall double, f1 double")
VERDICT = """input struct<cve: string, desc: string, repo: string, commit_id: string, commit_message: string,
  diff: string, label: int>,
  output struct<answer: boolean, confidence: int, explanation: string, error: string>,
  metadata struct<description: string, model: string, trace_id: string>"""
SPAN = "trace_id string, span_id string, start timestamp, project string"
GROUND_TRUTH = "map<string, struct<ground_truth: struct<commit: array<string>>>>"
