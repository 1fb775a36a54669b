"""Schemas of the tables that operators take and give; every table also carries change_id."""

from __future__ import annotations

STATUSES = ("Added", "Modified", "Deleted", "Renamed")
LINE_KINDS = ("Context", "Added", "Removed", "Moved", "MovedEdited")
HUNK_KINDS = ("NewLogic", "ModifiedLogic", "ImportOnly", "WhitespaceOnly", "Moved", "MovedWithEdits")
CHANGE_KINDS = ("Added", "Deleted", "SignatureChanged", "BodyChanged")
SEVERITIES = ("Error", "Warning", "Info")


def _schema(ddl: str) -> str:
    return "change_id string, " + ddl


FILES = _schema("file_idx int, path string, old_path string, status string, additions long, deletions long")
HUNKS = _schema("file_idx int, hunk_idx int, old_start int, old_count int, new_start int, new_count int")
LINES = _schema("file_idx int, hunk_idx int, line_idx int, kind string, content string, old_line_no int, new_line_no int")
IMPORTS = _schema("path string, import_idx int, source string, names array<string>, default string")
EXPORTS = _schema("path string, export_idx int, name string, kind string, source string")
FUNCTIONS = _schema("path string, function_idx int, name string, params array<string>, return_type string, line int")
EDGES = _schema("src string, dst string, edge_no long")
COMMITS = ("sha string, ts timestamp, author string, path string")
ROUNDS = ("branch string, version int, sha string, timestamp timestamp, files_viewed array<string>, notes_count long")
NOTES = ("branch string, id string, file string, line int, content string, created_at timestamp")
CHECKLIST = ("branch string, path string, text string, checked boolean, source_pattern string")
PULL_REQUESTS = (
    "number long, title string, author string, state string, draft boolean, head_branch string, base_branch string, url string, created_at timestamp, updated_at timestamp, additions long, deletions long, review_status string, labels array<string>"
)
