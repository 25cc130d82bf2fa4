"""Limits of indexing and retrieval; fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass


# The limits within which repositories are indexed and queries answered.
@dataclass(frozen=True)
class Limits:
    repo_bytes: int = 100 * 1024 * 1024
    file_bytes: int = 1024 * 1024
    file_count: int = 10_000
    parse_units: int = 256 * 1024
    min_chunk_tokens: int = 100
    max_chunk_tokens: int = 1500
    sniff_bytes: int = 8 * 1024
    rrf_k: int = 60
    impact_depth: int = 3
    impact_max_depth: int = 5
    impact_visited: int = 2000
    affected_shown: int = 100
    listed_files: int = 200
    dependencies: int = 50
    read_lines: int = 400
    read_chars: int = 8000
    patch_chars: int = 1500
    error_chars: int = 2000
    diagram_files: int = 80


LIMITS = Limits()

# Names of states, kinds and roles.
REPO_STATUS = ("queued", "indexing", "ready", "failed")
JOB_STATUS = ("queued", "cloning", "parsing", "embedding", "done", "failed")
SYMBOL_TYPES = ("function", "class", "method", "module", "other")
MESSAGE_ROLES = ("user", "assistant")
ACTIVE_STATUS = ("queued", "cloning", "parsing", "embedding", "indexing")
