"""Options of a scan, their bounds, and the exit code."""

from __future__ import annotations

from dataclasses import dataclass, field

# The bounds of the integer options.
BOUNDS = {"jobs": (1, 64), "limit_100": (1, 100), "limit_1000": (1, 1000)}


def bounded_int(text: str, kind: str) -> int:
    low, high = BOUNDS[kind]
    if not text.isdigit() or not low <= int(text) <= high:
        raise ValueError(f"expected a whole number from {low} to {high}")
    return int(text)


def exit_code(partial: bool, allow_partial: bool, no_match: bool, require_match: bool) -> int:
    """0, or 4 for a partial result that is not allowed, or 3 for no match where one is required."""
    return 4 if partial and not allow_partial else 3 if no_match and require_match else 0


# What the candidates of each discovery are, as the facts say it.
_REVERSE = "releases in the registry whose published metadata names the target as a dependency"
SCOPES = {
    "registry": _REVERSE,
    "code": "repositories that a bounded public code search led to, each checked at the head of its default branch",
    "both": f"{_REVERSE}; and repositories that a bounded public code search led to",
}
#: Of repository groups at most so many times the wanted number are looked up.
OVERSCAN = 4


@dataclass(frozen=True)
class ScanOptions:
    """What a scan takes; the defaults are the usual ones."""

    query: str
    version: str
    observed_at: str
    discovery: str = "registry"
    max_candidates: int | None = None
    code_search_limit: int = 100
    repository: str | None = None
    kinds: list[str] = field(default_factory=lambda: ["normal", "dev", "build"])
    optional_mode: str = "include"
    requirement_mode: str = "any"
    activity: str = "all"
    stale_days: int = 365
    since: str | None = None
    before: str | None = None
    include_forks: bool = False
    exclude_archived: bool = False
    max_repositories: int | None = None
    max_file_bytes: int = 10 << 20
    file_cap: int = 2000
    byte_budget: int = 128 << 20
    jobs: int = 4
    allow_partial: bool = False
    require_match: bool = False

    def policy(self) -> dict:
        """The snapshot of the policy that facts and summary carry, its fields in a fixed order."""
        return {
            "requirement_filter": self.requirement_mode,
            "discovery": self.discovery,
            "dependency_kinds": self.kinds,
            "optional": self.optional_mode,
            "include_forks": self.include_forks,
            "exclude_archived": self.exclude_archived,
            "stale_after_days": self.stale_days,
            "activity": self.activity,
            "committed_since": self.since,
            "committed_before": self.before,
            "max_candidates": self.max_candidates,
            "max_repositories": self.max_repositories,
            "code_search_limit": self.code_search_limit,
            "max_file_bytes": self.max_file_bytes,
            "repository_matched_file_limit": self.file_cap,
            "repository_matched_file_byte_budget": self.byte_budget,
            "repository_byte_budget_priority": "Cargo.lock before Cargo.toml",
            "repository_resolution_overscan_factor": OVERSCAN,
            "jobs": self.jobs,
            "allow_partial": self.allow_partial,
            "require_match": self.require_match,
        }
