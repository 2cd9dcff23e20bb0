"""Configured limits, checked when they are constructed."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Name -> (lowest, highest or None). They must equal the public service
# contract so that identical inputs get identical decisions.
RANGES = {
    "review_task_limit_seconds": (10, 3600),
    "max_source_bytes_per_file": (1, None),
    "max_files": (1, None),
    "max_patch_chars_per_file": (1, None),
    "max_total_patch_chars": (1, None),
    "ai_max_files": (1, 20),
    "ai_max_diff_chars": (1, None),
    "ai_max_total_input_chars": (1, None),
    "ai_max_retries": (0, 2),
    "max_attempts": (1, None),
    "max_snapshot_files": (1, None),
    "annotation_batch": (1, None),
    "annotation_message_chars": (1, None),
    "max_findings_per_response": (1, None),
}


@dataclass(frozen=True)
class Limits:
    review_task_limit_seconds: int = 1800
    max_source_bytes_per_file: int = 1_000_000
    max_files: int = 20
    max_patch_chars_per_file: int = 20_000
    max_total_patch_chars: int = 100_000
    ai_max_files: int = 20
    ai_max_diff_chars: int = 20_000
    ai_max_total_input_chars: int = 100_000
    ai_max_retries: int = 1
    max_attempts: int = 4
    max_snapshot_files: int = 3000
    annotation_batch: int = 50
    annotation_message_chars: int = 8000
    max_findings_per_response: int = 50

    def __post_init__(self) -> None:
        for field in fields(self):
            low, high = RANGES[field.name]
            value = getattr(self, field.name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise ValueError(f"{field.name} must be an integer")
            if value < low or (high is not None and value > high):
                raise ValueError(f"{field.name}={value} is outside {low}..{high}")


DEFAULT_LIMITS = Limits()
