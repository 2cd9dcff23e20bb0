"""Small decisions shared by jobs, logs and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes that may be shown, and the pattern of the numbered ones.
SAFE_ERRORS = (
    "missing_installation_id", "github_app_not_configured", "github_private_key_invalid",
    "github_invalid_response", "github_unavailable", "ai_transport_error", "ai_incomplete_response",
    "ai_invalid_response", "ai_missing_key", "analyzer_timeout", "analysis_incomplete",
    "worker_lease_expired", "retry_limit_exceeded", "github_retry_exhausted", "pull_request_changed",
)
NUMBERED_ERROR = r"\A(?:github|ai)_http_[0-9]{3}\z"
GENERIC_ERROR = "processing_error"
FIRST_DELAY = 30


def safe_error(error: Column) -> Column:
    """The code when it is on the list, else one generic code."""
    known = error.isin(*SAFE_ERRORS) | error.rlike(NUMBERED_ERROR)
    return F.when(F.coalesce(known, F.lit(False)), error).otherwise(F.lit(GENERIC_ERROR))


def backoff_seconds(attempt: Column, retry_after: Column | None = None) -> Column:
    """Doubling delay from the first attempt on, never shorter than what the service asked for."""
    doubled = (F.lit(FIRST_DELAY) * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")
    asked = F.lit(0) if retry_after is None else F.coalesce(retry_after, F.lit(0))
    return F.greatest(doubled, asked.cast("bigint"))
