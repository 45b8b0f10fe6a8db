"""Gates of a publication: why a candidate must not be offered, and why a merged one must not be announced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST, COMMIT = "^[0-9a-f]{64}$", "^[0-9a-f]{40}$"


def candidate_block(complete: Column, unresolved: Column, completed: Column, manifest: Column, candidate: Column) -> Column:
    """The first reason against a candidate, or null: its generation must be complete without open work, and manifest and
    candidate must have the digest with which the generation was completed."""
    return (
        F.when(~F.coalesce(complete, F.lit(False)), "GENERATION_INCOMPLETE")
        .when(F.coalesce(unresolved, F.lit(0)) > 0, F.concat(F.lit("UNRESOLVED_WORK:"), unresolved.cast("string")))
        .when(~F.coalesce(completed.rlike(DIGEST), F.lit(False)), "NO_COMPLETED_MANIFEST")
        .when(~manifest.eqNullSafe(completed), "MANIFEST_MISMATCH")
        .when(~candidate.eqNullSafe(completed), "CANDIDATE_MISMATCH")
    )


def merge_block(merged: Column, checks: Column, commit: Column, merged_head: Column, offered_head: Column) -> Column:
    """The first reason against announcing a merge, or null."""
    return (
        F.when(~F.coalesce(merged, F.lit(False)), "NOT_MERGED")
        .when(~F.coalesce(checks, F.lit(False)), "CHECKS_NOT_PASSED")
        .when(~F.coalesce(commit.rlike(COMMIT), F.lit(False)), "NO_MERGE_COMMIT")
        .when(~merged_head.eqNullSafe(offered_head), "HEAD_MISMATCH")
    )
