"""Scores as column expressions: 0 to 100, null where an input is unknown unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the combined score.
WEIGHTS = {"frame": 0.25, "recency": 0.20, "frequency": 0.10, "proximity": 0.25, "history": 0.20}
RECENT_DAYS, FREQUENT, HISTORIC, DECAY, HOP = 180.0, 20.0, 10.0, 0.75, 20.0


def clamp(c: Column, top: float = 100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(top), c))


def frame_distance(index: Column) -> Column:
    """100 for the top frame, three quarters of that with each frame below."""
    return F.when(index < 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.pow(F.lit(DECAY), index))


def commit_recency(days: Column) -> Column:
    """100 today, linearly down to 0 at 180 days; 0 for no commit (null)."""
    return F.when(days.isNull() | (days < 0) | (days >= RECENT_DAYS), F.lit(0.0)).otherwise(F.lit(100.0) * (F.lit(1.0) - days / F.lit(RECENT_DAYS)))


def _saturating(n: Column, at: float) -> Column:
    return F.when(n.isNull() | (n <= 0), F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.log1p(n) / F.log1p(F.lit(at)) * 100.0))


def commit_frequency(n: Column) -> Column:
    return _saturating(n, FREQUENT)


def historical_failure(n: Column) -> Column:
    return _saturating(n, HISTORIC)


def dependency_proximity(hops: Column) -> Column:
    return F.when(hops < 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - hops * F.lit(HOP)))


def combine(frame: Column, recency: Column, frequency: Column, proximity: Column, history: Column) -> Column:
    parts = zip((frame, recency, frequency, proximity, history), WEIGHTS.values(), strict=True)
    total = None
    for c, w in parts:
        total = c * F.lit(w) if total is None else total + c * F.lit(w)
    return clamp(total)


def score_frame(index: Column, in_repo: Column) -> Column:
    return F.when(in_repo, frame_distance(index)).otherwise(frame_distance(index) * 0.2)


def score_file_change(frame: Column, days: Column, commits: Column) -> Column:
    return combine(frame, commit_recency(days), commit_frequency(commits), frame, F.lit(0.0))
