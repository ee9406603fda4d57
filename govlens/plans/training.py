"""The training-data export as a job: choose, nest, write."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from govlens.operators.conversations import EXPORT_LIMIT, training_export
from govlens.sources.tables import export_jsonl


def export_training_data(
    conversations: DataFrame,
    messages: DataFrame,
    path: str,
    as_of: datetime | str | None = None,
    agent_id: str | None = None,
    days: int = 30,
    include_pii: bool = False,
    only_with_feedback: bool = False,
    min_messages: int = 2,
    limit: int | None = EXPORT_LIMIT,
    session_ratings: DataFrame | None = None,
) -> dict:
    """Write the exported conversations as JSON lines below ``path``; returns the manifest.

    The manifest's keys are fixed; it names the limit, too. ``session_ratings``: see ``training_export``.
    """
    params = {
        "agent_id": agent_id,
        "days": days,
        "include_pii": include_pii,
        "only_with_feedback": only_with_feedback,
        "min_messages": min_messages,
        "limit": limit,
    }
    exported = training_export(conversations, messages, as_of, session_ratings=session_ratings, **params)
    return export_jsonl(exported, path, params)
