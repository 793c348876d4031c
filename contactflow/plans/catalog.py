"""Collects every plan module; importing it fills the registry."""
from __future__ import annotations

from contactflow.plans import (  # noqa: F401
    q_geometry, q_joins, q_gates, q_suppress, q_candidates, q_reports, q_evaluate, q_audio, q_labels, q_sequences, q_sources, q_streaming, q_features,
)
from contactflow.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLE)
