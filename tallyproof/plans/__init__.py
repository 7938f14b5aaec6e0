"""Registered queries, grouped by area."""

import importlib

AREAS = ["case_checks", "case_metrics", "retrieval_queries", "question_queries", "evidence_queries", "graph_queries", "eval_queries", "source_queries"]


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
