"""All registered queries of the core."""

from __future__ import annotations

from kinetra.plans import data_problems, experiment_queries, fit_queries, landmark_queries, mesh_queries, track_queries

_MODULES = (data_problems, track_queries, experiment_queries, mesh_queries, fit_queries, landmark_queries)
FLAGSHIP = mesh_queries.plane_mesh_intersections


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def sql() -> dict:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
