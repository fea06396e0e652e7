"""Registered queries, grouped as the operator inventory is."""

import importlib

GROUPS = ["rollups", "aggregates", "joins", "selections", "ingestion", "detection", "lifecycles", "causes", "modelling"]


def load_all() -> None:
    for group in GROUPS:
        importlib.import_module(f"vigilmesh.plans.{group}")
