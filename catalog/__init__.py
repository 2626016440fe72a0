"""Registered queries: each family module holds QUERIES (name -> callable on
``(spark, sf_dir)``) and ORACLES (name -> the same result in SQL)."""

from importlib import import_module

FAMILIES = ("signals", "documents", "templates", "routing", "compliance", "publishing", "rendering", "operations", "arrivals", "answers")


def collect(kind: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out.update(getattr(import_module(f"catalog.{family}"), kind))
    return out
