"""Named queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from larder.oracle.prelude import sql


@dataclass(frozen=True)
class Query:
    build: Callable
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, stage: str | None = None, body: str | None = None):
    """Register a builder taking ``Stages``; ``body`` is its SQL over a stage's tables."""

    def register(build: Callable[..., DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(build, sql(stage, body) if body else None)
        return build

    return register


def load() -> dict[str, Query]:
    from larder.catalog import causal, extracts, models, quality, statistics, tables  # noqa: F401

    return REGISTRY
