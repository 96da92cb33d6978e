"""Carry a table's other columns through an operator, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def _names(docs: DataFrame, own: Iterable[str]) -> list[str]:
    used = set(own)
    return [name if name in used else f"extra_{k}" for k, name in enumerate(docs.columns)]


def set_aside(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with every column but ``own`` called ``extra_<position>``, so that none meets a name of the operator."""
    return docs.toDF(*_names(docs, own))


def as_before(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs`` under their own names and in their own order, from a table made with :func:`set_aside`."""
    return df.select(*_names(docs, own)).toDF(*docs.columns)
