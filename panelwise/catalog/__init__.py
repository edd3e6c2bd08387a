"""Registered queries: every operator applied to the given tables, with an equivalent SQL text."""

from panelwise.catalog import cleaning, describing, models, reshaping, sequences, study_models, testing, whole
from panelwise.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "describing", "models", "reshaping", "sequences", "study_models", "testing", "whole"]
