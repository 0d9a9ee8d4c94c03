"""Marketing and commerce metrics over a star schema, as lazy Spark DataFrames."""

from tidemark.model import RelationSpec, Star
from tidemark.plans.request import AggregateRequest, aggregate, aggregate_entity

__all__ = ["AggregateRequest", "RelationSpec", "Star", "aggregate", "aggregate_entity"]
