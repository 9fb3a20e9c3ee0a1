"""Retrieval and retrieval evaluation over Spark DataFrames."""

from ragloom.params import Params

__all__ = ["Params"]
