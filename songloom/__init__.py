"""A listening library on Spark: songs, plays, lyrics and search as DataFrames."""

from songloom.plans.workspace import Workspace

__all__ = ["Workspace"]
