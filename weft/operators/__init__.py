"""Lowering of plans to DataFrames."""
