"""Gridloom: household-energy analytics expressed as Spark DataFrames."""
