"""Sieveline: retrieval, corpus hygiene, text preparation and evaluation on Spark DataFrames."""
