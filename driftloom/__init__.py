"""Spread analytics on Spark DataFrames: panels, spreads, threshold strategies, statistics, communities, agents."""
