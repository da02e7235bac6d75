"""Genome-interval analytics on Spark: Column functions, DataFrame operators, sources, sinks and whole programs."""
