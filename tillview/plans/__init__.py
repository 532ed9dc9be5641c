"""Compositions of operators: the query catalogue and the scheduled jobs."""
