"""Tarnish: what does each kind of data defect cost the queries that read the data?

Defects are Column expressions, the risk surface over all defect combinations
is one pass over the fact table, and attribution is joins and sums.
"""
