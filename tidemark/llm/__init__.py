"""Training-data operators: each module holds one operator and the query that applies it.

Nothing else in the library imports this package; ``queries.load()`` registers its queries.
"""
