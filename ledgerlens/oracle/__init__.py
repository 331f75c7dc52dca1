"""DuckDB SQL oracles: independent formulations of each registered query.

Views ``region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations`` are assumed registered.
"""
