"""Queries of the driver contract: registers derived from the given tables, one query per operator, and their SQL."""
