"""Registered queries over the given tables."""

MODULES = ("text_queries", "scoring_queries", "transcript_queries", "join_queries", "structure_queries", "sequence_queries", "stream_queries")
