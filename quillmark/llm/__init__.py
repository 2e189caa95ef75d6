"""The ten training-corpus operators; their queries are in ``llm.queries``."""
