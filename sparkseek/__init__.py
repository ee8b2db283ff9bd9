"""Search, extraction and ranking of typed records as Spark plans."""
