"""trapline: motion-triggered recording analytics on Spark DataFrames."""
