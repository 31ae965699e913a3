"""Document analytics on Spark: parse, style, chunk, pack and check whole corpora."""
