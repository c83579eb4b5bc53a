"""Document-audit analytics on Spark: DataFrame operators over pages, tokens, chunks, findings and issues."""
