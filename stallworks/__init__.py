"""Directory analytics on Spark: from page tables to clean company tables."""
