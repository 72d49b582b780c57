"""Document analytics on Spark: sections, ranked retrieval, change tracking and retrieval evaluation as DataFrame plans."""
