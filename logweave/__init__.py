"""logweave: log normalization, lineage and evidence as Spark DataFrame jobs."""
