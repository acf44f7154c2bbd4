"""Evidence analytics on Spark: units of text, hybrid retrieval, people, receipts and privacy as DataFrame pipelines."""
