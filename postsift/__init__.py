"""Table operators for pipelines over postings and other text records, on Spark."""
