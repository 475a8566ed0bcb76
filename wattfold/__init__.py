"""Load-profile summaries on Spark: customer categories, readings, written outputs."""
