"""Document research analytics as declarative Spark plans."""
