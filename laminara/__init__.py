"""Spark-first analytics for stacks of aligned sections."""
