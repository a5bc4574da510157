"""Models fitted and applied as Spark jobs."""
