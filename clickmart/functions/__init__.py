"""Column and DataFrame helpers shared by the jobs."""
