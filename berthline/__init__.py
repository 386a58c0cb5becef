"""Fleet capacity placement and SLA-risk analytics as Spark DataFrame jobs."""
