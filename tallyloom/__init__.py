"""tallyloom: purchase analytics, data quality and replication as Spark jobs."""
