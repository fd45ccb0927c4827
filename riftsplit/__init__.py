"""Out-of-distribution splitting, split auditing and ID/OOD analytics as Spark jobs."""
