"""tidegrid: cohort time-series analytics as Spark DataFrame jobs."""
