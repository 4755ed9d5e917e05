"""rateframe: rating analytics and recommendations as Spark DataFrame jobs."""
