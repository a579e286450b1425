"""millrace: training-data preparation and table analytics as Spark DataFrame jobs."""
