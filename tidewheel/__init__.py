"""tidewheel: relational, temporal, text and streaming queries as Spark jobs."""
