"""Security-event analytics on Spark: a rule language, alert pipeline, queries and streams."""
