"""Training-data operators on Spark; nothing outside this subpackage imports it."""
