"""Special functions, variates, and their Spark and SQL twins."""
