"""Column functions; every one returns a Column and runs inside a Spark plan."""
