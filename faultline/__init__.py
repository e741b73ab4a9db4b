"""Exception-flow analytics on Spark."""
