"""The catalog, and the queries over the driver's tables."""
