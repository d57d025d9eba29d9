"""ledgerspark: revenue analytics and data quality for star schemas, as lazy Spark plans."""
