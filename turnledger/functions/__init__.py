"""Column expressions. All built from Spark SQL functions; no Python UDFs."""
