"""Column functions. Everything here maps Column to Column and stays in the JVM,
except `text.resolve`, which is an Arrow UDF."""
