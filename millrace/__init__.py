"""A Spark-native SQL and data-processing engine with PostgreSQL-flavoured semantics."""
