"""seqloom: Spark-first analytics over sequence records."""
