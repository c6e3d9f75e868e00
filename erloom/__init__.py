"""erloom: a Spark-first entity-resolution and corpus-preparation engine."""
