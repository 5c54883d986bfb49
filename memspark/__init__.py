"""memspark: a Spark-first analytics engine for time-aware agent memory."""
