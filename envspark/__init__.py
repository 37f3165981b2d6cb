"""envspark: analytics over environmental observations, as Spark DataFrame operators."""
