"""finlode: Spark-native document retrieval and financial-report analytics."""
