"""lectern: Spark-native operators over timed text, catalogue tables and document corpora."""
