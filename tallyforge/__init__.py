"""A PySpark-native engine for evidence analytics: usage accounting, retrieval, graph ranking and snapshot comparison."""
