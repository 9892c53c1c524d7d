"""A PySpark-native engine for schedule-risk, document-evidence and corpus workloads."""
