"""Spark-native source-scan analytics: chunking, rule scans, verdicts, consensus, retrieval."""
