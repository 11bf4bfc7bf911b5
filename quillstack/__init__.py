"""Spark-native retrieval, link-graph and version-store engine for collections of Markdown-like texts."""
