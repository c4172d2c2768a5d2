"""Hierarchical vocabulary analytics, expressed as Spark DataFrame plans."""
