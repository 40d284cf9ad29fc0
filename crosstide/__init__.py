"""Panel analytics on PySpark: entity-by-date features, cross-sections, graphs, splits, evaluation."""
