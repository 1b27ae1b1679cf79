"""casegraph: corpus and entity-graph analytics as PySpark DataFrame operators."""
