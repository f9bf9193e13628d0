"""vellumix: a corpus-scale document engine on PySpark."""
