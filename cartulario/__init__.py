"""cartulario: a PySpark-native analytics engine for citation-rich document corpora."""
