"""quillmill: a PySpark-native engine for checking and processing page-level text."""
