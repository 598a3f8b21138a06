"""wordloom: corpus-frequency and word-structure analytics as PySpark DataFrame operators."""
