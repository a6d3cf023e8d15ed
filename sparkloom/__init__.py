"""sparkloom: a PySpark engine for auditable preparation of language-model training data."""
