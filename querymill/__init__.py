"""querymill: a PySpark engine that audits and prepares natural-language-to-SQL corpora."""

__version__ = "0.1.0"
