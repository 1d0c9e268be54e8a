"""Functions over SQL texts: in Python, and as functions of Spark SQL once registered."""

from querymill.operators.audit import collect_features, detect_antipatterns, register

__all__ = ["collect_features", "detect_antipatterns", "register"]
