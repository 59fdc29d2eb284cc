"""reposcope: a PySpark-native engine for corpora of source-code repositories.

Every operator is a DataFrame -> DataFrame transform (no actions) unless it is
explicitly iterative (graph ranks, label model) or fits a Spark ML model.
"""

from reposcope.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
