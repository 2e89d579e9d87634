"""convsift — search and file-lineage analytics over assistant conversation
histories, expressed as Spark DataFrame plans."""

from .model import History, MATCH_COLUMNS, TRACE_COLUMNS
from .session import get_spark

__all__ = ["History", "MATCH_COLUMNS", "TRACE_COLUMNS", "get_spark"]
__version__ = "0.1.0"
