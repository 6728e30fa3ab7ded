"""The public names."""

from .functions.schema import complex_fields
from .functions.text import normalize_columns, normalize_value
from .operators.enrich import enrich, enrich_with_stats
from .sources.readers import read_table
from .streaming.enrich_stream import enrich_stream

__all__ = ["complex_fields", "enrich", "enrich_stream", "enrich_with_stats", "normalize_columns", "normalize_value", "read_table"]
