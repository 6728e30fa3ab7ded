"""rowforge: structured enrichment of text tables, as one Spark operator and plain DataFrame code around it."""

from .api import *  # noqa: F403
from .api import __all__ as __all__
