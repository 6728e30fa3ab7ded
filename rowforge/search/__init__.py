"""Search providers, by name."""

from .base import SearchProvider, get_available_providers, get_provider, register_provider
from .corpus import CorpusSearch
from .web import ExaProvider, TavilyProvider

register_provider(TavilyProvider())
register_provider(ExaProvider())
register_provider(CorpusSearch())

__all__ = ["CorpusSearch", "ExaProvider", "SearchProvider", "TavilyProvider", "get_available_providers", "get_provider", "register_provider"]
