"""Model providers, by name or as objects."""

from .base import Answer, Client, Provider, find_provider
from .rules import ReplyProvider, RuleProvider

__all__ = ["Answer", "Client", "Provider", "ReplyProvider", "RuleProvider", "find_provider"]
