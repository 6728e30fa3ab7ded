"""What a search provider is, and the registry."""

from __future__ import annotations

from abc import ABC, abstractmethod


class SearchProvider(ABC):
    """A source of search results for agents. Instances go to the executors, so they hold plain data only."""

    name: str
    env_var: str | None = None
    package_name: str | None = None
    install_name: str | None = None
    signup_url: str = ""

    @abstractmethod
    def create_tool(self, max_results: int, **options):
        """The tool that an agent calls with a query."""

    @abstractmethod
    def calculate_credits(self, search_count: int, **options) -> int:
        """The price of some searches."""

    def get_tool_name_pattern(self) -> str:
        return self.name


_known: dict[str, SearchProvider] = {}


def register_provider(provider: SearchProvider) -> None:
    _known[provider.name] = provider


def get_provider(name: str | SearchProvider) -> SearchProvider:
    """A provider by its name, or a provider as it is. On the driver alone: tasks get the object that was found here."""
    if isinstance(name, SearchProvider):
        return name
    if name not in _known:
        raise ValueError(f"search_provider is one of {get_available_providers()}, not '{name}'")
    return _known[name]


def get_available_providers() -> list[str]:
    return sorted(_known)
