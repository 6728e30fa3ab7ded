"""Web search by two vendors, for agents of the optional backend."""

from __future__ import annotations

from ..errors import check_dependency
from .base import SearchProvider


# Names, packages, variables, arguments and prices of the two vendors.


class TavilyProvider(SearchProvider):
    """One credit a search, two if it is advanced."""

    name, env_var, package_name, install_name, signup_url = "tavily", "TAVILY_API_KEY", "langchain_tavily", "langchain-tavily", "https://app.tavily.com"

    def create_tool(self, max_results: int, search_depth: str = "basic", **options):
        check_dependency(self.package_name, self.install_name)
        from langchain_tavily import TavilySearch

        return TavilySearch(max_results=max_results, search_depth=search_depth, include_raw_content=False, include_answer=False)

    def calculate_credits(self, search_count: int, search_depth: str = "basic", **options) -> int:
        return search_count * (2 if search_depth == "advanced" else 1)


class ExaProvider(SearchProvider):
    """One credit a search of up to 25 results, else five; depth is ignored."""

    name, env_var, package_name, install_name, signup_url = "exa", "EXA_API_KEY", "langchain_exa", "langchain-exa", "https://dashboard.exa.ai"

    def create_tool(self, max_results: int, **options):
        check_dependency(self.package_name, self.install_name)
        from langchain_exa import ExaSearchResults

        return ExaSearchResults(num_results=max_results, text_contents_options={"max_characters": 1000})

    def calculate_credits(self, search_count: int, max_results: int = 5, **options) -> int:
        return search_count * (1 if max_results <= 25 else 5)
