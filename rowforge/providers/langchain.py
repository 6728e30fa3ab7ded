"""Language models by the optional langchain packages, which are not part of this repository's environment."""

from __future__ import annotations

from ..errors import check_provider
from ..functions.usage import usage_of
from ..options import Options, Search
from .base import Answer, Client, Provider


class LangChainProvider(Provider):
    def __init__(self, provider: str):
        self.name = provider

    def check(self, options: Options) -> None:
        check_provider(self.name)

    def open(self, options: Options) -> Client:
        check_provider(self.name)
        return _LangChainClient(self.name, options)


class _LangChainClient(Client):
    def __init__(self, provider: str, options: Options):
        from langchain.chat_models import init_chat_model

        settings = {"temperature": 0} | ({"api_key": options.api_key} if options.api_key else {}) | options.model_kwargs
        self.llm = init_chat_model(options.model, model_provider=provider, **settings)
        self.structured: dict = {}
        self.agents: dict = {}

    def ask(self, prompt, model, text, known) -> Answer:
        if model not in self.structured:
            self.structured[model] = self.llm.with_structured_output(model, include_raw=True)
        result = self.structured[model].invoke(prompt)
        if result.get("parsing_error"):
            raise ValueError(f"the answer does not parse: {result['parsing_error']}")
        if result.get("parsed") is None:
            raise ValueError("no structured answer")
        return Answer(result["parsed"], usage_of(getattr(result.get("raw"), "usage_metadata", None)))

    def search(self, prompt, model, search: Search, text, known) -> Answer:
        from langchain.agents import create_agent

        key = (model, search.provider, search.depth, search.max_results)
        if key not in self.agents:
            tool = search.source.create_tool(search.max_results, search_depth=search.depth)
            self.agents[key] = create_agent(self.llm, [tool], response_format=model)
        result = self.agents[key].invoke({"messages": [{"role": "user", "content": prompt}]})
        if result.get("structured_response") is None:
            raise ValueError("the agent gave no structured answer")
        return Answer(result["structured_response"], None, result.get("messages", []))
