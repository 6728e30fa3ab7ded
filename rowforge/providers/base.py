"""What a model provider is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pydantic import BaseModel

from ..options import Options, Search


@dataclass
class Answer:
    """An answer's values, and the tokens it took; of an agent, the messages that led to it."""

    data: dict | BaseModel | None
    usage: dict | None = None
    messages: list = field(default_factory=list)


class Client:
    """A connection, opened once for each task and used by its threads."""

    def ask(self, prompt: str, model: type[BaseModel], text: str, known: dict) -> Answer:
        """A structured answer. ``text`` and ``known`` (fields so far) are for providers without a language model."""
        raise NotImplementedError

    def search(self, prompt: str, model: type[BaseModel], search: Search, text: str, known: dict) -> Answer:
        """The same by an agent that may search."""
        raise NotImplementedError


class Provider:
    """Opens clients. Instances go to the executors, so they hold plain data only."""

    name = "provider"

    def check(self, options: Options) -> None:
        """Raise if something that is needed is not there; called on the driver before any work."""

    def open(self, options: Options) -> Client:
        raise NotImplementedError


def find_provider(given) -> Provider:
    """A provider object as it is; a name as the optional backend that serves it."""
    if isinstance(given, Provider):
        return given
    if given == "agent_sdk":
        from .agent_sdk import AgentSdkProvider

        return AgentSdkProvider()
    from .langchain import LangChainProvider

    return LangChainProvider(given)
