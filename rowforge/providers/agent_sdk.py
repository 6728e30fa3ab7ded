"""A model by a command-line agent's optional SDK: JSON by instruction, one turn, no search."""

from __future__ import annotations

import asyncio
import json

from ..errors import check_dependency
from ..functions.text import parse_json
from ..functions.usage import no_usage
from ..options import Options
from .base import Answer, Client, Provider

_PACKAGE = ("claude_agent_sdk", "claude-agent-sdk")


def system_prompt(schema: dict) -> str:
    """Instructions to answer with nothing but JSON of a schema."""
    shown = json.dumps(schema, indent=2, ensure_ascii=False)
    return f"You extract data. Answer with one JSON object that fits this schema, without any text or code fence around it.\n\nJSON Schema:\n{shown}"


class AgentSdkProvider(Provider):
    name = "agent_sdk"

    def check(self, options: Options) -> None:
        check_dependency(*_PACKAGE)

    def open(self, options: Options) -> Client:
        check_dependency(*_PACKAGE)
        return _AgentClient(options)


class _AgentClient(Client):
    def __init__(self, options: Options):
        self.options = options

    def ask(self, prompt, model, text, known) -> Answer:
        import claude_agent_sdk as sdk

        settings = {"max_turns": 1, "max_budget_usd": 0.5} | self.options.model_kwargs
        reply, cost = asyncio.run(_query(sdk, prompt, sdk.ClaudeAgentOptions(model=self.options.model, system_prompt=system_prompt(model.model_json_schema()), **settings)))
        return Answer(model.model_validate(parse_json(reply)), no_usage() | {"cost_usd": cost})


async def _query(sdk, prompt: str, options) -> tuple[str, float | None]:
    """The text blocks of the answer, and its cost."""
    text, cost = [], None
    async for message in sdk.query(prompt=prompt, options=options):
        if isinstance(message, sdk.AssistantMessage):
            text += [b.text for b in message.content if isinstance(b, sdk.TextBlock)]
        elif isinstance(message, sdk.ResultMessage):
            cost = getattr(message, "total_cost_usd", None)
    return "".join(text), cost
