"""Answers by rules instead of a language model: the same for the same text, without a network."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import parse_json
from ..options import Options, Search
from .base import Answer, Client, Provider


class RuleProvider(Provider):
    """``rules``: for each field name a function of (text, fields so far), of (text, fields so far, prompt) or of
    (text, fields so far, prompt, what was found), or a value.

    Tokens are counted as a fourth of the characters, rounded up: of the text for input, one for each field for
    output. With search, each call makes one search: for what ``query`` makes of (text, field names), else for the fields'
    names. The tool of a search provider that needs no package is called; of others nothing is found. ``fail`` is called
    first with the text and may raise.
    """

    name = "rules"

    def __init__(self, rules: dict[str, object], fail: Callable[[str], None] | None = None, reasoning: int = 0, query: Callable[[str, list[str]], str] | None = None):
        self.rules, self.fail, self.reasoning, self.query = rules, fail, reasoning, query

    def open(self, options: Options) -> Client:
        return _RuleClient(self)


class ReplyProvider(Provider):
    """Replies as text, whose JSON is read as that of a model's reply. ``reply``: a function of the prompt."""

    name = "replies"

    def __init__(self, reply: Callable[[str], object]):
        self.reply = reply

    def open(self, options: Options) -> Client:
        return _ReplyClient(self)


class _ReplyClient(Client):
    def __init__(self, provider: ReplyProvider):
        self.p = provider

    def ask(self, prompt, model, text, known) -> Answer:
        return Answer(model.model_validate(parse_json(self.p.reply(prompt))))


class _RuleClient(Client):
    def __init__(self, provider: RuleProvider):
        self.p = provider

    def _values(self, model, text: str, known: dict, prompt: str, found: list) -> dict:
        if self.p.fail:
            self.p.fail(text)
        out = {}
        for name in model.model_fields:
            rule = self.p.rules.get(name)
            if callable(rule):
                n = rule.__code__.co_argcount
                rule = rule(*(text, {**known, **out}, prompt, found)[:n])
            out[name] = rule
        return out

    def ask(self, prompt, model, text, known) -> Answer:
        return Answer(self._values(model, text, known, prompt, []), self._meta(model, text))

    def _meta(self, model, text: str) -> dict:
        asked, said = (len(text) + 3) // 4, len(model.model_fields)
        return {"input_tokens": asked, "output_tokens": said, "total_tokens": asked + said, "output_token_details": {"reasoning": self.p.reasoning}}

    def search(self, prompt, model, search: Search, text, known) -> Answer:
        names = list(model.model_fields)
        query = self.p.query(text, names) if self.p.query else ", ".join(names)
        offline = search.source is not None and not search.source.package_name
        found = search.source.create_tool(search.max_results, search_depth=search.depth)(query) if offline else []
        values = self._values(model, text, known, prompt, found)
        call = {"name": f"{search.provider}_search", "args": {"query": query}, "id": "1", "type": "tool_call"}
        return Answer(
            values,
            None,
            [
                {"type": "human", "content": prompt},
                {"type": "ai", "content": "", "tool_calls": [call], "usage_metadata": self._meta(model, text)},
                {"type": "tool", "content": "\n".join(found), "tool_call_id": "1"},
                {"type": "ai", "content": str(values)},
            ],
        )
