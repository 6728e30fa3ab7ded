"""Tokens, searches, credits and traces of calls."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = ("input_tokens", "output_tokens", "total_tokens", "reasoning_tokens", "search_credits", "search_count")


#: What some providers say a call cost, in dollars; a column of the result's own, null where no call says it.
COST = "cost_usd"


def no_usage() -> dict[str, int]:
    return dict.fromkeys(COUNTS, 0)


def add_usage(total: dict[str, int], more: dict | None) -> None:
    for k in COUNTS:
        total[k] += (more or {}).get(k) or 0
    if (more or {}).get(COST) is not None:
        total[COST] = total.get(COST, 0.0) + more[COST]


def _get(x, name: str, default=None):
    return x.get(name, default) if isinstance(x, dict) else getattr(x, name, default)


def usage_of(meta) -> dict[str, int]:
    """Token counts of a message's metadata, a dict or an object."""
    out = no_usage()
    if meta:
        for k in COUNTS[:3]:
            out[k] = _get(meta, k, 0) or 0
        out["reasoning_tokens"] = _get(_get(meta, "output_token_details") or {}, "reasoning", 0) or 0
    return out


def is_search(tool: str, pattern: str | None = None) -> bool:
    """One rule for usage and traces: a tool named for search or for its provider."""
    return "search" in tool.lower() or bool(pattern and pattern in tool.lower())


def agent_usage(messages: list, provider, depth: str, max_results: int) -> dict[str, int]:
    """Sums of the messages' tokens, the searches they asked for, and their price in credits."""
    out = no_usage()
    for m in messages:
        add_usage(out, usage_of(_get(m, "usage_metadata")))
        out["search_count"] += sum(is_search(_get(t, "name", ""), provider.get_tool_name_pattern()) for t in _get(m, "tool_calls") or [])
    out["search_credits"] = provider.calculate_credits(out["search_count"], search_depth=depth, max_results=max_results)
    return out


def trace_of(messages: list, model: str, seconds: float, mode: str, provider=None) -> dict:
    """What was said and searched. "minimal" leaves out what tools answered."""
    pattern = provider.get_tool_name_pattern() if provider else None
    out = {"messages": [], "search_queries": [], "total_tool_calls": 0, "duration_seconds": round(seconds, 3), "model": model, "search_provider": provider.name if provider else None}
    for m in messages:
        kind = _get(m, "type")
        said = {"type": kind, "content": "[omitted]" if kind == "tool" and mode == "minimal" else _get(m, "content")}
        if calls := _get(m, "tool_calls"):
            said["tool_calls"] = [{"name": _get(t, "name", ""), "args": _get(t, "args", {}), "id": _get(t, "id", ""), "type": _get(t, "type", "tool_call")} for t in calls]
            for t in said["tool_calls"]:
                if is_search(t["name"], pattern):
                    out["total_tool_calls"] += 1
                    if query := t["args"].get("query"):
                        out["search_queries"].append(query)
        if _get(m, "tool_call_id"):
            said["tool_call_id"] = _get(m, "tool_call_id")
        out["messages"].append(said)
    return out


def trace_json(trace) -> str | None:
    return json.dumps(trace, ensure_ascii=False, default=str) if trace else None


def tavily_credits(count: Column, depth: Column) -> Column:
    return count * F.when(depth == "advanced", 2).otherwise(1)


def exa_credits(count: Column, max_results: Column) -> Column:
    return count * F.when(max_results <= 25, 1).otherwise(5)
