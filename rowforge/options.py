"""Options of ``enrich`` and every check that needs no data."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field, replace

from pydantic import BaseModel
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import check_dependency, env_is_set, missing_search_key
from .functions.text import template

#: Names under which a text column is looked for, in this order.
TEXT_COLUMNS = ("texto", "text", "decisao", "content", "content_text")
#: Keys of a field's ``json_schema_extra`` that ask for a call of its own.
FIELD_KEYS = ("prompt", "prompt_replace", "prompt_append", "search_depth", "max_results")
#: Requests a minute that search providers allow, about.
SEARCH_LIMITS = {"tavily": 100, "exa": 300}
MOST_CONCURRENT = 10
EXPORTS = (".csv", ".xlsx", ".parquet")


@dataclass(frozen=True)
class Group:
    """Fields that share one call."""

    fields: tuple[str, ...]
    prompt: str | None = None
    max_results: int | None = None
    search_depth: str | None = None


@dataclass(frozen=True)
class Search:
    provider: str = "tavily"
    per_field: bool = False
    max_results: int = 5
    depth: str = "basic"
    groups: dict[str, Group] = field(default_factory=dict)
    #: The provider itself, which travels with the plan: workers have no registry but that of the package.
    source: object = None

    def changed(self, depth: str | None, max_results: int | None) -> Search:
        return replace(self, depth=depth or self.depth, max_results=max_results or self.max_results)


@dataclass(frozen=True)
class Options:
    """All options, checked; ``prompt`` has its place for the text."""

    prompt: str
    resume: bool = True
    retry_errors: bool = False
    reprocess: tuple[str, ...] = ()
    model: str = "gemini-3-flash-preview"
    provider: object = "google_genai"
    status_column: str = "_status"
    text_column: str | None = None
    key: str | None = None
    api_key: str | None = None
    max_retries: int = 3
    base_delay: float = 1.0
    max_delay: float = 30.0
    rate_limit_delay: float = 0.0
    track_tokens: bool = True
    model_kwargs: dict = field(default_factory=dict)
    parallel_requests: int = 1
    search: Search | None = None
    trace: str | None = None
    batch_size: int | None = None
    checkpoint_path: str | None = None
    null_text: str = "error"
    dedup_calls: bool = False
    keep_status: bool = False


def checked(
    questions: type[BaseModel] | None = None,
    prompt: str | None = None,
    perguntas: type[BaseModel] | None = None,
    *,
    resume: bool = True,
    retry_errors: bool = False,
    reprocess_columns=None,
    model: str = "gemini-3-flash-preview",
    provider="google_genai",
    status_column: str | None = None,
    text_column: str | None = None,
    key: str | None = None,
    api_key: str | None = None,
    max_retries: int = 3,
    base_delay: float = 1.0,
    max_delay: float = 30.0,
    rate_limit_delay: float = 0.0,
    track_tokens: bool = True,
    model_kwargs: dict | None = None,
    parallel_requests: int = 1,
    use_search: bool = False,
    search_provider: str = "tavily",
    search_per_field: bool = False,
    max_results: int = 5,
    search_depth: str = "basic",
    search_groups: dict | None = None,
    save_trace=None,
    batch_size: int | None = None,
    checkpoint_path: str | None = None,
    null_text: str = "error",
    dedup_calls: bool = False,
    keep_status: bool = False,
) -> tuple[type[BaseModel], Options]:
    """The model and the options, or ``ValueError``: arguments, checkpoint, search, trace, model, groups, in this order."""
    from .search import get_provider

    questions = questions if questions is not None else perguntas
    if questions is None:
        raise ValueError("'questions' is needed")
    if prompt is None:
        raise ValueError("'prompt' is needed")
    if not _whole(max_retries):
        raise ValueError("max_retries must be an int >= 1")
    if not _whole(parallel_requests):
        raise ValueError("parallel_requests must be an int >= 1")
    if (batch_size is None) != (checkpoint_path is None):
        raise ValueError("batch_size and checkpoint_path go together")
    if batch_size is not None:
        if not _whole(batch_size):
            raise ValueError("batch_size must be an int >= 1")
        check_export(checkpoint_path)
    search = None
    if use_search:
        if provider == "agent_sdk":
            raise ValueError("web search does not work with provider='agent_sdk'")
        source = get_provider(search_provider)
        search_provider = source.name
        _depth(search_provider, search_depth, "search_depth")
        _results(max_results, "max_results")
        if source.package_name:
            check_dependency(source.package_name, source.install_name)
        if source.env_var and not env_is_set(source.env_var):
            raise ValueError(missing_search_key(source.name, source.env_var, source.signup_url))
        search = Search(search_provider, search_per_field, max_results, search_depth, source=source)
    trace = None
    if save_trace:
        if not use_search:
            raise ValueError("save_trace needs use_search=True")
        if save_trace not in (True, "full", "minimal"):
            raise ValueError("save_trace is True, 'full' or 'minimal'")
        trace = "full" if save_trace is True else save_trace
    if not questions.model_fields:
        raise ValueError("the model has no fields")
    if search_groups:
        groups = check_groups(search_groups, questions, use_search, search_per_field, search_provider)
        search = replace(search, groups=groups)
    reprocess = (reprocess_columns,) if isinstance(reprocess_columns, str) else tuple(reprocess_columns or ())
    if unknown := [c for c in reprocess if c not in questions.model_fields]:
        raise ValueError(f"columns {unknown} are not fields of the model: {list(questions.model_fields)}")
    if null_text not in ("error", "text"):
        raise ValueError("null_text is 'error' or 'text'")
    return questions, Options(
        template(prompt), resume, retry_errors, reprocess, model, provider, status_column or "_status", text_column, key, api_key, max_retries, base_delay,
        max_delay, rate_limit_delay, track_tokens, model_kwargs or {}, parallel_requests, search, trace, batch_size, checkpoint_path, null_text, dedup_calls, keep_status,
    )


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 1


def _depth(provider: str, depth: str, name: str) -> None:
    if provider == "tavily" and depth not in ("basic", "advanced"):
        raise ValueError(f"{name} is 'basic' or 'advanced'")


def _results(n: int, name: str) -> None:
    if not 1 <= n <= 20:
        raise ValueError(f"{name} is from 1 to 20")


def check_export(path: str) -> None:
    """A checkpoint's file ending and the package that writes it, before any call is made."""
    ending = os.path.splitext(path)[1].lower()
    if ending not in EXPORTS:
        raise ValueError(f"a checkpoint ends in one of {EXPORTS}, not '{ending}'")
    if ending == ".xlsx":
        check_dependency("openpyxl", "openpyxl")


def check_groups(groups: dict, model: type[BaseModel], use_search: bool, per_field: bool, provider: str = "tavily") -> dict[str, Group]:
    """Groups of fields that share a call: known fields, each in one group, without settings of their own."""
    if not use_search or not per_field:
        raise ValueError("search_groups needs use_search=True and search_per_field=True")
    taken: dict[str, str] = {}
    out = {}
    for name, given in groups.items():
        if not isinstance(given, dict) or not isinstance(given.get("fields"), list) or not given["fields"]:
            raise ValueError(f"group '{name}' must be a dict with a list 'fields'")
        for f in given["fields"]:
            if f not in model.model_fields:
                raise ValueError(f"group '{name}': '{f}' is not a field of the model: {list(model.model_fields)}")
            if f in taken:
                raise ValueError(f"field '{f}' is in the groups '{taken[f]}' and '{name}'")
            taken[f] = name
            extra = model.model_fields[f].json_schema_extra
            if isinstance(extra, dict) and (own := [k for k in (*FIELD_KEYS, "condition") if k in extra]):
                raise ValueError(f"field '{f}' of group '{name}' has settings of its own: {own}")
        if given.get("search_depth"):
            _depth(provider, given["search_depth"], f"group '{name}': search_depth")
        if given.get("max_results") is not None:
            _results(given["max_results"], f"group '{name}': max_results")
        out[name] = Group(tuple(given["fields"]), given.get("prompt"), given.get("max_results"), given.get("search_depth"))
    return out


def resolve_text_column(columns: list[str], wanted: str | None = None) -> str:
    """The text column: as named, else the first known name (a warning if there are several), else the only column."""
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"no column '{wanted}' in {columns}")
        return wanted
    known = [c for c in TEXT_COLUMNS if c in columns]
    if len(known) > 1:
        warnings.warn(f"several columns may hold the text: {known}; '{known[0]}' is taken, pass text_column= to choose", UserWarning, stacklevel=3)
    if known:
        return known[0]
    if len(columns) == 1:
        return columns[0]
    raise ValueError(f"none of {TEXT_COLUMNS} is a column; pass text_column=, one of {columns}")


@dataclass(frozen=True)
class RateEstimate:
    """Searches that run at once and a minute, whether that is risky, and what would not be."""

    total: int
    concurrent: int
    per_minute: float
    risky: bool
    parallel_requests: int
    delay: float


def search_rate(rows: int, fields: int, parallel: int, per_field: bool, delay: float, provider: str = "tavily") -> RateEstimate:
    """Risky: more than ``MOST_CONCURRENT`` at once, or more than 80 % of the provider's limit."""
    limit = SEARCH_LIMITS.get(provider, SEARCH_LIMITS["tavily"])
    each = fields if per_field else 1
    rate = (60 / delay if delay > 0 else 60) * parallel * each
    better = max(1, MOST_CONCURRENT // each) if per_field else max(1, min(parallel, MOST_CONCURRENT))
    wait = max(0.5, round(60 * better * each / (limit * 0.7), 1))
    return RateEstimate(rows * each, parallel * each, rate, parallel * each > MOST_CONCURRENT or rate > limit * 0.8, better, wait)


def search_rate_columns(fields: Column, parallel: Column, per_field: Column, delay: Column, provider: Column) -> dict[str, Column]:
    """``search_rate`` over columns: concurrent, per_minute, risky."""
    limit = F.when(provider == "exa", SEARCH_LIMITS["exa"]).otherwise(SEARCH_LIMITS["tavily"])
    each = F.when(per_field, fields).otherwise(1)
    rate = F.when(delay > 0, 60 / delay).otherwise(F.lit(60.0)) * parallel * each
    return {"concurrent": parallel * each, "per_minute": rate, "risky": (parallel * each > MOST_CONCURRENT) | (rate > limit * 0.8)}


def warn_search_rate(rows: int, fields: int, options: Options) -> None:
    s = options.search
    if s is None or not getattr(s.source, "package_name", s.provider) or not (options.parallel_requests > 1 or (s.per_field and fields * rows > 100)):
        return
    r = search_rate(rows, fields, options.parallel_requests, s.per_field, options.rate_limit_delay, s.provider)
    if r.risky:
        warnings.warn(
            f"{r.concurrent} searches at once, about {r.per_minute:.0f} a minute, {r.total} in all, may pass the limit of {s.provider} "
            f"(about {SEARCH_LIMITS.get(s.provider, SEARCH_LIMITS['tavily'])} a minute); use parallel_requests={r.parallel_requests}, rate_limit_delay={r.delay}",
            UserWarning,
            stacklevel=3,
        )
