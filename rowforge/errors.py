"""Classes of provider errors, retries, and messages that say what to do."""

from __future__ import annotations

import importlib.util
import os
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of "Type: message", without regard to case, that make another attempt useless; all else is worth one.
NOT_RECOVERABLE = (
    "AuthenticationError", "InvalidAPIKey", "PermissionDenied", "InvalidArgument", "NotFound", "401", "403", "404", "MissingAPIKeyError",
    "InvalidAPIKeyError", "BadRequestError",
)
RATE_LIMIT = ("ratelimit", "resourceexhausted", "toomanyrequests", "429")

# How results read in the error column.
FAILED, HOPELESS, RETRIED = "[Falhou após {n} tentativa(s)] {error}", "[Erro não-recuperável] {error}", "Sucesso após {n} retry(s)"


def described(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


def _pattern(parts: tuple[str, ...], whole_numbers: bool) -> str:
    return "|".join(rf"(?<!\d){p}(?!\d)" if whole_numbers and p.isdigit() else re.escape(p.lower()) for p in parts)


def is_recoverable(error: BaseException | str, whole_numbers: bool = False) -> bool:
    """Whether another attempt may help: not if a hopeless part occurs; else yes, known part or not.

    ``whole_numbers``: status codes count only where no digit touches them.
    """
    text = (error if isinstance(error, str) else described(error)).lower()
    return not re.search(_pattern(NOT_RECOVERABLE, whole_numbers), text)


def is_rate_limit(error: BaseException | str) -> bool:
    text = (error if isinstance(error, str) else described(error)).lower()
    return any(p in text for p in RATE_LIMIT)


def recoverable_column(message: Column, whole_numbers: bool = False) -> Column:
    """``is_recoverable`` over a column of "Type: message"."""
    return ~F.lower(message).rlike(_pattern(NOT_RECOVERABLE, whole_numbers))


def rate_limit_column(message: Column) -> Column:
    return F.lower(message).rlike("|".join(RATE_LIMIT))


#: Kind of an error, by the first row with a part that occurs (and, where given, a second one).
_KINDS: tuple[tuple[str, str, str], ...] = (
    ("authentication", "authenticationerror|invalidapikey|401|api_key|api key", ""),
    ("permission", "permissiondenied|403|forbidden", ""),
    ("rate_limit", "ratelimit|resourceexhausted|toomanyrequests|429", ""),
    ("timeout", "timeout|deadlineexceeded|504", ""),
    ("connection", "connectionerror|connectionreset|sslerror|network", ""),
    ("search_key", r"tavily|\bexa\b", "apikey|api_key|missing|invalid|unauthorized"),
    ("search_quota", "usagelimitexceeded", ""),
    ("search_quota", r"tavily|\bexa\b", "limit|quota|exceeded"),
)


def error_kind(error: BaseException | str) -> str:
    text = (error if isinstance(error, str) else described(error)).lower()
    return next((k for k, a, b in _KINDS if re.search(a, text) and re.search(b, text)), "other")


def error_kind_column(message: Column) -> Column:
    text, out = F.lower(message), F.lit("other")
    for kind, a, b in reversed(_KINDS):
        out = F.when(text.rlike(a) & (text.rlike(b) if b else F.lit(True)), kind).otherwise(out)
    return out


@dataclass(frozen=True)
class ProviderInfo:
    """What is needed to use a provider; ``env`` is None where credentials come from the vendor's own tools."""

    name: str
    package: str | None
    install: str | None
    env: str | None
    hint: str = ""


# Providers whose package, variable or name does not follow the rule.
_AWS = "aws configure, or export AWS_ACCESS_KEY_ID and AWS_SECRET_ACCESS_KEY"
_SPECIAL = {
    "google_vertexai": ProviderInfo("Google Vertex AI", "langchain_google_vertexai", "langchain-google-vertexai", None, "gcloud auth application-default login, or export GOOGLE_APPLICATION_CREDENTIALS"),
    "bedrock": ProviderInfo("AWS Bedrock", "langchain_aws", "langchain-aws", None, _AWS),
    "bedrock_converse": ProviderInfo("AWS Bedrock (Converse)", "langchain_aws", "langchain-aws", None, _AWS),
    "azure_openai": ProviderInfo("Azure OpenAI", "langchain_openai", "langchain-openai", "AZURE_OPENAI_API_KEY", "export AZURE_OPENAI_ENDPOINT and OPENAI_API_VERSION too"),
}
_NAMES = {"google_genai": "Google Gemini", "openai": "OpenAI", "anthropic": "Anthropic", "cohere": "Cohere", "mistralai": "Mistral AI", "fireworks": "Fireworks AI", "together": "Together AI", "groq": "Groq"}
_ALIASES = {"mistral": "mistralai"}
_ENV = {"mistralai": "MISTRAL_API_KEY"}


def provider_info(provider: str | None) -> ProviderInfo:
    """By rule: package langchain_<provider>, variable <PROVIDER>_API_KEY; some are special."""
    if not provider:
        return ProviderInfo("LLM", None, None, "API_KEY")
    provider = _ALIASES.get(provider, provider)
    if provider in _SPECIAL:
        return _SPECIAL[provider]
    package = f"langchain_{provider}"
    env = _ENV.get(provider) or provider.replace("_genai", "").replace("_ai", "").upper() + "_API_KEY"
    return ProviderInfo(_NAMES.get(provider, provider.replace("_", " ").title()), package, package.replace("_", "-"), env)


def check_dependency(package: str, install: str) -> None:
    """``ImportError`` with what to install if a package is not there."""
    if importlib.util.find_spec(package) is None:
        raise ImportError(missing_package(package, install))


def check_provider(provider: str) -> None:
    """The packages that a provider of the optional backend needs."""
    info = provider_info(provider)
    for package, install in (("langchain", "langchain"), ("langchain_core", "langchain-core"), (info.package, info.install)):
        if package:
            check_dependency(package, install)


def missing_package(name: str, install: str) -> str:
    return _box(f"{name} needs a package that is not installed", [f"pip install {install}"])


def missing_search_key(name: str, env: str, url: str) -> str:
    return _box(f"{name}: no key for web search", [f"get one at {url}", f'export {env}="..."'])


def _box(title: str, lines: list[str]) -> str:
    width = max(map(len, [title, *lines])) + 4
    rule = "+" + "-" * width + "+"
    return "\n".join([rule, f"|  {title:<{width - 2}}|", rule, *[f"|    {x:<{width - 4}}|" for x in lines], rule])


_ADVICE = {
    "authentication": ("authentication failed", ["the key is missing or wrong", "{auth}"]),
    "permission": ("no permission", ["the key has no access to this model", "check the plan and the model's name"]),
    "rate_limit": ("too many requests", ["lower parallel_requests", "raise rate_limit_delay", "resume later: finished rows are kept"]),
    "timeout": ("no answer in time", ["try again", "raise max_retries"]),
    "connection": ("no connection", ["check the network and any proxy"]),
    "search_key": ("web search: key missing or wrong", ["set the search provider's key"]),
    "search_quota": ("web search: quota used up", ["wait, or raise the plan", "lower max_results"]),
}


def friendly_message(error: BaseException | str, provider: str | None = None) -> str:
    """What happened and what to do, in a box; an unknown error as it is. ``error`` may be "Type: message"."""
    info, kind = provider_info(provider), error_kind(error)
    said = error if isinstance(error, str) else described(error)
    if kind == "other":
        return f"{info.name}: {said}"
    title, lines = _ADVICE[kind]
    auth = f'export {info.env}="..."' if info.env else info.hint
    return _box(f"{info.name}: {title}", [x.replace("{auth}", auth) for x in lines] + [said[:160]])


@dataclass
class Outcome:
    """The end of some attempts: a value or an error, and the retries before it."""

    value: object = None
    error: Exception | None = None
    retries: int = 0
    hopeless: bool = False

    def details(self) -> str | None:
        """The text of the error column."""
        if self.error is None:
            return RETRIED.format(n=self.retries) if self.retries else None
        form = HOPELESS if self.hopeless else FAILED
        return form.format(n=self.retries + 1, error=described(self.error))


def attempt(call: Callable[[], object], most: int = 3, base: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Call until it works, ``most`` times at most, waiting min(base * 2 ** k, longest) and up to a tenth more between.

    Only ``Exception`` is held; what ends the process passes.
    """
    for k in range(most):
        try:
            return Outcome(call(), None, k)
        except Exception as e:  # noqa: BLE001
            if not is_recoverable(e):
                return Outcome(None, e, k, True)
            if k + 1 == most:
                return Outcome(None, e, k)
            wait = min(base * 2**k, longest)
            sleep(wait + random.uniform(0, wait / 10))
    raise ValueError("at least one attempt is needed")


def env_is_set(name: str) -> bool:
    return bool(os.environ.get(name))
