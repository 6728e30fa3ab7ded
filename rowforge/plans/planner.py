"""The calls that fill a model's fields, planned once on the driver.

A plan is a list of steps: one for all fields, or one for each field or group, in an order in which every field comes
after those that its condition reads. It is plain data, so it is the same on the driver and in every task.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pydantic import BaseModel

from ..functions.schema import list_item_model, models_in
from ..options import FIELD_KEYS, Options, Search

# Sentences that prompts are made of.
ONLY_FIELD = "\n\nResponda APENAS o campo: {name}"
ONLY_FIELDS = "\n\nResponda os campos: {names}"
ABOUT_FIELD = "Pesquise informações para preencher o campo '{path}'"
ABOUT_ITEM = "Pesquise informações para: {item}"
CONTEXT = "\n\nContexto de buscas realizadas para campos aninhados:\n"
GROUP_TEXT = "\n\nTexto: {texto}"


@dataclass(frozen=True)
class FieldConfig:
    prompt: str | None = None
    append: str | None = None
    depth: str | None = None
    max_results: int | None = None
    depends_on: tuple[str, ...] = ()
    condition: object = None


def field_config(extra) -> FieldConfig:
    if not isinstance(extra, dict):
        return FieldConfig()
    needs = extra.get("depends_on") or ()
    needs = (needs,) if isinstance(needs, str) else tuple(needs)
    if (n := extra.get("max_results")) is not None and not 1 <= n <= 20:
        raise ValueError("a field's max_results is from 1 to 20")
    return FieldConfig(extra.get("prompt") or extra.get("prompt_replace"), extra.get("prompt_append"), extra.get("search_depth"), n, needs, extra.get("condition"))


def has_field_config(model: type[BaseModel], keys=FIELD_KEYS, path: tuple = ()) -> bool:
    """Whether a field, at any depth, has one of the keys."""
    if model in path:
        return False
    for f in model.model_fields.values():
        if isinstance(f.json_schema_extra, dict) and any(k in f.json_schema_extra for k in keys):
            return True
        if any(has_field_config(m, keys, (*path, model)) for m in models_in(f.annotation)):
            return True
    return False


def field_prompt(base: str, name: str, description: str | None, config: FieldConfig) -> str:
    """A field's own prompt, or the base with the field's name, description and addition."""
    if config.prompt:
        return config.prompt
    out = base + ONLY_FIELD.format(name=name) + (f" ({description})" if description else "")
    return out + (f"\n\n{config.append}" if config.append else "")


# -- order --


def dependencies(name: str, config: FieldConfig) -> list[str]:
    """The fields that a field's condition reads, by the first part of their paths."""
    if config.condition is None:
        if config.depends_on:
            warnings.warn(f"field '{name}': depends_on without a condition has no effect", UserWarning, stacklevel=2)
        return []
    roots = [d.split(".")[0] for d in config.depends_on]
    if isinstance(config.condition, dict):
        if config.condition.get("field"):
            roots.append(config.condition["field"].split(".")[0])
    elif not roots:
        warnings.warn(f"field '{name}': a callable condition without depends_on may run before what it reads", UserWarning, stacklevel=2)
    return list(dict.fromkeys(roots))


def find_cycle(needs: dict[str, list[str]]) -> list[str] | None:
    """A path from a field back to itself, if there is one."""
    done: set[str] = set()
    for start in needs:
        path: list[str] = []
        stack = [(start, iter(needs.get(start, ())))] if start not in done else []
        while stack:
            name, rest = stack[-1]
            if not path or path[-1] != name:
                path.append(name)
            following = next(rest, None)
            if following is None:
                stack.pop()
                path.pop()
                done.add(name)
            elif following in path:
                return path[path.index(following) :] + [following]
            elif following not in done:
                stack.append((following, iter(needs.get(following, ()))))
    return None


def execution_order(needs: dict[str, list[str]]) -> list[str]:
    """Every field after those it needs; among free ones the order of definition."""
    for name, of in needs.items():
        if missing := [d for d in of if d not in needs]:
            raise ValueError(f"field '{name}' depends on {missing}, which are not fields of the model")
    if cycle := find_cycle(needs):
        raise ValueError("fields depend on each other: " + " -> ".join(cycle))
    out: list[str] = []
    left = list(needs)
    while left:
        free = next(n for n in left if all(d in out for d in needs[n]))
        out.append(free)
        left.remove(free)
    return out


# -- nested fields --


@dataclass(frozen=True)
class Nested:
    """A configured field inside another: its path and the model that has it."""

    path: str
    name: str
    owner: type[BaseModel]


def configured_fields(model: type[BaseModel], prefix: str = "", path: tuple = ()) -> list[Nested]:
    """All fields with keys of ``FIELD_KEYS``, at any depth; a model that contains itself is entered once on a path."""
    if model in path:
        return []
    out = []
    for name, f in model.model_fields.items():
        here = f"{prefix}{name}"
        if isinstance(f.json_schema_extra, dict) and any(k in f.json_schema_extra for k in FIELD_KEYS):
            out.append(Nested(here, name, model))
        for inner in models_in(f.annotation):
            out += configured_fields(inner, f"{here}.", (*path, model))
    return out


def searched_lists(model: type[BaseModel]) -> dict[str, list[Nested]]:
    """Fields that are lists of models with configured fields: those fields, by paths inside an item."""
    out = {}
    for name, f in model.model_fields.items():
        if (item := list_item_model(f.annotation)) and (found := configured_fields(item)):
            out[name] = found
    return out


def set_nested(target: dict, path: str, value) -> None:
    """Write at a dotted path; what is in the way and not a dict is replaced by one."""
    *way, last = path.split(".")
    for part in way:
        if not isinstance(target.get(part), dict):
            target[part] = {}
        target = target[part]
    target[last] = value


def item_context(item: dict, model: type[BaseModel], most: int = 3) -> str:
    """The first plain values of a list item, as text that names it."""
    plain = [f"{n}: {item[n]}" for n in model.model_fields if item.get(n) is not None and not isinstance(item[n], (dict, list))]
    return ", ".join(plain[:most]) or "item"


# -- the plan --


@dataclass(frozen=True)
class Step:
    """One call. ``owner`` and ``fields`` give its answer's model; ``trace`` names its trace.

    ``nested`` are calls made before it, for fields inside its own; ``items`` calls made after it, for each item.
    """

    kind: str
    owner: type[BaseModel]
    fields: tuple[str, ...]
    prompt: str
    trace: str
    search: Search | None = None
    condition: object = None
    nested: tuple[Step, ...] = ()
    items: tuple[Step, ...] = ()
    path: str = ""


@dataclass(frozen=True)
class CallPlan:
    model: type[BaseModel]
    steps: tuple[Step, ...]
    traces: tuple[str, ...] = field(default=())


def trace_column(name: str) -> str:
    """The column of a trace; paths are joined with two underscores."""
    return "_trace_" + name.replace(".", "__")


def compile_plan(model: type[BaseModel], options: Options) -> CallPlan:
    """The steps of a model under some options, or ``ValueError`` where they do not fit."""
    search, base = options.search, options.prompt
    per_field = search is not None and search.per_field
    if not per_field and has_field_config(model, (*FIELD_KEYS, "condition")):
        raise ValueError("fields with prompts, searches or conditions of their own need search_per_field=True")
    every = tuple(model.model_fields)
    if not per_field:
        return CallPlan(model, (Step("single", model, every, base, "", search),), ("_trace",) if options.trace else ())
    steps = _grouped(model, base, search) if search.groups else _by_field(model, base, search)
    names = [n for s in steps for n in (*[x.trace for x in s.nested], s.trace, *([f"{s.trace}_items"] if s.items else []))]
    return CallPlan(model, tuple(steps), tuple(trace_column(n) for n in names) if options.trace else ())


def _own(model: type[BaseModel], name: str, base: str, search: Search, **more) -> Step:
    info = model.model_fields[name]
    config = field_config(info.json_schema_extra)
    return Step("field", model, (name,), field_prompt(base, name, info.description, config), name, search.changed(config.depth, config.max_results), config.condition, **more)


def _inner(kind: str, n: Nested, base: str, search: Search, trace: str) -> Step:
    info = n.owner.model_fields[n.name]
    config = field_config(info.json_schema_extra)
    prompt = field_prompt(base, n.name, info.description, config)
    return Step(kind, n.owner, (n.name,), prompt, trace, search.changed(config.depth, config.max_results), path=n.path)


def _by_field(model: type[BaseModel], base: str, search: Search) -> list[Step]:
    configs = {n: field_config(f.json_schema_extra) for n, f in model.model_fields.items()}
    order = execution_order({n: dependencies(n, c) for n, c in configs.items()})
    lists = searched_lists(model)
    nested = [n for n in configured_fields(model) if "." in n.path and n.path.split(".")[0] not in lists]
    out = []
    for name in order:
        before = tuple(_inner("nested", n, ABOUT_FIELD.format(path=n.path), search, n.path) for n in nested if n.path.startswith(f"{name}."))
        # the item's words are filled in when the item is known
        after = tuple(_inner("item", n, ABOUT_ITEM, search, n.path) for n in lists.get(name, ()))
        out.append(_own(model, name, base, search, nested=before, items=after))
    return out


def _grouped(model: type[BaseModel], base: str, search: Search) -> list[Step]:
    if has_field_config(model, ("condition",)):
        raise ValueError("conditions do not work with search_groups")
    out, grouped = [], {f for g in search.groups.values() for f in g.fields}
    for name, g in search.groups.items():
        if g.prompt:
            prompt = g.prompt.replace("{query}", "{texto}")
            prompt = prompt if "{texto}" in g.prompt else prompt + GROUP_TEXT
        else:
            prompt = base + ONLY_FIELDS.format(names=", ".join(g.fields))
        out.append(Step("group", model, g.fields, prompt, name, search.changed(g.search_depth, g.max_results)))
    return out + [_own(model, f, base, search) for f in model.model_fields if f not in grouped]
