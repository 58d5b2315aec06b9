"""JSON inside strings: comments, tolerant parsing, payload rewriting, hook trees.

What is rewritten keeps all its other fields: open shapes go through a JSON tree in an Arrow-batched function, closed ones
(predicates and counts) through declared schemas.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexical
from .spaces import blank

# The lists of a response whose items have descriptions.
LISTS = ("tools", "prompts", "resources", "resourceTemplates")
#: A string as group 1, or a comment. A long string is one step of the expression, not one for each character.
COMMENT = "(\"[^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+\")|//[^\\n]*|/\\*[\\s\\S]*?\\*/"
HOOKS = "map<string,array<struct<matcher:string,hooks:array<struct<type:string,command:string,prompt:string,timeout:int>>>>>"


def without_comments(text: Column) -> Column:
    """Comments outside strings go, then commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(text, COMMENT, "$1"), ",(\\s*+[}\\]])", "$1")


def valid(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else (the parser alone ignores what follows a value)."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.lit(False))


def parsed(text: Column) -> Column:
    """As VARIANT: blank is {}, strict JSON first, then without comments, else null."""
    nothing = blank(F.coalesce(text, F.lit("")))
    return F.when(nothing, F.parse_json(F.lit("{}"))).otherwise(F.when(valid(text), F.try_parse_json(text)).otherwise(F.when(valid(without_comments(text)), F.try_parse_json(without_comments(text)))))


def load(text: str):
    """A JSON value; numbers that are not JSON are errors."""

    def refuse(name):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def dump(value) -> str:
    """Compact JSON with keys in their order; a whole number has no fraction."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))


def _shrinker() -> Callable[[str], str]:
    pattern = re.compile(lexical.pattern(True), re.ASCII)
    return lambda text: pattern.sub(lambda m: m[1] or "", text)


def shrink_tree(value, fields: frozenset[str], shrink: Callable[[str], str]):
    """Named string fields compressed at any depth; other values stay."""
    if isinstance(value, dict):
        return {k: shrink(v) if k in fields and isinstance(v, str) else shrink_tree(v, fields, shrink) for k, v in value.items()}
    return [shrink_tree(x, fields, shrink) for x in value] if isinstance(value, list) else value


def shrink_response(message, fields: frozenset[str], shrink: Callable[[str], str]):
    """The named fields of the items of a response's lists compressed; only if that changes none, those at any depth of
    the result. All else stays."""
    result = message.get("result") if isinstance(message, dict) else None
    if not isinstance(result, (dict, list)):
        return message
    changed = False
    for name in LISTS if isinstance(result, dict) else ():
        for item in result[name] if isinstance(result.get(name), list) else ():
            for field in fields if isinstance(item, dict) else ():
                if isinstance(item.get(field), str) and (short := shrink(item[field])) != item[field]:
                    item[field], changed = short, True
    return message if changed else {**message, "result": shrink_tree(result, fields, shrink)}


def _line_function(rewrite):
    """A Column function of JSON lines; what cannot be parsed passes as it is."""

    @F.pandas_udf("string")
    def over(lines: pd.Series) -> pd.Series:
        shrink = _shrinker()

        def one(line):
            try:
                return dump(rewrite(load(line), shrink))
            except (TypeError, ValueError, RecursionError):
                return line

        return lines.map(one)

    return over


def rewriter(fields: tuple[str, ...] = ("description",)):
    """A function for lines of list responses."""
    names = frozenset(fields)
    return _line_function(lambda value, shrink: shrink_response(value, names, shrink))


def deep_rewriter(fields: tuple[str, ...] = ("description",)):
    """A function for JSON of any depth and shape."""
    names = frozenset(fields)
    return _line_function(lambda value, shrink: shrink_tree(value, names, shrink))


def field_list(spec: str | None, default: tuple[str, ...] = ("description",)) -> tuple[str, ...]:
    """Names from a comma list, trimmed, blanks dropped; the default where there is no list."""
    return default if spec is None else tuple(x.strip() for x in spec.split(",") if x.strip())


def rewritten(line: Column) -> Column:
    """The descriptions of a list response compressed, every other field kept; what is no JSON passes as it is."""
    return rewriter()(line)


def _sound(hook: Column) -> Column:
    command = (hook["type"] == "command") & (F.coalesce(hook["command"], F.lit("")) != "")
    return F.coalesce(command | ((hook["type"] == "agent") & (F.coalesce(hook["prompt"], F.lit("")) != "")), F.lit(False))


def _pruned(hooks: Column, keep) -> Column:
    """Hooks that do not pass go, then entries without hooks, then events without entries."""
    entries = F.transform_values(hooks, lambda _, v: F.filter(F.transform(F.filter(v, lambda e: e["hooks"].isNotNull()), lambda e: e.withField("hooks", F.filter(e["hooks"], keep))), lambda e: F.size(e["hooks"]) > 0))
    return F.map_filter(entries, lambda _, v: F.size(v) > 0)


def sound_hooks(hooks: Column) -> Column:
    return _pruned(hooks, _sound)


def has_hook(hooks: Column, marker: str) -> Column:
    return F.exists(F.flatten(F.map_values(hooks)), lambda e: F.exists(e["hooks"], lambda h: F.coalesce(h["command"].contains(marker), F.lit(False))))


def without_hooks(hooks: Column, marker: str) -> Column:
    return _pruned(hooks, lambda h: ~F.coalesce(h["command"].contains(marker), F.lit(False)))


def hook_count(hooks: Column) -> Column:
    return F.aggregate(F.flatten(F.map_values(hooks)), F.lit(0), lambda n, e: n + F.size(e["hooks"]))


def _kept(tree: dict, keep: Callable[[dict], bool]) -> tuple[dict, int]:
    """A settings tree without the hooks that fail, the entries and events that this leaves empty, and how many went."""
    events, gone = tree.get("hooks"), 0
    if not isinstance(events, dict):
        return tree, 0
    left = {}
    for event, entries in events.items():
        some = []
        for entry in entries if isinstance(entries, list) else ():
            if not isinstance(entry, dict) or not isinstance(entry.get("hooks"), list):
                continue
            hooks = [h for h in entry["hooks"] if isinstance(h, dict) and keep(h)]
            gone += len(entry["hooks"]) - len(hooks)
            if hooks:
                some.append({**entry, "hooks": hooks})
        if some:
            left[event] = some
    out = {k: v for k, v in tree.items() if k != "hooks"} if not left else {**tree, "hooks": left}
    return out, gone


def _named(hook: dict, marker: str) -> bool:
    return isinstance(hook.get("command"), str) and marker in hook["command"]


def _is_sound(hook: dict) -> bool:
    text = hook.get({"command": "command", "agent": "prompt"}.get(hook.get("type"), ""))
    return isinstance(text, str) and text != ""


def _settings_function(change: Callable[[dict], tuple[dict, int]]):
    """A Column function of settings texts: struct(settings, changed). Comments are read past, all other fields are kept;
    what is no JSON object passes as it is."""
    comment, comma = re.compile(COMMENT), re.compile(r",(\s*[}\]])")

    @F.pandas_udf("settings string, changed long")
    def over(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            if text is None:
                return None, 0
            for attempt in (lambda: load(text if text.strip() else "{}"), lambda: load(comma.sub(r"\1", comment.sub(lambda m: m[1] or "", text)))):
                try:
                    tree = attempt()
                except (ValueError, RecursionError):
                    continue
                if isinstance(tree, dict):
                    out, changed = change(tree)
                    return dump(out), changed
                break
            return text, 0

        return pd.DataFrame([one(t) for t in texts], columns=["settings", "changed"])

    return over


def settings_sound():
    """Settings without hooks that lack a command (or an agent's prompt); changed counts them."""
    return _settings_function(lambda tree: _kept(tree, _is_sound))


def settings_without(marker: str):
    """Settings without the hooks whose command holds the marker; changed counts them."""
    return _settings_function(lambda tree: _kept(tree, lambda h: not _named(h, marker)))


def settings_with(event: str, command: str, marker: str):
    """Settings with a command hook added to an event, unless a hook with the marker is there; changed is 1 if added."""

    def change(tree: dict) -> tuple[dict, int]:
        hooks = tree.get("hooks") if isinstance(tree.get("hooks"), dict) else {}
        entries = [e for v in hooks.values() if isinstance(v, list) for e in v if isinstance(e, dict) and isinstance(e.get("hooks"), list)]
        if any(isinstance(h, dict) and _named(h, marker) for e in entries for h in e["hooks"]):
            return tree, 0
        own = hooks.get(event) if isinstance(hooks.get(event), list) else []
        return {**tree, "hooks": {**hooks, event: [*own, {"hooks": [{"type": "command", "command": command}]}]}}, 1

    return _settings_function(change)
