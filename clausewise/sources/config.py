"""Project configuration from YAML, checked by exact types."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from clausewise.operators.grammar_rules import GRAMMAR_RULES
from clausewise.operators.rules import RULES
from clausewise.options import MODES, PRESETS, SEVERITIES, Options

RULE_IDS = frozenset(i for _, r in RULES for i in r.ids) | frozenset(i for _, _, ids, _ in GRAMMAR_RULES for i in ids) | {"STE-5.3"}
KEYS = frozenset("allow analyzer baseline dictionary disable_rules exclude fail_over max_noun_words max_words min_confidence mode prefer presets rules warnings_as_errors".split())
NAMES = (".ste.yml", ".ste.yaml", "glossary.yml", "docs/glossary.yml")


class _Loader(yaml.SafeLoader):
    """Booleans are only true and false; a repeated key is an error."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", __import__("re").compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    out = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise yaml.constructor.ConstructorError(None, None, f"duplicate key: {key}", k.start_mark)
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


@dataclass
class Config:
    options: Options = field(default_factory=Options)
    exclude: tuple[str, ...] = ()
    fail_over: float = -1.0
    dictionary: bool = False
    analyzer: bool = False
    baseline: str = ""


def parse(text: str) -> Config:
    def check(ok: bool, message: str) -> None:
        if not ok:
            raise ValueError(message)

    def strings(value: object, name: str) -> tuple[str, ...]:
        check(value is None or (isinstance(value, list) and all(isinstance(x, str) for x in value)), f"{name} must be a list of strings")
        return tuple(value or ())

    try:
        raw = yaml.load(text, Loader=_Loader)  # noqa: S506
    except yaml.YAMLError as err:
        raise ValueError(str(err).splitlines()[0]) from err
    raw = {} if raw is None else raw
    check(isinstance(raw, dict), "the config must be a mapping")
    check(all(isinstance(k, str) for k in raw), "a config key must be a string")
    check(not raw.keys() - KEYS, f"unknown config key: {min(raw.keys() - KEYS, default='')}")
    for k in ("mode", "max_words", "max_noun_words"):
        check(k not in raw or raw[k] is not None, f'the key "{k}" has no value')
    check(raw.get("mode", "flavored") in MODES, "unknown mode")
    for k in ("max_words", "max_noun_words"):
        check(k not in raw or (type(raw[k]) is int and raw[k] > 0), f"{k} must be a positive number")
    for k in ("warnings_as_errors", "dictionary", "analyzer"):
        check(raw.get(k) is None or type(raw[k]) is bool, f"{k} must be a boolean")
    for k in ("min_confidence", "fail_over"):
        check(raw.get(k) is None or type(raw[k]) in (int, float), f"{k} must be a number")
    check(0 <= (raw.get("min_confidence") or 0) <= 1, "min_confidence must be between 0 and 1")
    check(raw.get("baseline") is None or isinstance(raw["baseline"], str), "baseline must be a path")
    allow = raw.get("allow") or {}
    check(isinstance(allow, dict) and not allow.keys() - {"nouns", "verbs"}, "allow accepts only nouns and verbs")
    rules, prefer = raw.get("rules") or {}, raw.get("prefer") or {}
    check(isinstance(rules, dict), "rules must be a mapping")
    check(isinstance(prefer, dict) and all(isinstance(k, str) for k in prefer), "prefer must be a mapping of names to lists")
    disable = strings(raw.get("disable_rules"), "disable_rules")
    for r in (*disable, *rules):
        check(isinstance(r, str), "a rule identifier must be a string")
        check(r in RULE_IDS, f"unknown rule: {r}")
    for r, v in rules.items():
        check(v in SEVERITIES, f"unknown severity of {r}")
    presets = strings(raw.get("presets"), "presets")
    check(all(p in PRESETS for p in presets), "unknown preset")
    options = Options(
        mode=raw.get("mode", "flavored"),
        min_confidence=float(raw.get("min_confidence") or 0),
        max_words=raw.get("max_words", 0),
        max_noun_words=raw.get("max_noun_words", 0),
        warnings_as_errors=bool(raw.get("warnings_as_errors")),
        allow_nouns=strings(allow.get("nouns"), "allow.nouns"),
        allow_verbs=strings(allow.get("verbs"), "allow.verbs"),
        presets=presets,
        prefer=tuple((k, strings(prefer[k], f"prefer.{k}")) for k in sorted(prefer)),
        disable=disable,
        severities=dict(rules),
    )
    fail_over = raw.get("fail_over")
    return Config(options, strings(raw.get("exclude"), "exclude"), -1.0 if fail_over is None else float(fail_over), bool(raw.get("dictionary")), bool(raw.get("analyzer")), raw.get("baseline") or "")


def find(start: str | Path) -> Path | None:
    """The nearest config file, from ``start`` up to the directory that holds a repository."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in NAMES:
            if (folder / name).is_file():
                return folder / name
        if (folder / ".git").exists():
            return None
    return None


def load(path: str | Path | None) -> Config:
    if path is None:
        return Config()
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except ValueError as err:
        raise ValueError(f"{path}: {err}") from err
