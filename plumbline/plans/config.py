"""Configuration: discovery, loading, validation and the precedence of flags."""

from __future__ import annotations

import json
import runpy
import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from plumbline.model import SEVERITIES

# File names in the order in which a folder is searched, and the known keys.
FILE_NAMES = ("plumbline.config.py", "plumbline.config.toml", "plumbline.config.json", ".plumbline.json")
KEYS = ("plugins", "rules", "reporter", "overrides", "options")
NUMBERS = ("timeout", "maxDetails", "maxDiagnostics")


@dataclass(frozen=True)
class Issue:
    path: str
    message: str
    received: Any = None
    severity: str = "error"


class ConfigError(ValueError):
    """All issues of a configuration at once."""

    def __init__(self, issues: list[Issue]) -> None:
        self.issues = issues
        super().__init__("\n".join(f"{i.path}: {i.message}" for i in issues))


class ConfigLoadError(ValueError):
    """A configuration file that is missing or cannot be read."""


def find_config(start: str | Path) -> Path | None:
    """The first known file name in a folder or the nearest parent that has one."""
    folder = Path(start).resolve()
    for place in (folder, *folder.parents):
        for name in FILE_NAMES:
            if (place / name).is_file():
                return place / name
    return None


def load_file(path: str | Path) -> dict:
    """The mapping that a .json or .toml file holds or a .py file assigns to ``config``."""
    path = Path(path)
    try:
        if path.suffix == ".json":
            value = json.loads(path.read_text("utf-8"))
        elif path.suffix == ".toml":
            value = tomllib.loads(path.read_text("utf-8"))
        elif path.suffix == ".py":
            names = runpy.run_path(str(path))
            if "config" not in names:
                raise ConfigLoadError(f"{path}: no variable named config")
            value = names["config"]
        else:
            raise ConfigLoadError(f"{path}: unknown kind of configuration file")
    except ConfigLoadError:
        raise
    except Exception as error:
        raise ConfigLoadError(f"{path}: {error}") from error
    if not isinstance(value, dict):
        raise ConfigLoadError(f"{path}: the configuration must be a mapping")
    return value


def valid_rule_entry(value: Any) -> bool:
    """``off``, a severity, or a pair of severity and options."""
    if isinstance(value, str):
        return value == "off" or value in SEVERITIES
    return isinstance(value, (list, tuple)) and len(value) == 2 and isinstance(value[0], str) and value[0] in SEVERITIES


def _rule_issues(value: Any, path: str) -> list[Issue]:
    if not isinstance(value, dict):
        return [Issue(path, "must map rule ids to settings", value)]
    return [Issue(f"{path}[{k!r}]", "must be a severity, off, or [severity, options]", v) for k, v in value.items() if not valid_rule_entry(v)]


def _plugin_issues(value: Any, data_only: bool) -> list[Issue]:
    if data_only:
        return [Issue("plugins", "plugins need a Python configuration", value)]
    if not isinstance(value, (list, tuple)):
        return [Issue("plugins", "must be a list of plugins", value)]
    return [Issue(f"plugins[{i}]", "must be a plugin with a string id", p) for i, p in enumerate(value) if not isinstance(getattr(p, "id", None), str)]


def _override_issues(value: Any) -> list[Issue]:
    if not isinstance(value, (list, tuple)):
        return [Issue("overrides", "must be a list of overrides", value)]
    out = []
    for i, entry in enumerate(value):
        if not isinstance(entry, dict):
            out.append(Issue(f"overrides[{i}]", "must be a mapping with a list of files", entry))
            continue
        files = entry.get("files")
        if not isinstance(files, (list, tuple)) or not all(isinstance(f, str) for f in files):
            out.append(Issue(f"overrides[{i}].files", "must be a list of globs", files))
        if entry.get("rules") is not None:
            out += _rule_issues(entry["rules"], f"overrides[{i}].rules")
    return out


def _reporter_issues(value: Any) -> list[Issue]:
    pair = isinstance(value, (list, tuple)) and len(value) == 2 and isinstance(value[0], str) and isinstance(value[1], dict)
    return [] if isinstance(value, str) or pair else [Issue("reporter", "must be a name or a pair of name and options", value)]


def _option_issues(value: Any) -> list[Issue]:
    if not isinstance(value, dict):
        return [Issue("options", "must be a mapping", value)]
    bad = lambda v: isinstance(v, bool) or not isinstance(v, (int, float)) or v != v
    return [Issue(f"options.{k}", "must be a number", value[k]) for k in NUMBERS if value.get(k) is not None and bad(value[k])]


def validate(value: Any, data_only: bool = False) -> list[Issue]:
    """Warnings of a configuration; raises :class:`ConfigError` with all issues if any is an error."""
    if not isinstance(value, dict):
        raise ConfigError([Issue("(root)", "must be a mapping", value)])
    checks = {"plugins": lambda v: _plugin_issues(v, data_only), "rules": lambda v: _rule_issues(v, "rules"), "reporter": _reporter_issues, "overrides": _override_issues, "options": _option_issues}
    issues = [i for k, check in checks.items() if value.get(k) is not None for i in check(value[k])]
    issues += [Issue(k, f"unknown key {k!r}", v, "warning") for k, v in value.items() if k not in KEYS]
    if any(i.severity == "error" for i in issues):
        raise ConfigError(issues)
    return issues


def load_config(start: str | Path = ".", explicit: str | Path | None = None) -> tuple[dict, list[Issue]]:
    """Configuration and warnings; an explicit file must exist, no file at all means an empty one."""
    if explicit is not None and not Path(explicit).is_file():
        raise ConfigLoadError(f"{explicit}: no such file")
    path = Path(explicit) if explicit is not None else find_config(start)
    if path is None:
        return {}, []
    value = load_file(path)
    return value, validate(value, data_only=path.suffix != ".py")


def merge_flags(config: dict, reporter: str | None = None, max_diagnostics: int | None = None) -> dict:
    """Configuration with the flags of a command line on top."""
    merged = dict(config)
    if reporter is not None:
        merged["reporter"] = reporter
    if max_diagnostics is not None:
        merged["options"] = {**(config.get("options") or {}), "maxDiagnostics": max_diagnostics}
    return merged
