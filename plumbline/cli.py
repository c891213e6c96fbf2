"""Command line: ``python -m plumbline check|init|rules``. Exit codes: 0 pass, 1 fail, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.plans.config import ConfigError, ConfigLoadError, load_config, merge_flags
from plumbline.plans.engine import Engine
from plumbline.plans.report import find_reporter
from plumbline.plans.rules import Plugin
from plumbline.sources.scan import DEFAULT_PLUGINS, expand_sources, load_sources

SCAFFOLD = {"rules": {"tile/coordinate-range": ["error", {"buffer": 80}]}, "options": {"maxDiagnostics": 1000}}


def session() -> SparkSession:
    return SparkSession.builder.appName("plumbline").getOrCreate()


def whole(text: str) -> int:
    """A whole number that is not negative."""
    value = int(text)
    if value < 0:
        raise ValueError(text)
    return value


def plugins_of(config: dict) -> list[Plugin]:
    """The built-in plugins, then those of the configuration."""
    return [*DEFAULT_PLUGINS, *(config.get("plugins") or ())]


def check(args: argparse.Namespace) -> int:
    config, warnings = load_config(".", args.config)
    for w in warnings:
        print(f"warning: {w.path}: {w.message}", file=sys.stderr)
    config = merge_flags(config, args.reporter, args.max_diagnostics)
    report = find_reporter(config.get("reporter"))
    sources = expand_sources(args.sources)
    if not sources:
        print(f"no files match {' '.join(args.sources)}", file=sys.stderr)
        return 2
    engine = Engine(plugins_of(config), config)
    began = time.monotonic()
    result = engine.run(load_sources(session(), sources, engine.resolved.options["timeout"], plugins=engine.plugins))
    try:
        print(report(result, time.monotonic() - began))
    except Exception as error:  # noqa: BLE001 - a reporter that fails does not decide the run
        print(f"the reporter failed: {type(error).__name__}: {error}", file=sys.stderr)
    return 0 if result.summary.first()["pass"] else 1


def init(args: argparse.Namespace) -> int:
    path = Path(args.path)
    if path.exists() and not args.force:
        print(f"{path} exists; --force overwrites it", file=sys.stderr)
        return 2
    path.write_text(json.dumps(SCAFFOLD, indent=2) + "\n", "utf-8")
    return 0


def rules(args: argparse.Namespace) -> int:
    config, _ = load_config(".", args.config)
    found = [r for p in plugins_of(config) for r in p.rules]
    if args.format == "json":
        print(json.dumps([{"id": r.id, "description": r.description, "severity": r.severity, "recommended": r.recommended, "docsUrl": r.docs_url} for r in found], indent=2))
    else:
        print("\n".join(f"{r.id:28} {r.severity:8} {r.description}" for r in found))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("plumbline", description="Checks vector tiles and map styles.")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("check", help="check sources")
    one.add_argument("sources", nargs="+")
    one.add_argument("--config")
    one.add_argument("--reporter")
    one.add_argument("--max-diagnostics", type=whole)
    one.set_defaults(run=check)
    two = commands.add_parser("init", help="write a configuration")
    two.add_argument("--path", default="plumbline.config.json")
    two.add_argument("--force", action="store_true")
    two.set_defaults(run=init)
    three = commands.add_parser("rules", help="list the rules")
    three.add_argument("--format", choices=["text", "json"], default="text")
    three.add_argument("--config")
    three.set_defaults(run=rules)
    try:
        args = parser.parse_args(argv)
        return args.run(args)
    except (ConfigError, ConfigLoadError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    except SystemExit as stop:
        return int(stop.code or 0)
