"""Command line: index, search, status, delete, health, vacuum, cleanup, config, with short names for the common ones."""

from __future__ import annotations

import argparse
import json
import sys

from gneiss import config

#: Short names of commands.
ALIASES = {"idx": "index", "find": "search", "stats": "status", "remove": "delete", "ping": "health", "setup": "init"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("gneiss")
    out.add_argument("--folder", dest="index_path", help="where the index lies")
    out.add_argument("--settings", help="a JSON file of settings")
    out.add_argument("--json", action="store_true", help="print JSON")
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name, aliases=[a for a, n in ALIASES.items() if n == name])
    x = add("index")
    x.add_argument("path")
    x.add_argument("--name")
    x = add("search")
    x.add_argument("query")
    x.add_argument("--language")
    x.add_argument("--limit", type=int)
    add("status")
    x = add("delete")
    x.add_argument("repo_id", type=int)
    for name in ("health", "vacuum", "cleanup"):
        add(name)
    x = add("init")
    x.add_argument("path", nargs="?", default="gneiss.json")
    add("config")
    return out


def run(arguments: list[str], engine=None) -> tuple[int, object]:
    """The exit code and what is to be printed; engine: instead of one over a new session."""
    args = parser().parse_args(arguments)
    args.command = ALIASES.get(args.command, args.command)
    settings = config.load(args.settings, index_path=args.index_path)
    if args.command == "init":
        with open(args.path, "w") as f:
            json.dump({k: v for k, v in vars(settings).items() if k != "sources"}, f, indent=2)
        return 0, args.path
    if args.command == "config":
        return 0, {k: {"value": v, "from": settings.sources[k]} for k, v in vars(settings).items() if k != "sources"}
    if engine is None:
        from gneiss.engine import Engine
        from gneiss.session import session

        engine = Engine(session(), settings.index_path, settings)
    try:
        if args.command == "index":
            return 0, engine.jobs.run("index", lambda: engine.index(args.path, args.name)).result or {"error": engine.jobs.all()[-1]["error"]}
        if args.command == "search":
            found = engine.rows(engine.search(args.query, args.language, args.limit), 100)
            return 0, [r.asDict() for r in found.collect()]  # limit rows
        if args.command == "delete":
            return 0, {"deleted": engine.delete(args.repo_id)}
        if args.command == "vacuum":
            engine.vacuum()
            return 0, {"done": True}
        if args.command == "cleanup":
            return 0, {"deleted": engine.cleanup()}
        if args.command == "health":
            return 0, {"status": "ok", "chunks": engine.chunks().count()}
        return 0, engine.stats()
    except (ValueError, FileNotFoundError) as e:
        return 1, {"error": str(e)}


def main() -> int:
    code, out = run(sys.argv[1:])
    print(out if isinstance(out, str) else json.dumps(out, default=str, indent=2))
    return code


if __name__ == "__main__":
    sys.exit(main())
