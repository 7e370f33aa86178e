"""python -m revloom COMMAND: the stages and queries from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from revloom.api import Engine
from revloom.errors import RevloomError
from revloom.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="revloom")
    p.add_argument("--data", default=".revloom", help="the data folder")
    p.add_argument("--allow", default=None, help="comma-separated slugs that may be used")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "link", "compile", "recipes", "explain", "suppress", "unsuppress", "suggest", "preview", "freshness", "purge"):
        c = sub.add_parser(name)
        c.add_argument("repo")
        if name in ("explain", "suppress", "unsuppress", "preview"):
            c.add_argument("recipe")
        if name == "ingest":
            c.add_argument("--max-prs", type=int, default=200)
            c.add_argument("--path", help="recorded pages")
            c.add_argument("--url")
            c.add_argument("--token")
        if name == "compile":
            c.add_argument("--min-support", type=int)
        if name == "recipes":
            c.add_argument("--path")
            c.add_argument("--language")
            c.add_argument("--words")
            c.add_argument("--limit", type=int)
        if name == "suggest":
            c.add_argument("--diff", default="-", help="a file, or - for standard input")
            c.add_argument("--limit", type=int)
        if name == "preview":
            c.add_argument("file")
            c.add_argument("--line", type=int)
    sub.add_parser("list")
    return p


def run(args: argparse.Namespace, engine: Engine):
    """What a command answers: a DataFrame, or something JSON can hold."""
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("command", "data", "allow", "repo", "recipe", "file", "line", "diff")}
    match args.command:
        case "list":
            return engine.repos()
        case "recipes":
            return engine.list_recipes(args.repo, **given)
        case "suggest":
            if args.diff == "-":
                diff = sys.stdin.read()
            else:
                with open(args.diff, encoding="utf-8") as f:
                    diff = f.read()
            return engine.suggest(args.repo, diff=diff, **given)
        case "explain":
            return engine.explain(args.repo, args.recipe)
        case "suppress" | "unsuppress":
            return engine.suppress(args.repo, args.recipe, args.command == "suppress")
        case "preview":
            return engine.apply_preview(args.repo, args.recipe, args.file, args.line)
        case other:
            return getattr(engine, other)(args.repo, **given)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        answer = run(args, Engine(build_session(), args.data, args.allow))
    except RevloomError as e:
        print(json.dumps({"error": e.code, "message": str(e)}), file=sys.stderr)
        return e.exit_code
    if hasattr(answer, "toJSON"):
        for row in answer.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str))
    else:
        print(json.dumps(answer, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
