"""Answer JSON-RPC requests on standard input: python -m codestrata --workspace PATH."""

from __future__ import annotations

import argparse

from .config import Config
from .engine import Engine
from .server import serve
from .session import build_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codestrata", description=__doc__)
    parser.add_argument("--workspace", "-w", help="the repository to analyse; else CODESTRATA_WORKSPACE, else the current directory")
    given, _ = parser.parse_known_args(arguments)
    serve(Engine(build_session("codestrata"), Config.load(workspace=given.workspace)))


if __name__ == "__main__":
    main()
