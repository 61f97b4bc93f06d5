"""Configuration: arguments, then CODESTRATA_* environment variables, then a properties file, then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

IGNORED = ("target", "build", "node_modules", ".git", ".idea", ".gradle", "out", "dist")
TEXT = ("java", "kt", "xml", "yml", "yaml", "properties", "md", "txt", "json", "sql", "gradle", "html", "js", "ts", "py")


@dataclass(frozen=True)
class Config:
    workspace: str = "."
    index_dir: str = ""
    ignored_dirs: tuple[str, ...] = IGNORED
    text_extensions: tuple[str, ...] = TEXT
    max_file_bytes: int = 5 << 20
    max_results: int = 500
    source_roots: tuple[str, ...] = field(default=("src/main/java", "src/test/java"))

    @classmethod
    def load(cls, **given) -> Config:
        """A value given wins; lists are comma-separated in the environment and the file; a broken file counts as absent."""
        workspace = given.get("workspace") or os.environ.get("CODESTRATA_WORKSPACE") or os.getcwd()
        file = {}
        try:
            for line in (Path(workspace) / ".codestrata" / "server.properties").read_text(encoding="utf-8").splitlines():
                if "=" in line and not line.lstrip().startswith("#"):
                    key, _, value = line.partition("=")
                    file[key.strip()] = value.strip()
        except (OSError, UnicodeDecodeError):
            pass
        values = {"workspace": os.path.abspath(workspace)}
        for f in fields(cls):
            raw = given.get(f.name, os.environ.get(f"CODESTRATA_{f.name.upper()}", file.get(f.name)))
            if raw is None or f.name == "workspace":
                continue
            default = getattr(cls(), f.name)
            if isinstance(default, tuple) and isinstance(raw, str):
                raw = tuple(x.strip() for x in raw.split(",") if x.strip())
            values[f.name] = int(raw) if isinstance(default, int) else raw
        out = cls(**values)
        return out if out.index_dir else cls(**values | {"index_dir": os.path.join(out.workspace, ".codestrata", "index")})
