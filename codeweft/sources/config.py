"""Workspace configuration: load, validate, save, detect projects, contain paths."""

from __future__ import annotations

import json
import logging
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

CONFIG_NAME = "codeweft.json"

# Languages, directories that hold no sources of one's own, directories that detection doesn't enter.
LANGUAGES = ("go", "typescript", "javascript", "python", "csharp", "rust", "zig", "vue", "auto")
DEFAULT_EXCLUDES = (
    "node_modules/", "vendor/", "dist/", "build/", ".git/", "__pycache__/", ".venv/", "venv/", "target/", "obj/", "bin/", ".next/", "out/", "coverage/",
)
NOT_ENTERED = ("node_modules", "vendor", "dist", "build", "bin", "obj", "__pycache__", ".venv", "venv")


class ConfigError(ValueError):
    pass


@dataclass
class Project:
    name: str
    path: str
    language: str = "auto"
    exclude: list[str] = field(default_factory=list)
    services: list[Project] = field(default_factory=list)


@dataclass
class Workspace:
    name: str
    projects: list[Project] = field(default_factory=list)


def find(start: str) -> str | None:
    """The nearest configuration file at ``start`` or above."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(path := os.path.join(at, CONFIG_NAME)):
            return path
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def _project(raw: dict) -> Project:
    if not isinstance(raw, dict):
        raise ConfigError("a project must be an object")
    services = [_project(s) for s in raw.get("services") or []]
    return Project(raw.get("name") or "", raw.get("path") or "", raw.get("language") or "", list(raw.get("exclude") or []), services)


def load(start: str) -> tuple[Workspace, str]:
    """The validated workspace and its folder; projects whose path is missing are dropped with a warning."""
    path = find(start)
    if path is None:
        raise ConfigError(f"no {CONFIG_NAME} at {start} or above")
    with open(path, encoding="utf-8") as f:
        try:
            raw = json.load(f)
        except json.JSONDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError(f"{path}: not an object")
    root = os.path.dirname(path)
    return validate(Workspace(raw.get("name") or "", [_project(p) for p in raw.get("projects") or []]), root), root


def _sound(p: Project, root: str) -> bool:
    """Whether the project's path exists; an empty one is the root. Raises for an empty name or an unknown language."""
    if not p.name:
        raise ConfigError("a project's or service's name is empty")
    if p.language not in LANGUAGES:
        raise ConfigError(f"project {p.name!r}: unknown language {p.language!r}")
    return os.path.exists(os.path.join(root, p.path))


def validate(ws: Workspace, root: str = ".") -> Workspace:
    """The workspace without the projects whose path is missing, which are warned about.

    Services are checked like projects where their project's path exists, and are one
    level deep; a service whose path is missing is warned about and stays.
    """
    if not ws.name:
        raise ConfigError("workspace name is empty")
    kept = []
    for p in ws.projects:
        if not _sound(p, root):
            logging.warning("project %s: no such path: %s", p.name, p.path)
            continue
        for s in p.services:
            if not _sound(s, root):
                logging.warning("service %s of %s: no such path: %s", s.name, p.name, s.path)
            elif s.services:
                raise ConfigError(f"project {s.name!r}: services can't have services")
        kept.append(p)
    return Workspace(ws.name, kept)


def save(ws: Workspace, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, CONFIG_NAME)

    def plain(p: Project) -> dict:
        return {k: v for k, v in asdict(p).items() if v or k in ("name", "path", "language")}

    with open(path, "w", encoding="utf-8") as f:
        json.dump({"name": ws.name, "projects": [plain(p) for p in ws.projects]}, f, indent=2)
    os.chmod(path, 0o644)
    return path


def go_module_name(text: str) -> str:
    """The last part of the first ``module`` line."""
    m = re.search(r"^\s*module\s+(\S+)", text, re.M)
    return m[1].strip('"').rstrip("/").split("/")[-1] if m else ""


#: What tells a project's folder. Fixed values.
MANIFESTS = ("go.mod", "package.json", "tsconfig.json", "pyproject.toml", "setup.py", "*.csproj", "Cargo.toml", "build.zig")


def folders(root: str) -> Iterator[tuple[str, list[str]]]:
    """Relative folders and their files; hidden and dependency directories aren't entered."""
    for at, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in NOT_ENTERED]
        yield os.path.relpath(at, root).replace(os.sep, "/"), files


def detect(root: str, found: Iterable[tuple[str, list[str]]] | None = None) -> list[Project]:
    """Projects by their manifests, in walk order; ``found`` gives folders and files if they are listed already."""
    root, out = os.path.abspath(root), []
    by_name = lambda f: [] if f[0] == "." else f[0].split("/")
    for rel, files in sorted(folders(root) if found is None else found, key=by_name):
        at = os.path.normpath(os.path.join(root, rel))
        here = os.path.basename(at)
        for f in sorted(files):
            name, language = here, None
            if f == "go.mod":
                with open(os.path.join(at, f), encoding="utf-8", errors="replace") as h:
                    name, language = go_module_name(h.read()) or here, "go"
            elif f == "package.json":
                language = "typescript" if "tsconfig.json" in files else "javascript"
            elif f in ("pyproject.toml", "setup.py"):
                language = "python"
            elif f.endswith(".csproj"):
                name, language = f.removesuffix(".csproj"), "csharp"
            elif f == "Cargo.toml":
                language = "rust"
            elif f == "build.zig":
                language = "zig"
            if language:
                out.append(Project(name, rel, language, list(DEFAULT_EXCLUDES)))
    return out


def flatten(projects: list[Project]) -> list[Project]:
    """Services stand for the project that has them."""
    return [q for p in projects for q in (p.services or [p])]


def merge_excludes(own: list[str], default: tuple[str, ...] = DEFAULT_EXCLUDES) -> list[str]:
    return list(dict.fromkeys([*own, *default]))


def contained(root: str, path: str) -> bool:
    """Whether the path, links resolved, is the root or below it."""
    base, at = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return at == base or at.startswith(base.rstrip(os.sep) + os.sep)
