"""Libraries, volumes and sources: directories marked by a version file, described in YAML."""

from __future__ import annotations

import fnmatch
import os
import shutil
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from lectern.sources.blocks import documents, to_yaml

LIBRARY, VOLUME = ".lectern-library", ".lectern-volume"
DEFINITIONS = {LIBRARY: "library.yaml", VOLUME: "volume.yaml"}
SETTABLE = ("title", "workflow")
SCHEMA = "path string, moniker string, title string, language string, tags array<string>, linkedVolumes array<string>, workflow string, definitionVersion string"


class CatalogError(ValueError):
    pass


def _clean(name: str) -> str:
    return "".join("_" if c in '<>:"/\\|?*' or ord(c) < 32 else c for c in name).strip()


class Catalog:
    """Driver-side: it handles as many small files as there are volumes."""

    def __init__(self, spark: SparkSession | None = None, version: str = "1"):
        self.spark, self.version = spark, version

    def _init(self, path: str, mark: str, definition: dict[str, Any], force: bool) -> str:
        base = Path(path)
        if base.is_dir() and any(base.iterdir()) and not force:
            raise CatalogError(f"{path} is not empty")
        (base / mark).mkdir(parents=True, exist_ok=True)
        (base / mark / "version").write_text(self.version)
        if not (base / DEFINITIONS[mark]).exists():
            (base / DEFINITIONS[mark]).write_text(to_yaml([definition]) if definition else "{}\n")
        return str(base)

    def init_library(self, path: str, force: bool = False) -> str:
        return self._init(path, LIBRARY, {}, force)

    def init_volume(self, path: str, title: str | None = None, moniker: str | None = None, tags: list[str] = (), force: bool = False) -> str:
        return self._init(path, VOLUME, self._definition(title, moniker, tags), force)

    def new_volume(self, parent: str, title: str, moniker: str | None = None, tags: list[str] = (), force: bool = False) -> str:
        name = "-".join(x for x in (moniker, _clean(title)) if x)
        return self._init(f"{parent}/{name}", VOLUME, self._definition(title, moniker, tags), force)

    @staticmethod
    def _definition(title: str | None, moniker: str | None, tags: list[str]) -> dict[str, Any]:
        return {k: v for k, v in {"title": title, "moniker": moniker, "tags": sorted(set(tags))}.items() if v}

    @staticmethod
    def enclosing(path: str, mark: str = VOLUME) -> str:
        """The nearest directory at or above ``path`` that is marked."""
        at = Path(path)
        if not at.exists():
            raise CatalogError(f"{path} does not exist")
        if not at.is_dir():
            raise CatalogError(f"{path} is not a directory")
        for d in (at, *at.parents):
            if (d / mark / "version").exists():
                return str(d)
        raise CatalogError(f"{path} is in no {mark[9:]}")

    def info(self, path: str, mark: str = VOLUME) -> dict[str, Any]:
        base = Path(self.enclosing(path, mark))
        text = (base / DEFINITIONS[mark]).read_text()
        return {"path": str(base), "definitionVersion": (base / mark / "version").read_text().strip(), **(next(documents(text, str(base)), None) or {})}

    def set(self, path: str, name: str, value: str) -> None:
        if name not in SETTABLE:
            raise CatalogError(f"unknown property {name}")
        base = self.enclosing(path)
        found = {k: v for k, v in self.info(path).items() if k not in ("path", "definitionVersion")}
        (Path(base) / "volume.yaml").write_text(to_yaml([found | {name: value}]))

    def rename(self, path: str, title: str | None = None) -> str:
        """Gives a volume the directory name that its moniker and title make."""
        base, found = Path(self.enclosing(path)), self.info(path)
        target = base.parent / "-".join(x for x in (found.get("moniker"), _clean(title or found.get("title") or base.name)) if x)
        if target != base:
            if target.exists():
                raise CatalogError(f"{target} exists")
            base.rename(target)
        if title:
            self.set(str(target), "title", title)
        return str(target)

    def import_sources(self, volume: str, patterns: list[str]) -> list[str]:
        """Copies files into the volume's source folder; two of one name, in any case, are an error."""
        found = []
        for p in patterns:
            parent, name = os.path.split(p)
            found += sorted(os.path.join(parent, x) for x in os.listdir(parent or ".") if fnmatch.fnmatch(x, name))
        names = [os.path.basename(x).lower() for x in found]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise CatalogError(f"several files named {', '.join(twice)}")
        target = Path(self.enclosing(volume)) / "source"
        target.mkdir(exist_ok=True)
        return [shutil.copy(x, target) for x in found]

    def volumes(self, base: str) -> DataFrame:
        """All volumes below a directory, with their definitions."""
        rows = []
        for d, names, _ in os.walk(base):
            names.sort()
            if (Path(d) / VOLUME / "version").exists():
                i = self.info(d)
                rows.append((d, i.get("moniker"), i.get("title"), i.get("language"), i.get("tags") or [], i.get("linkedVolumes") or [], i.get("workflow"), i["definitionVersion"]))
        return self.spark.createDataFrame(sorted(rows), SCHEMA)


def config_get(config: dict[str, Any], path: str) -> Any:
    """The value at a dotted path; null if any part is missing."""
    for part in path.split("."):
        config = config.get(part) if isinstance(config, dict) else None
    return config


def config_set(config: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    head, _, rest = path.partition(".")
    return {**config, head: config_set(config.get(head) if isinstance(config.get(head), dict) else {}, rest, value) if rest else value}


def load_config(*paths: str) -> dict[str, Any]:
    """Settings of several files; later ones win, part by part."""

    def over(a: dict, b: dict) -> dict:
        return {**a, **{k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    out: dict[str, Any] = {}
    for p in paths:
        if os.path.exists(p):
            out = over(out, yaml.safe_load(Path(p).read_text()) or {})
    return out
