"""Settings as a JSON file over defaults; unknown keys survive a round trip."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

BOUNDS = {"embedding_dimensions": (1, 8192), "embedding_batch_size": (1, 512), "chunk_size": (50, 10000), "chunk_overlap": (0, 1000), "top_k": (1, 1000), "rrf_k": (1, 1000)}


def expand(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def unexpand(path: str) -> str:
    home = os.path.expanduser("~")
    return "~" + path[len(home) :] if path == home or path.startswith(home + "/") else path


@dataclass
class Config:
    db_path: str = "~/.lectern/store"
    embedding_model: str = "bge-m3"
    embedding_dimensions: int = 1024
    embedding_batch_size: int = 32
    embedding_hosts: list[str] = field(default_factory=list)
    chunk_size: int = 500
    chunk_overlap: int = 50
    vaults: list[str] = field(default_factory=list)
    vault_exclude_folders: list[str] = field(default_factory=list)
    mail_path: str = ""
    feed_path: str = ""
    book_libraries: list[str] = field(default_factory=list)
    repositories: dict[str, list[str]] = field(default_factory=dict)
    projects: dict[str, list[str]] = field(default_factory=dict)
    disabled_collections: list[str] = field(default_factory=list)
    git_history_months: int = 6
    git_subject_blacklist: list[str] = field(default_factory=list)
    reindex_interval_minutes: int = 0
    top_k: int = 10
    rrf_k: int = 60
    vector_weight: float = 0.7
    text_weight: float = 0.3
    unknown: dict = field(default_factory=dict)

    def enabled(self, name: str) -> bool:
        return name not in self.disabled_collections

    def store(self) -> str:
        return expand(self.db_path)

    def _paths_of(self, collection: str) -> list[str]:
        lists = {"obsidian": self.vaults, "calibre": self.book_libraries}
        got = lists.get(collection, self.repositories.get(collection, self.projects.get(collection)))
        if got is None:
            raise KeyError(collection)
        return got

    def list_paths(self, collection: str) -> list[str]:
        return list(self._paths_of(collection))

    def add_paths(self, collection: str, new: list[str]) -> list[str]:
        """The paths in order, each once."""
        got = self._paths_of(collection)
        got[:] = list(dict.fromkeys([*got, *map(unexpand, new)]))
        return list(got)

    def remove_paths(self, collection: str, gone: list[str]) -> list[str]:
        got, drop = self._paths_of(collection), {expand(p) for p in gone}
        got[:] = [p for p in got if expand(p) not in drop]
        return list(got)

    def update_path(self, collection: str, old: str, new: str) -> list[str]:
        got = self._paths_of(collection)
        got[:] = [unexpand(new) if expand(p) == expand(old) else p for p in got]
        return list(got)

    @classmethod
    def load(cls, path: str) -> Config:
        """Defaults for a missing or unreadable file; known keys of the right type are taken over."""
        config = cls()
        try:
            with open(expand(path), encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            return config
        if not isinstance(data, dict):
            return config
        if "reindex_interval_hours" in data and "reindex_interval_minutes" not in data:
            data["reindex_interval_minutes"] = int(data.pop("reindex_interval_hours") * 60)
        known = {f.name for f in fields(cls)} - {"unknown"}
        for key, value in data.items():
            if key in known and isinstance(value, (int, float) if isinstance(getattr(config, key), float) else type(getattr(config, key))):
                setattr(config, key, value)
            elif key not in known:
                config.unknown[key] = value
        return config

    def save(self, path: str) -> None:
        data = asdict(self)
        data |= data.pop("unknown")
        data["db_path"] = unexpand(data["db_path"])
        path = expand(path)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(data, f, indent=2, ensure_ascii=False)
        os.replace(path + ".new", path)

    def problems(self) -> list[str]:
        return [f"{k} must lie in {lo}..{hi}" for k, (lo, hi) in BOUNDS.items() if not lo <= getattr(self, k) <= hi]
