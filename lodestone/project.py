"""The project at work: its store, its session, and the switch to another."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lodestone.plans.index import index_project
from lodestone.sources import config as conf
from lodestone.sources.store import Store


@dataclass
class Project:
    """An indexed project with an open session."""

    spark: SparkSession
    root: str
    config: conf.Config
    store: Store
    session: int
    counts: dict[str, int]

    @classmethod
    def open(cls, spark: SparkSession, root: str, now_ms: int, storage: str | None = None) -> Project:
        """Index the project at ``root`` into its own store and open a session. Each root has its own store."""
        config = conf.load_config(root)
        at = conf.index_path(root, storage or config.storage)
        store = Store(spark, f"file://{os.path.abspath(at)}/tables")
        counts = index_project(spark, root, store, now_ms, config)
        return cls(spark, root, config, store, store.start_session(now_ms), counts)

    def close(self, now_ms: int) -> None:
        """End the session with a snapshot."""
        self.store.end_session(self.session, now_ms)

    def holds(self, path: str) -> bool:
        return os.path.commonpath([self.root, os.path.abspath(path)]) == self.root

    def relative(self, path: str) -> str:
        """A path as it is indexed; relative ones are of this project already."""
        return os.path.relpath(path, self.root).replace(os.sep, "/") if os.path.isabs(path) else path.replace(os.sep, "/")


def switched(current: Project | None, spark: SparkSession, path: str, now_ms: int, storage: str | None = None) -> Project:
    """The project that holds ``path``: the current one, or the one around it, opened after the current one is closed.

    Raises ``ValueError`` if there is none: a relative path without a project, or a path that doesn't exist.
    """
    if not os.path.isabs(path):
        if current is None:
            raise ValueError("no project is set: give an absolute path")
        return current
    if current and current.holds(path) and conf.project_root(path if os.path.isdir(path) else os.path.dirname(path)) in (current.root, path):
        return current
    if not os.path.exists(path):
        raise ValueError(f"no such path: {path}")
    root = conf.project_root(path if os.path.isdir(path) else os.path.dirname(path))
    if current and current.root == root:
        return current
    if current:
        current.close(now_ms)
    return Project.open(spark, root, now_ms, storage)
