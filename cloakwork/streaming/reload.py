"""A configuration file that may change between micro-batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from cloakwork.plans.engine import Engine
from cloakwork.sources.config import read_config


class ReloadingEngine:
    """The engine of a file's latest valid version; a broken version keeps the one before and is told by `error`."""

    def __init__(self, path: str):
        self.path, self.seen, self.error = path, None, None
        self.engine = Engine(read_config(path))
        self.seen = self._stamp()

    def _stamp(self) -> tuple[int, int]:
        s = os.stat(self.path)
        return s.st_mtime_ns, s.st_size

    def current(self) -> Engine:
        stamp = self._stamp()
        if stamp != self.seen:
            self.seen = stamp
            try:
                fresh = Engine(read_config(self.path))
                problems = fresh.check()
                self.error = problems[0] if problems else None
                self.engine = self.engine if problems else fresh
            except Exception as e:  # a half-written file, too
                self.error = str(e)
        return self.engine


def mask_batches(stream: DataFrame, path: str, sink, system: str | None = None):
    """A writer that masks each micro-batch under the configuration as it then is, and hands it to sink(df, batch_id)."""
    held = ReloadingEngine(path)
    return stream.writeStream.foreachBatch(lambda df, batch: sink(held.current().mask(df, system), batch))
