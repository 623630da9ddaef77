"""Settings from the environment: unknown values fall back to the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ENVIRONMENTS, LEVELS = ("development", "test", "production"), ("debug", "info", "warn", "error")


@dataclass(frozen=True)
class Config:
    environment: str = "development"
    log_level: str = "info"

    @staticmethod
    def load(values: dict[str, str] | None = None) -> Config:
        given = os.environ if values is None else values
        pick = lambda name, allowed, default: given[name] if given.get(name) in allowed else default
        return Config(pick("TALLY_ENV", ENVIRONMENTS, "development"), pick("TALLY_LOG_LEVEL", LEVELS, "info"))

    def logs(self, level: str) -> bool:
        """Whether messages of ``level`` are shown."""
        return LEVELS.index(level) >= LEVELS.index(self.log_level)

    def shown(self, level: Column) -> Column:
        """Whether messages of a column of levels are shown; unknown levels and null aren't."""
        return F.coalesce(level.isin(*[x for x in LEVELS if self.logs(x)]), F.lit(False))
