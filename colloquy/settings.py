"""Typed settings with defaults, which a session's configuration may override as colloquy.<name>; other keys are ignored."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "colloquy."


@dataclass(frozen=True)
class Settings:
    # The defaults.
    default_model: str = "small:1b"
    temperature: float = 0.7
    max_tokens: int = 800
    num_ctx: int = 4096
    max_history_messages: int = 20
    session_ttl_minutes: int = 180
    max_sessions: int = 500
    cors_origins: str = "*"

    @property
    def origins(self) -> list[str]:
        """The listed origins without blanks; * is one by itself."""
        return ["*"] if self.cors_origins.strip() == "*" else [x for x in map(str.strip, self.cors_origins.split(",")) if x]


def settings(spark: SparkSession) -> Settings:
    """Raises ValueError for an override that isn't of its setting's type."""
    given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    return Settings(**{f.name: type(f.default)(given[f.name]) for f in fields(Settings) if given[f.name] is not None})
