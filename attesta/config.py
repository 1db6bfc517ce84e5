"""Settings with defaults, read from the environment (prefix ``ATTESTA_``) or a ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "ATTESTA_"


@dataclass(frozen=True)
class Settings:
    # workflow
    brain_dir: str = "./brain"
    chunk_size: int = 6000
    # Fixed values from here on: defaults that results depend on.
    # ledger
    promote_threshold: float = 0.15
    high_authority_threshold: float = 0.8
    corroboration_count: int = 2
    # conflicts
    enable_conflict_resolution: bool = False
    resolve_strategy: str = "authority_wins"
    conflict_similarity_threshold: float = 0.8
    auto_resolve_threshold: float = 0.3
    # vectors
    enable_ingestion_embeddings: bool = True
    semantic_dedup_threshold: float = 0.92
    # calls of an outside extractor
    llm_max_concurrent: int = 8
    llm_rate_limit_rpm: int = 500
    llm_retry_max: int = 3
    llm_request_timeout: float = 30.0

    @classmethod
    def load(cls, env: dict[str, str] | None = None, env_file: str | None = ".env") -> "Settings":
        """Environment beats the file, the file beats the defaults; unknown names are ignored."""
        raw: dict[str, str] = {}
        if env_file and Path(env_file).is_file():
            for line in Path(env_file).read_text().splitlines():
                name, sep, value = line.partition("=")
                if sep and not name.lstrip().startswith("#"):
                    raw[name.strip()] = value.strip().strip("'\"")
        raw.update(os.environ if env is None else env)
        known = {}
        for f in fields(cls):
            value = raw.get(PREFIX + f.name.upper())
            if value is None:
                continue
            if isinstance(f.default, bool):
                known[f.name] = value.strip().lower() in ("1", "true", "yes", "on")
            else:
                known[f.name] = type(f.default)(value)
        return cls(**known)
