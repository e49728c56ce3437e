"""Configuration from a JSON file, with defaults."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields
from pathlib import Path

log = logging.getLogger(__name__)
FILE = "weftgraph.json"
MAX_FILE_SIZE = 1 << 20


@dataclass
class Config:
    max_file_size: int = MAX_FILE_SIZE
    disabled_languages: list[str] = field(default_factory=list)
    extra_roots: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, root: str) -> Config:
        """The project's file; a missing one gives defaults, a malformed one or unknown keys a warning and defaults."""
        path = Path(root) / FILE
        if not path.exists():
            return cls()
        try:
            told = json.loads(path.read_text())
            unknown = set(told) - {f.name for f in fields(cls)}
            if unknown:
                raise ValueError(f"unknown keys {sorted(unknown)}")
            return cls(**told)
        except (ValueError, TypeError, AttributeError) as e:
            log.warning("%s is not used: %s", path, e)
            return cls()

    def enabled(self, language: str) -> bool:
        return language not in self.disabled_languages
