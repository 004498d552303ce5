"""Settings of a run: a frozen set of values that can be read from and written to JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Params:
    similarity_threshold: float = 80.0
    sample_frames: int = 5
    min_file_size: int = 10
    max_file_size: int = 50 << 20
    min_duration: float = 0.0
    max_duration: float | None = None
    extensions: tuple[str, ...] | None = None
    hash_prefix_chars: int | None = None
    keep: str = "largest"
    action: str = "trash"
    backup_folder: str = ""
    compat: bool = False

    def get(self, key: str, default=None):
        return getattr(self, key, default)

    def update(self, **changes) -> Params:
        """A copy with some values changed; unknown names are an error."""
        return dataclasses.replace(self, **changes)

    def set(self, key: str, value) -> Params:
        """A copy with one value changed."""
        return self.update(**{key: value})

    def reset(self, *keys: str) -> Params:
        """A copy with the defaults of the named values, or of all."""
        return type(self)() if not keys else self.update(**{k: getattr(type(self)(), k) for k in keys})

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.as_dict(), indent=2, ensure_ascii=False), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Params:
        """Values of a file over the defaults; a missing or unreadable file gives the defaults, unknown names are skipped."""
        try:
            held = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return cls()
        known = {f.name for f in dataclasses.fields(cls)}
        held = {k: tuple(v) if isinstance(v, list) else v for k, v in held.items() if k in known}
        return cls(**held)
