"""Settings of a run: values of a file, lists and bounds, and whether paid calls can be made."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: Fixed value: how the key of the example file begins.
PLACEHOLDER = "sk-ant-replace"


def file_value(path: str, key: str) -> str:
    """A value of a ``KEY=value`` file, without quotes around it; empty if there is no such file or key.

    The environment is never read, so that no key that happens to be set there can pay for a run.
    """
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except OSError:
        return ""
    for name, sep, value in (line.partition("=") for line in map(str.strip, lines) if not line.startswith("#")):
        if sep and name.strip() == key:
            value = value.strip()
            return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return ""


def listed(text: str) -> list[str]:
    """The entries of a comma-separated list."""
    return [x.strip() for x in text.split(",") if x.strip()]


@dataclass(frozen=True)
class Settings:
    approaches: list[str] = field(default_factory=lambda: ["rules"])
    angles: list[int] = field(default_factory=lambda: [0, 90, 180, 270])
    origins: list[str] = field(default_factory=lambda: ["http://localhost:3000"])
    max_upload_mb: int = 20
    key_file: str = ".env"
    key_name: str = "ANTHROPIC_API_KEY"

    @classmethod
    def parsed(cls, approaches: str = "rules", angles: str = "0,90,180,270", origins: str = "http://localhost:3000", **others) -> Settings:
        return cls(listed(approaches), [int(a) for a in listed(angles)], listed(origins), **others)

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb << 20

    @property
    def key(self) -> str:
        """The key for paid calls; a placeholder is none."""
        value = file_value(self.key_file, self.key_name)
        return "" if value.startswith(PLACEHOLDER) else value

    @property
    def key_state(self) -> str:
        """Where the key stands, for reports; never the key itself."""
        value = file_value(self.key_file, self.key_name)
        return "absent" if not value else "placeholder" if value.startswith(PLACEHOLDER) else f"{self.key_file} ({len(value)} characters)"

    def runnable(self) -> list[str]:
        """The approaches that can run: without a key only the rules."""
        return [a for a in self.approaches if a == "rules" or self.key]
