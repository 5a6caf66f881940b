"""Settings of a fold, and the parsers of their textual forms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The detectors that can be switched off, by name, in the order in which they run.
DETECTORS = ("timestamp", "email", "path", "json", "uuid", "ip", "port", "fqdn", "hash", "pid", "kubernetes", "http-status", "bracket", "key-value", "duration", "name", "quoted")
#: Other names of detectors, and of several at once.
GROUPS = {"network": ("ip", "port", "fqdn"), "process": ("pid",), "brackets": ("bracket",), "quoted-string": ("quoted",)}
#: Output formats and their other names.
FORMATS = {"text": "text", "plain": "text", "markdown": "markdown", "md": "markdown", "json": "json", "jsonl": "json"}
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def parse_size(text: str) -> int:
    """A byte count with an optional binary suffix K, M or G."""
    found = re.fullmatch(r"\s*\+?([0-9]+)([kKmMgG]?)\s*", text)
    if not found:
        raise ValueError(f"invalid size: {text!r}")
    return int(found[1]) * _UNITS[found[2].lower()]


def parse_format(text: str) -> str:
    """The output format that a name in any case stands for."""
    try:
        return FORMATS[text.lower()]
    except KeyError:
        raise ValueError(f"unknown format {text!r}; one of {', '.join(FORMATS)}") from None


def parse_detectors(text: str) -> frozenset[str]:
    """A comma-separated list of names of detectors or groups of them, in any case."""
    names = [x.strip().lower() for x in text.split(",") if x.strip()]
    found = frozenset(d for x in names for d in GROUPS.get(x, (x,)))
    if unknown := found - set(DETECTORS):
        raise ValueError(f"unknown detector {', '.join(sorted(unknown))}; one of {', '.join((*DETECTORS, *GROUPS))}")
    return found


@dataclass(frozen=True)
class FoldConfig:
    """What a fold does; validated on construction.

    threshold is the least similarity (0..100) at which a line joins a group; min_collapse the lines that a group needs
    to be collapsed. sanitize masks e-mail addresses in every output; raw_json keeps them in JSON records.
    """

    threshold: int = 75
    min_collapse: int = 3
    disabled: frozenset[str] = field(default_factory=frozenset)
    max_line_length: int | None = 1 << 20
    max_lines: int | None = None
    fail_pattern: str | None = None
    keep_color: bool = False
    essence: bool = False
    compact: bool = True
    sanitize: bool = False
    raw_json: bool = False
    output_format: str = "text"

    def __post_init__(self):
        if not 0 <= self.threshold <= 100:
            raise ValueError("threshold must be between 0 and 100")
        if self.min_collapse < 2:
            raise ValueError("min_collapse must be at least 2")
        if self.max_lines is not None and self.max_lines < 1:
            raise ValueError("max_lines must be at least 1")
        if unknown := self.disabled - set(DETECTORS):
            raise ValueError(f"unknown detector {', '.join(sorted(unknown))}")
        object.__setattr__(self, "output_format", parse_format(self.output_format))
        if self.fail_pattern is not None:
            re.compile(self.fail_pattern)

    def on(self, detector: str) -> bool:
        return detector not in self.disabled
