"""The machinery of detectors: passes of a pattern over a text that replace and take notes.

A detector is a gate and a list of passes. A pass replaces every match that its condition accepts and notes typed
values of it; both see the whole text of the pass, as conditions depend on words elsewhere in the line.

Log lines differ in little but their digits, and most detectors treat all digits alike. A detector that left a text alone
therefore need not look at another one with the same mask, where every digit is a zero, if `settled` says that the digits
had no part in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: A noted value: token type and canonical value.
Note = tuple[str, str]
Match = re.Match[str]

_MASK = bytes.maketrans(b"123456789", b"0" * 9)
#: Masks that a pass or a stage remembers.
KNOWN = 4096


def mask(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_MASK)


def remember(known: set[bytes], masked: bytes) -> None:
    if len(known) >= KNOWN:
        known.clear()
    known.add(masked)


class Notes(list):
    """Notes in order, with a set beside them to tell what was noted before."""

    def __init__(self):
        super().__init__()
        self.known: set[Note] = set()

    def extend(self, more) -> None:
        super().extend(more)
        self.known.update(more)

    def __contains__(self, note) -> bool:
        return note in self.known


def required(pattern: re.Pattern[str]) -> tuple[str, ...]:
    """Literals that every match of a pattern holds; checking for them first is much faster than searching in vain."""
    try:
        from re import _constants, _parser
    except ImportError:  # only speed depends on it
        return ()
    runs: list[str] = [""]

    def walk(items) -> None:
        for op, arg in items:
            if op is _constants.LITERAL:
                runs[-1] += chr(arg)
                continue
            if op is _constants.AT:  # has no width
                continue
            runs.append("")
            if op is _constants.SUBPATTERN and not arg[1]:
                walk(arg[3])
            elif op in (_constants.MAX_REPEAT, _constants.POSSESSIVE_REPEAT) and arg[0] >= 1:
                walk(arg[2])
            runs.append("")

    if pattern.flags & re.IGNORECASE:
        return ()
    walk(_parser.parse(pattern.pattern, pattern.flags))
    return tuple(dict.fromkeys(r for r in runs if r))


def _nothing(match: Match, seen: list[Note]) -> list[Note]:
    return []


def whole(kind: str) -> Callable[[Match, list[Note]], list[Note]]:
    """Notes the match."""
    return lambda m, seen: [(kind, m[0])]


def group(kind: str, n: int = 1, when: Callable[[str], bool] | None = None, prefix: str = "") -> Callable[[Match, list[Note]], list[Note]]:
    """Notes a group of the match, if it is there and passes."""
    return lambda m, seen: [(kind, prefix + m[n])] if m[n] is not None and (when is None or when(m[n])) else []


def within(n: int, put: str) -> Callable[[Match], str]:
    """The match with its group n replaced in place."""
    return lambda m: m[0][: m.start(n) - m.start()] + put + m[0][m.end(n) - m.start() :]


@dataclass
class Pass:
    """One pattern over the text. `needs` is a literal without which the pattern cannot match; it only saves time, as do
    the literals that the pattern shows by itself. A `steady` pass treats all digits alike."""

    pattern: re.Pattern[str]
    put: str | Callable[[Match], str]
    note: Callable[[Match, list[Note]], list[Note]] = _nothing
    accept: Callable[[Match, str], bool] | None = None
    context: Callable[[str], bool] | None = None
    needs: str = ""
    steady: bool = False
    known: set[bytes] = field(default_factory=set, repr=False)

    def __post_init__(self):
        self.literals = (*([self.needs] if self.needs else []), *(r for r in required(self.pattern) if r != self.needs))

    def run(self, text: str, seen: list[Note]) -> str:
        for literal in self.literals:
            if literal not in text:
                return text
        if self.context is not None and not self.context(text):
            return text

        def replace(m: Match) -> str:
            if self.accept is not None and not self.accept(m, text):
                return m[0]
            seen.extend(self.note(m, seen))
            return self.put if isinstance(self.put, str) else self.put(m)

        return self.pattern.sub(replace, text)


def always(text: str, masked: bytes) -> bool:
    return True


def never(text: str, masked: bytes) -> bool:
    return False


@dataclass
class Detector:
    """`settled` is asked of a text that was left alone, and its mask: whether all texts with that mask are."""

    gate: Callable[[str], bool]
    passes: list[Pass] = field(default_factory=list)
    settled: Callable[[str, bytes], bool] = never

    def run(self, text: str) -> tuple[str, list[Note]]:
        seen = Notes()
        if self.gate(text):
            masked = mask(text)
            for step in self.passes:
                if masked in step.known:
                    continue
                before, noted = text, len(seen)
                text = step.run(text, seen)
                if text != before:
                    masked = mask(text)
                elif step.steady and len(seen) == noted:
                    remember(step.known, masked)
        return text, seen


def has(*words: str) -> Callable[[str], bool]:
    """Whether a text holds one of the words."""
    if len(words) < 3:
        return lambda text: any(w in text for w in words)
    search = re.compile("|".join(map(re.escape, words))).search
    return lambda text: search(text) is not None


def number(text: str, most: int) -> int | None:
    """The value of ASCII digits up to a bound."""
    return v if text.isascii() and (v := int(text)) <= most else None
