"""Normalization: a line to its template and the typed values that were taken out of it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.config import FoldConfig

from . import detectors as d
from . import timestamps
from .rewrite import Detector, Match, Note, Pass, has, mask, remember

# Fixed values. Possessive, so that a long literal neither recurses nor backtracks.
QUOTED = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"')
LONG_QUOTE = 25

_NETWORK = d.network()
_INNER: list[Callable[[str], tuple[str, list[Note]]]] = [timestamps.run, d.path.run, d.uuid.run, _NETWORK.run, d.hashes.run, d.process.run, d.duration.run, d.name.run]


def _inside(inner: str) -> str:
    text = inner
    for step in _INNER:
        text, _ = step(text)
    if text != inner:
        return f'"{text}"'
    return "<QUOTED_STRING>" if len(inner.encode()) > LONG_QUOTE - 2 else f'"{inner}"'


#: Short strings come again and again.
_remembered = lru_cache(4096)(_inside)


def _quoted(m: Match) -> str:
    inner = m[0][1:-1]
    if "\\" in inner and any(c in inner for c in ":{["):
        return "<ESCAPED_JSON>"
    return _remembered(inner) if len(inner) <= 200 else _inside(inner)


class _Quoted(Pass):
    """Notes a quoted string if, and only if, it is replaced."""

    def run(self, text: str, seen: list[Note]) -> str:
        def replace(m: Match) -> str:
            put = _quoted(m)
            if put != m[0]:
                seen.append(("QUOTED_STRING", m[0]))
            return put

        return QUOTED.sub(replace, text)


quoted = Detector(has('"'), [_Quoted(QUOTED, "")], lambda text, masked: '"' not in text)


def stages(config: FoldConfig) -> list:
    """The detectors that run, in their fixed order; the order is part of what a template means. Each has run(text) and
    settled(text, mask)."""
    on = config.on
    net = d.network(on("ip"), on("port"), on("fqdn"))
    table = [
        (on("timestamp"), timestamps),
        (on("email"), d.email),
        (on("path"), d.path),
        (on("json"), d.json),
        (on("uuid"), d.uuid),
        (on("ip") or on("port") or on("fqdn"), net),
        (on("hash"), d.hashes),
        (on("pid"), d.process),
        (on("kubernetes"), d.kubernetes),
        (on("http-status"), d.http_status),
        (on("bracket"), d.bracket),
        (on("key-value"), d.key_value),
        (True, d.log_module),
        (True, d.structured),
        (on("duration"), d.duration),
        (on("name"), d.name),
        (on("quoted"), quoted),
    ]
    return [stage for wanted, stage in table if wanted]


#: What a line's mask may not hold if all lines with that mask are to be done alike: paths, addresses in hexadecimal,
#: digits in brackets or after signs, ports, status codes, and values that could be addresses.
_SENSITIVE = re.compile(rb'["/<]|->|::|0x|\[[^\]]*0|\(0|\bp?id=0|[a-zA-Z0-9.\-\]]:00|\s000(?![0-9])|[=:].*0\.0+\.0', re.DOTALL)
_OCTETS = re.compile(rb"(?<=\.)(?<![0])000(?![0])|(?<![0])000(?=\.)")
#: Kinds of values that are noted as they stand in a line.
_WHOLE = frozenset("TIMESTAMP EMAIL UUID IPV4 HASH DURATION SIZE NUMBER NAME".split())
_DIGITS = re.compile("[0-9]+")
_digits = _DIGITS.search


class Recipe:
    """How lines with one mask are done: what their template and notes take from which places. Digits have no part in what
    is found in such lines, but for numbers of three digits beside a dot, which must be at most 255 (`octets`)."""

    def __init__(self, octets: list[int], template: str, runs: list[tuple[int, int]], notes: list[tuple[str, str | None, int, int]]):
        self.octets, self.notes, self.checked = octets, notes, False
        self.parts = _DIGITS.split(template)
        self.runs = runs

    def done(self, line: str) -> tuple[str, list[Note]] | None:
        for at in self.octets:
            if line[at : at + 3] > "255":
                return None
        template = self.parts[0]
        for (a, b), part in zip(self.runs, self.parts[1:]):
            template += line[a:b] + part
        return template, [(kind, line[a:b] if value is None else value) for kind, value, a, b in self.notes]


def _alike(line: str, masked: bytes, stamps: bool) -> bool:
    """Whether the detectors treat all digits of a line alike, octets of addresses apart."""
    if not line.isascii() or b"<" in masked or stamps and not timestamps.alike(line, masked):
        return False
    text = timestamps.run(line)[0].replace("<TIMESTAMP>", "T") if stamps else line
    return not _SENSITIVE.search(mask(text)) and text.count(":") < 6 and not d.by_words(text)


def _recipe(line: str, masked: bytes, template: str, notes: list[Note]) -> Recipe | None:
    """The recipe that a line and its result show, if they do so beyond doubt."""
    octets = [m.start() for m in _OCTETS.finditer(masked)]
    if any(line[at : at + 3] > "255" for at in octets) or template.count("<IP>") > 1 or "K8S" in template or "HTTP_STATUS" in template:
        return None
    taken: list[tuple[str, str | None, int, int]] = []
    for kind, value in notes:
        if not _digits(value):
            taken.append((kind, value, 0, 0))
            continue
        at = line.find(value)
        if kind not in _WHOLE or at < 0 or line.find(value, at + 1) >= 0:
            return None
        taken.append((kind, None, at, at + len(value)))
    there: dict[str, list[tuple[int, int]]] = {}
    for m in _DIGITS.finditer(line):
        there.setdefault(m[0], []).append(m.span())
    runs = []
    for m in _DIGITS.finditer(template):
        found = there.get(m[0], [])
        if len(found) != 1:
            return None
        a, b = found[0]
        if template[: m.start()][-1:] != line[:a][-1:] or template[m.end() :][:1] != line[b:][:1]:
            return None
        runs.append(found[0])
    return Recipe(octets, template, runs, taken)


#: Masks with a recipe, and masks seen, that a worker remembers; and lines from which a recipe is tried.
RECIPES, SEEN, TRIES = 1 << 15, 1 << 16, 3


def normalizer(config: FoldConfig = FoldConfig()) -> Callable[[str], tuple[str, list[Note]]]:
    """A function from a line to (template, notes). It remembers which stages a mask is settled for, and, for masks that
    come again and whose digits have no part in what is found, the whole recipe."""
    steps: list[tuple] = [(s.run, s.settled, set()) for s in stages(config)]
    recipes: dict[bytes, Recipe | int] = {}  # or how often no recipe was found
    seen: set[bytes] = set()
    stamps = config.on("timestamp")

    def slowly(line: str, masked: bytes) -> tuple[str, list[Note]]:
        notes: list[Note] = []
        for step, settled, known in steps:
            if masked in known:
                continue
            text, found = step(line)
            if found or text != line:
                line, masked = text, mask(text)
                notes += found
            elif settled(line, masked):
                remember(known, masked)
        return line, notes

    def run(line: str) -> tuple[str, list[Note]]:
        masked = mask(line)
        recipe = recipes.get(masked)
        if recipe is None:
            if masked not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(masked)
                return slowly(line, masked)
            if len(recipes) >= RECIPES:
                recipes.clear()
            recipe = recipes[masked] = 0 if _alike(line, masked, stamps) else TRIES
        if isinstance(recipe, Recipe):
            found = recipe.done(line)
            if found is None:
                return slowly(line, masked)
            if recipe.checked:
                return found
            want = slowly(line, masked)
            if found == want:
                recipe.checked = True
            else:
                recipes[masked] = TRIES
            return want
        found = slowly(line, masked)
        if recipe < TRIES:
            recipes[masked] = _recipe(line, masked, *found) or recipe + 1
        return found

    return run


@lru_cache(8)
def _shared(config: FoldConfig) -> Callable[[str], tuple[str, list[Note]]]:
    """What a worker remembers from task to task."""
    return normalizer(config)


TOKENS = "array<struct<type: string, value: string>>"


def _tokens(notes: list[list[Note] | None]) -> pa.Array:
    """Notes as an array of TOKENS; no dictionary for each of them."""
    kinds, values = pa.array([k for n in notes if n for k, _ in n], pa.string()), pa.array([v for n in notes if n for _, v in n], pa.string())
    ends = [0]
    for n in notes:
        ends.append(ends[-1] + len(n or ()))
    found = pa.StructArray.from_arrays([kinds, values], ["type", "value"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array([n is None for n in notes], pa.bool_()))


#: Plans that a scan's partitions do not pass through unchanged; they are dealt out already.
_MOVED = re.compile(r"\b(?:Join|Aggregate|Window|Sort|Repartition|RepartitionByExpression|Distinct|Limit)\b")
#: Bytes of a table that are worth a task, and tasks for each core where its size is not known.
TASK_BYTES, WAVES = 1 << 20, 4


def spread(lines: DataFrame) -> DataFrame:
    """Lines of a scan, dealt out evenly: the patterns cost far more than moving a line. A scan has partitions by bytes of
    its files, but a row group, which may hold a million lines, is always read by one of them, and others are empty then.
    A stream's micro-batches come in any number of files, so they are dealt out, too."""
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if lines.isStreaming:
        return lines.repartition(cores)
    plan = lines._jdf.queryExecution().optimizedPlan()  # noqa: SLF001
    if _MOVED.search(plan.toString()):
        return lines
    size = int(str(plan.stats().sizeInBytes()))
    return lines.repartition(max(cores, -(-size // TASK_BYTES)) if size < 1 << 50 else cores * WAVES)


def normalized(lines: DataFrame, config: FoldConfig = FoldConfig(), column: str = "line") -> DataFrame:
    """Adds normalized and tokens. Lines stream through in Arrow batches; within a batch equal lines are done once."""

    def run(batches):
        one = _shared(config)
        for batch in batches:
            texts = batch.column("__text").dictionary_encode()
            done = [one(t) if t is not None else (None, None) for t in texts.dictionary.to_pylist()]
            index = texts.indices
            templates = pa.array([t for t, _ in done], pa.string()).take(index)
            tokens = _tokens([n for _, n in done]).take(index)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, templates, tokens], [*names, "normalized", "tokens"])

    names = lines.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in lines.schema)}, normalized string, tokens {TOKENS}"
    return spread(lines).withColumn("__text", F.col(column)).mapInArrow(run, schema)
