"""Command line: folds text files or standard input with a local or submitted Spark session."""

from __future__ import annotations

import argparse
import json
import os
import re
import shutil
import sys
import time

from lineweave.config import FoldConfig, parse_detectors, parse_format, parse_size


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lineweave", description="Fold repetitive logs into templates with counts.")
    p.add_argument("files", nargs="*", help="text files; - or none is standard input")
    p.add_argument("--threshold", type=int, default=75, help="least similarity of a group's lines, 0 to 100")
    p.add_argument("--min-collapse", type=int, default=3)
    p.add_argument("--disable-patterns", type=parse_detectors, default=frozenset(), help="detectors to switch off, comma-separated")
    p.add_argument("-q", "--quiet", "--no-stats", action="store_true", help="no statistics after the output")
    p.add_argument("--preserve-color", action="store_true")
    p.add_argument("--summary", action="store_true", help="one line for each template")
    p.add_argument("--preflight", action="store_true", help="statistics as JSON, without output")
    p.add_argument("--format", type=parse_format, default="text", help="text, markdown or json")
    p.add_argument("--essence", action="store_true", help="print templates only")
    p.add_argument("--threads", type=int, help="local cores; a submitted session has its own")
    p.add_argument("--sanitize-pii", action="store_true", help="mask e-mail addresses")
    p.add_argument("--max-line-length", type=parse_size, default=1 << 20, help="skip longer lines (bytes, K, M, G)")
    p.add_argument("--max-lines", type=int)
    p.add_argument("--stats-json", action="store_true", help="statistics as JSON on standard error")
    p.add_argument("--top", type=int, help="the N largest groups; with --summary 0 is all")
    p.add_argument("--fit", "--human", action="store_true", help="as many lines as the terminal has")
    p.add_argument("--fail-on-pattern", help="exit with 1 if a raw line matches")
    p.add_argument("--completions", choices=SHELLS, help="print a completion script")
    return p


SHELLS = ("bash", "elvish", "fish", "powershell", "zsh")


def completions(shell: str = "bash") -> str:
    """A script for a shell that completes options, and else file names."""
    flags = [o for a in parser()._actions for o in a.option_strings]  # noqa: SLF001
    quoted = ", ".join(f"'{f}'" for f in flags)
    if shell == "fish":
        return "\n".join(f"complete -c lineweave {'-l ' + f[2:] if f.startswith('--') else '-s ' + f[1:]}" for f in flags)
    return {
        "bash": f"complete -o default -W '{' '.join(flags)}' lineweave",
        "zsh": f"#compdef lineweave\n_arguments {' '.join(flags)} '*:file:_files'",
        "elvish": f"set edit:completion:arg-completer[lineweave] = {{|@args| put {' '.join(flags)} }}",
        "powershell": f"Register-ArgumentCompleter -Native -CommandName lineweave -ScriptBlock {{ param($word) @({quoted}) | Where-Object {{ $_ -like \"$word*\" }} }}",
    }[shell]


def fit_budget(rows: int | None) -> int | None:
    """Lines that fit a terminal of so many rows, if it has any to spare."""
    return rows - 4 if rows is not None and rows - 4 >= 3 else None


def config_of(args: argparse.Namespace) -> FoldConfig:
    if args.threads is not None and args.threads < 1:
        raise ValueError("threads must be at least 1")
    return FoldConfig(
        threshold=args.threshold, min_collapse=args.min_collapse, disabled=args.disable_patterns, max_line_length=args.max_line_length, max_lines=args.max_lines,
        fail_pattern=args.fail_on_pattern, keep_color=args.preserve_color, essence=args.essence, sanitize=args.sanitize_pii, output_format=args.format,
    )


def run(spark, args: argparse.Namespace, out=None, err=None) -> int:
    """Prints what the arguments ask for; returns the exit code. Order of precedence: preflight, summary, top, format."""
    from pyspark.sql import functions as F

    from lineweave.operators.views import summary_line
    from lineweave.plans import render
    from lineweave.plans.fold import Fold
    from lineweave.sources.lines import NoInputError, read_lines

    out, err = out or sys.stdout, err or sys.stderr
    began = time.monotonic()
    try:
        config = config_of(args)
    except (ValueError, re.error) as e:
        print(f"lineweave: {e}", file=err)
        return 2
    try:
        lines = read_lines(spark, args.files or ["-"])
    except NoInputError as e:
        print(f"lineweave: {e}", file=err)
        return 1
    fold = Fold(spark, lines, config)
    say = lambda *x: print(*x, file=out)
    tty = hasattr(out, "isatty") and out.isatty()
    size = shutil.get_terminal_size() if tty else None
    budget = fit_budget(size.lines if size else None) if args.fit else None
    elapsed = lambda: int((time.monotonic() - began) * 1000)
    summary = args.summary or args.fit and args.top is None
    if args.preflight:
        say(json.dumps(fold.preflight(), indent=2))
    elif summary:
        rows, message, hidden = fold.summary(args.top, budget)
        for r in rows.select(summary_line(F.col("count"), F.col("line"), size.columns if size else None).alias("s")).toLocalIterator():
            say(r.s)
        if hidden:
            say(f"... {hidden} more patterns (remove --fit for full output)")
        print(message, file=err)
    elif args.top is not None:
        n = args.top if budget is None or args.top <= budget else max(budget - 1, 0)
        for r in fold.top(n).toLocalIterator():
            say(f"[{r['count']}x] {r['text']}")
    elif config.output_format == "json":
        for r in fold.records().toLocalIterator():
            say(r.record)
        say(render.summary_record(fold.stats, elapsed()))
    elif config.output_format == "markdown":
        say(render.markdown_head(fold.stats))
        for i, r in enumerate(fold.text().toLocalIterator(), 1):
            say(render.markdown_entry(i, r.text))
    else:
        for r in fold.text().toLocalIterator():
            say(r.text)
    if args.stats_json and config.output_format != "json":
        print(json.dumps(render.stats_json(fold.stats, elapsed())), file=err)
    elif not (args.quiet or args.preflight or summary or args.top is not None or config.output_format != "text"):
        say(render.stats_report(fold.stats))
    code = int(fold.matched)
    fold.scratch.clear()
    return code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.completions:
        print(completions(args.completions))
        return 0
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("lineweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = builder.master(f"local[{args.threads or '*'}]").getOrCreate() if "SPARK_MASTER" not in os.environ else builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, args)
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0


if __name__ == "__main__":
    sys.exit(main())
