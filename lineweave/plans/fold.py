"""A fold: lines to normalized lines, templates, groups, rollups, records and statistics, each a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.config import FoldConfig
from lineweave.functions.normalize import normalized
from lineweave.operators import groups as g
from lineweave.operators import lines as ln
from lineweave.operators import views
from lineweave.operators.clustering import clusters, templates

from . import render
from .scratch import Scratch, numbered

#: Templates up to which the table of their groups is broadcast, with up to BROADCAST_BYTES of text.
BROADCAST_TEMPLATES, BROADCAST_BYTES = 200_000, 32 << 20


class Fold:
    """Folds lines (line_no, line). Everything is computed when it is first asked for; what several results share is
    written to a scratch table once."""

    def __init__(self, spark: SparkSession, lines: DataFrame, config: FoldConfig = FoldConfig()):
        self.spark, self.lines, self.config = spark, lines.select("line_no", "line"), config
        self.scratch = Scratch(spark, "fold")

    @cached_property
    def admitted(self) -> DataFrame:
        """Lines within the limits, raw."""
        return ln.limited(self.lines, self.config)

    @cached_property
    def matched(self) -> bool:
        """Whether an admitted raw line matches the fail pattern."""
        return self.config.fail_pattern is not None and bool(ln.any_match(self.admitted, self.config.fail_pattern).first()[0])

    @cached_property
    def normalized(self) -> DataFrame:
        """line_no, line, normalized, tokens."""
        rows = self.admitted if self.config.keep_color else self.admitted.withColumn("line", ln.plain(F.col("line")))
        return self.scratch.write(normalized(rows, self.config), "normalized")

    @cached_property
    def clusters(self) -> DataFrame:
        """normalized, ord, last, n, gid."""
        return clusters(self.spark, self.scratch, templates(self.normalized), self.config.threshold)

    @cached_property
    def assigned(self) -> DataFrame:
        """Normalized lines with their group."""
        n, size = self.clusters.agg(F.count("*"), F.sum(F.octet_length("normalized"))).first()
        templates = self.scratch.write(g.sized(self.clusters), "sized")
        return g.assigned(self.normalized, templates, n <= BROADCAST_TEMPLATES and (size or 0) <= BROADCAST_BYTES)

    @cached_property
    def groups(self) -> DataFrame:
        """gid, count, first, last, members (of groups too small to be collapsed)."""
        return self.scratch.write(g.groups(self.assigned, self.config.min_collapse), "groups")

    @cached_property
    def rollup(self) -> DataFrame:
        """gid, type, distinct_count, samples, capped of collapsed groups."""
        rolled = g.rollup(self.assigned, self.config.min_collapse)
        if self.config.sanitize and not self.config.raw_json:
            rolled = rolled.withColumn("samples", F.when(F.col("type") == "EMAIL", F.array_distinct(F.transform("samples", lambda x: F.lit("<EMAIL>")))).otherwise(F.col("samples")))
        return self.scratch.write(rolled, "rollup")

    @cached_property
    def described(self) -> DataFrame:
        """Groups with their variation entries (empty where none)."""
        out = self.groups.join(g.variation(self.rollup), "gid", "left")
        return out.withColumn("variation", F.coalesce("variation", F.array().cast(dict(out.dtypes)["variation"])))

    @cached_property
    def stats(self) -> dict:
        return g.stats(self.normalized, self.groups, self.config).first().asDict()

    def text(self) -> DataFrame:
        """gid, count, text: groups in the order of their first lines, as written out."""
        return render.texts(self.described, self.config).orderBy("gid")

    def records(self) -> DataFrame:
        """id, record: one JSON object a group, in the order of first lines."""
        rows = numbered(self.scratch, self.described, "gid", name="id")
        return render.records(rows, self.config).orderBy("id")

    def top(self, n: int) -> DataFrame:
        """count, text of the n largest groups; only those are described."""
        best = views.top_n(self.groups, n)
        gids = best.select("gid")
        out = best.join(g.variation(self.rollup.join(F.broadcast(gids) if n <= BROADCAST_TEMPLATES else gids, "gid", "left_semi")), "gid", "left")
        out = out.withColumn("variation", F.coalesce("variation", F.array().cast(dict(out.dtypes)["variation"])))
        return render.texts(out, self.config).orderBy(F.desc("count"), "normalized").select("count", "text")

    def summary(self, top: int | None = None, budget: int | None = None) -> tuple[DataFrame, str, int]:
        """(count and line of the patterns shown, the coverage message, patterns that did not fit)."""
        every = views.summary(self.groups if not self.config.sanitize else self._masked_groups())
        patterns = every.count()
        n, capped, hidden = views.shown(patterns, top, budget)
        rows = every.limit(n)
        lines = rows.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        return rows, views.coverage_message(n, patterns, lines, self.stats["input_lines"], capped), hidden

    def _masked_groups(self) -> DataFrame:
        return self.groups.withColumn("first", F.col("first").withField("line", ln.masked_by(F.col("first.line"), F.col("first.tokens"))))

    def preflight(self) -> dict:
        return views.preflight(self.stats)


def analyze(spark: SparkSession, lines: DataFrame, config: FoldConfig = FoldConfig(threshold=85, min_collapse=4)) -> dict:
    """Counts, samples, estimates and recommendations for lines, without folding them for output."""
    fold = Fold(spark, lines, config)
    counts = views.analysis_counts(fold.normalized).first().asDict()
    samples: dict[str, list[str]] = {"paths": [], "numbers": [], "timestamps": [], "ips": []}
    for r in sorted(views.analysis_samples(fold.normalized).collect(), key=lambda r: r.place):
        samples[r.kind].append(r.value)
    total = counts["total_lines"]

    def simulate(of: Fold, threshold: int, least: int) -> str:
        found = clusters(spark, of.scratch, templates(of.normalized), threshold)
        return views.estimate(total, views.simulated_lines(found, least))

    default, bold = simulate(fold, 85, 4), simulate(fold, 70, 3)
    paths = default if config.on("path") else simulate(Fold(spark, lines, FoldConfig(threshold=85)), 85, 4)
    estimates = {"default": default, "with_paths": paths, "with_numbers": bold, "aggressive": bold}
    return {"total_lines": total, "estimated_compression": estimates, "pattern_distribution": {k: counts[k] for k in views.ANALYSIS_COUNTS}, "recommendations": views.recommendations(counts), "sample_patterns": samples}
