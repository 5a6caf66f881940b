"""Folds end to end, first-fit clustering against its definition, and invariants of rollups."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.config import FoldConfig, parse_detectors, parse_format, parse_size
from lineweave.functions.normalize import normalizer, spread
from lineweave.operators import clustering, views
from lineweave.operators.similarity import Leaders, bucketed, first_fit, score, similar_pairs
from lineweave.plans import render
from lineweave.plans.fold import Fold, analyze
from lineweave.plans.scratch import Scratch, numbered
from lineweave.sources import lines as src


def fold(spark, rows, **config):
    return Fold(spark, src.from_strings(spark, rows), FoldConfig(**config))


def text(f):
    return [r.text for r in f.text().collect()]


REFUSED = [f"ERROR connection refused to 10.0.0.{i}:8080" for i in range(1, 5)]


def test_folded_text_and_stats(spark):
    f = fold(spark, [*REFUSED, "INFO startup complete"])
    assert text(f) == ["ERROR connection refused to 10.0.0.1:8080\n[+2 similar | ipv4×4, port×1]\nERROR connection refused to 10.0.0.4:8080", "INFO startup complete"]
    assert (f.stats["output_lines"], f.stats["lines_saved"], f.stats["ips"], f.stats["categories"]) == (4, 1, 8, 1)


def test_top(spark):
    rows = [f"ERROR connection refused to 10.0.0.{i}:8080" for i in range(10)] + ["WARN timeout after 30s"] * 5 + ["INFO done"] * 2
    found = [(r["count"], r["text"]) for r in fold(spark, rows).top(2).collect()]
    assert found == [(10, "ERROR connection refused to 10.0.0.0:8080\n[+8 similar | ipv4×10, port×1]\nERROR connection refused to 10.0.0.9:8080"), (5, "WARN timeout after 30s\n[+3 similar | duration×1]\nWARN timeout after 30s")]
    assert fold(spark, rows).top(0).collect() == []


def test_equal_lines_and_no_folding(spark):
    f = fold(spark, ["a plain line"] * 3 + ["other"])
    assert text(f) == ["a plain line\n[+1 similar]\na plain line", "other"]
    assert (f.stats["output_lines"], f.stats["lines_saved"], f.stats["collapsed_groups"]) == (4, 0, 1)
    rows = ["ERROR database connection failed", "WARN disk space low on /dev/sda1", "INFO deployment v2.3.1 started"]
    assert text(fold(spark, rows)) == rows


def test_groups_of_two_with_least_collapse(spark):
    f = fold(spark, REFUSED[:2], min_collapse=2)
    assert text(f)[0].split("\n")[1] == "[+0 similar | ipv4×2 {10.0.0.1, 10.0.0.2}, port×1]"
    assert f.stats["lines_saved"] == 0


def test_records(spark):
    f = fold(spark, ["2024-01-01 10:00:00 user a@b.org", "2024-01-01 10:00:01 user c@d.org", "2024-01-01 10:00:02 user a@b.org", "", "other one"], output_format="jsonl")
    records = [json.loads(r.record) for r in f.records().collect()]
    first = records[0]
    assert [r["id"] for r in records] == [0, 1, 2]
    assert first["type"] == "group" and first["count"] == 3 and first["token_types"] == ["EMAIL", "TIMESTAMP"]
    assert first["time_range"] == {"first_seen": "2024-01-01 10:00:00", "last_seen": "2024-01-01 10:00:02"}
    assert first["variation"]["EMAIL"] == {"distinct_count": 2, "samples": ["a@b.org", "c@d.org"], "capped": False}
    assert first["variation"]["TIMESTAMP"] == {"distinct_count": 3, "samples": [], "capped": False}
    assert records[1]["time_range"] == {"first_seen": None, "last_seen": None} and records[1]["variation"] == {}
    done = json.loads(render.summary_record(f.stats))
    assert done["type"] == "summary" and done["input_lines"] == 5 and done["lines_saved"] == 2 and done["pattern_hits"]["emails"] == 3


def test_sanitize_everywhere(spark):
    rows = ["mail from a@b.org ok"] * 2 + ["mail from c@d.org ok"] * 2
    assert "@" not in "".join(text(fold(spark, rows, sanitize=True)))
    assert "@" not in "".join(r.record for r in fold(spark, rows, sanitize=True).records().collect())
    assert "@" in "".join(r.record for r in fold(spark, rows, sanitize=True, raw_json=True).records().collect())
    assert "@" not in "".join(r.line for r in fold(spark, rows, sanitize=True).summary()[0].collect())


def test_essence_and_limits(spark):
    f = fold(spark, ["10:00:00 T a", "10:00:01 T a", "x" * 50, "\x1b[31mlate\x1b[0m"], essence=True, max_line_length=40, max_lines=3)
    assert text(f) == ["<TIMESTAMP> T a"]
    assert f.stats["input_lines"] == 2 and f.stats["lines_saved"] == 1
    assert text(fold(spark, ["\x1b[31mred\x1b[0m"])) == ["red"]
    assert fold(spark, ["all good", "it failed"], fail_pattern="fail").matched and not fold(spark, ["ok"], fail_pattern="fail").matched


def test_plain_marker_names_what_varies(spark):
    tokens = "array<struct<type:string,value:string>>"
    row = spark.createDataFrame([([("PORT", "1"), ("TIMESTAMP", "a")], [("PORT", "2"), ("TIMESTAMP", "a"), ("LOG_WITH_MODULE", "x:y")])], f"a {tokens}, b {tokens}")
    from pyspark.sql import functions as F

    assert row.select(render.varying(F.col("a"), F.col("b"))).first()[0] == ["log_with_module", "port"]
    assert row.select(render.plain_marker(F.lit(4), F.col("a"), F.col("b"), FoldConfig(compact=False))).first()[0] == "[...collapsed 4 similar lines from a to a...]"


def test_rollup_cap_and_samples(spark):
    rows = [f"open /data/d{i:03d}/f failed" for i in range(70)]
    entry = {r.type: r for r in fold(spark, rows).rollup.collect()}["PATH"]
    assert entry.distinct_count == 64 and entry.capped and len(entry.samples) == 7 and entry.samples == sorted(entry.samples)
    assert set(entry.samples) <= {f"/data/d{i:03d}/f" for i in range(64)}
    rows = [f"open /data/d{i % 64:03d}/f failed" for i in range(64)]
    assert not {r.type: r for r in fold(spark, rows).rollup.collect()}["PATH"].capped
    assert {r.type: r for r in fold(spark, [*rows, rows[0]]).rollup.collect()}["PATH"].capped


def test_long_samples_are_cut(spark):
    path = "/var/" + "x" * 60
    marker = text(fold(spark, [f"open {path} failed"] * 3))[0].split("\n")[1]
    assert marker == f"[+1 similar | path×1 {{{path[:49]}…}}]"


def test_order_does_not_depend_on_partitions(spark):
    rows = [f"job {i % 7} took {i}ms on node-{i % 3}" for i in range(200)]
    lines = src.from_strings(spark, rows)
    a, b = (Fold(spark, lines.repartition(n), FoldConfig()).groups.select("gid", "count", "first.line").collect() for n in (1, 7))
    assert sorted(a) == sorted(b)


def test_empty_input(spark):
    f = fold(spark, [""])
    assert f.stats["output_lines"] == 0
    none = Fold(spark, spark.createDataFrame([], "line_no long, line string"))
    assert none.groups.collect() == [] and none.stats["input_lines"] == 0 and none.stats["compression_ratio"] == 0.0 and none.records().collect() == []


def test_summary_and_views(spark):
    f = fold(spark, [f"kind {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (3 + i % 40)} end" for i in range(80)])
    rows, message, hidden = f.summary()
    assert views.shown(31) == (30, True, 0) and views.shown(31, 0) == (31, False, 0) and views.shown(31, 0, 5) == (4, False, 27) and views.shown(31, 9, 5) == (9, False, 0) and views.shown(3, None, 5) == (3, False, 0)
    assert rows.count() <= 30 and "coverage" in message and hidden == 0
    assert views.coverage_message(2, 9, 5, 10, False) == "(2 of 9 patterns, 5 of 10 lines, 50% coverage)"


def test_reports(spark, monkeypatch):
    monkeypatch.setenv("SOURCE_DATE_EPOCH", "0")
    f = fold(spark, REFUSED)
    assert "1970-01-01T00:00:00Z" in render.stats_report(f.stats) and "| Network | 8 |" in render.stats_report(f.stats)
    assert "- **Compression ratio**: 25.0%" in render.markdown_head(f.stats)
    assert f.preflight()["recommendations"][1] == "3 of 4 lines remain."


def access_log():
    """Fifty requests of three kinds, in the order of time."""
    agents = ["Mozilla/5.0 (X11; Linux x86_64)", "curl/8.4.0", "Mozilla/5.0 (X11; Linux x86_64)"]
    paths = ["/api/v1/users/{}", "/static/js/app-{}.js", "/api/v1/orders/{}/items?page=2"]
    codes = [200, 200, 404, 200, 500]
    return [f'192.168.{i % 4}.{i + 10} - - [{10 + i // 30}/Oct/2024:13:{i % 60:02}:{i * 7 % 60:02} +0000] "GET {paths[i % 3].format(1000 + i)} HTTP/1.1" {codes[i % 5]} {500 + 37 * i} "-" "{agents[i % 3]}"' for i in range(50)]


def test_reduction_of_known_kinds_of_logs(spark):
    """The limits that folds of such logs keep: an access log, a generated cluster log, lines with addresses."""
    access = fold(spark, access_log()).stats
    assert access["output_lines"] <= 20 and access["markdown_ratio"] >= 75
    cluster = Fold(spark, src.cluster_log(spark, 1000)).stats
    assert 5 <= cluster["output_lines"] <= 30 and cluster["markdown_ratio"] >= 95
    mails = fold(spark, [f"2024-01-01 10:{i // 60 % 60:02}:{i % 60:02} mail from user{i}@host{i % 9}.org to box{i % 7}@example.com accepted" for i in range(2000)]).stats
    assert mails["output_lines"] < 100 and mails["emails"] == 4000


def test_one_group_with_most_lines(spark):
    """Nine of ten lines in one group: its counts are exact, and only its ends are moved."""
    lines = spark.range(20_000).selectExpr("id + 1 as line_no", "case when id % 10 = 0 then concat('rare ', md5(cast(id % 50 as string)), ' kind') else concat('worker took ', id + 1000, ' ms') end as line")
    f = Fold(spark, lines)
    big = f.groups.orderBy(F.desc("count")).first()
    assert big["count"] == 18_000 and (big["first"]["line_no"], big["last"]["line_no"]) == (2, 20_000) and big["members"] is None
    assert f.groups.agg(F.sum("count")).first()[0] == 20_000


def test_analyze(spark):
    found = analyze(spark, src.from_strings(spark, [f"2024-01-01 10:00:0{i} open /var/x/{i}" for i in range(8)]))
    assert found["total_lines"] == 8 and found["pattern_distribution"]["timestamps"] == 8
    assert found["estimated_compression"]["default"] == "87.5% (1 lines)"
    assert len(found["sample_patterns"]["timestamps"]) == 3 and len(found["sample_patterns"]["paths"]) == 5


def brute_first_fit(templates, threshold):
    leaders, out = [], []
    for t in templates:
        for k in leaders:
            if score(templates[k].encode(), t.encode()) >= threshold:
                out.append(k)
                break
        else:
            leaders.append(len(out))
            out.append(len(out))
    return out


@pytest.mark.parametrize("threshold, ranged, held", [(40, 1000, 1 << 20), (60, 30, 1 << 20), (75, 1000, 1), (85, 30, 1), (85, 20, 1 << 20), (100, 30, 1500)])
def test_clusters_are_first_fit(spark, monkeypatch, threshold, ranged, held):
    rng = random.Random(threshold)
    templates = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(120)))
    monkeypatch.setattr(clustering, "BLOCK", 13)
    monkeypatch.setattr(clustering, "RANGE", ranged)
    monkeypatch.setattr(clustering, "HELD_BYTES", held)
    found = spark.createDataFrame([(t, i, i, 1) for i, t in enumerate(templates)], "normalized string, ord long, last long, n long")
    got = {r.ord: r.gid for r in clustering.clusters(spark, Scratch(spark, "t"), found, threshold).collect()}
    assert [got[i] for i in range(len(templates))] == brute_first_fit(templates, threshold)


@given(st.text(max_size=30), st.text(max_size=30))
def test_similarity_is_symmetric_and_complete(a, b):
    x, y = a.encode(), b.encode()
    assert score(x, y) == score(y, x) and score(x, x) == 100 and 0 <= score(x, y) <= 100
    assert (Leaders([0], [x], 75).first(__import__("numpy").array([1]), [y])[0] == 0) == (score(x, y) >= 75)


def test_clusters_of_nothing(spark):
    found = spark.createDataFrame([], "normalized string, ord long, last long, n long")
    assert clustering.clusters(spark, Scratch(spark, "t"), found, 75).collect() == []


@pytest.mark.parametrize("threshold", [0, 50, 70, 75, 90, 100])
def test_similar_pairs_of_long_templates(threshold):
    """Many words, lengths on both sides of a word's end, bytes of zero, and the ends of longer templates."""
    rng = random.Random(threshold)
    base = [bytes(rng.choice(b"abcdefgh\0") for _ in range(n)) for n in (0, 7, 8, 9, 64, 150, 300)]
    every = []
    for _ in range(250):
        t = bytearray(rng.choice(base))
        for _ in range(rng.randint(0, len(t) // 3)):
            t[rng.randrange(len(t))] = rng.choice(b"ab\0")
        every.append(bytes(t[: rng.randint(len(t) * 3 // 4, len(t))]) + b"a" * rng.choice([0, 0, 1, 9]))
    buckets = bucketed(every)
    found = [(int(i), int(j)) for a, b in similar_pairs(buckets, buckets, threshold) for i, j in zip(a, b)]
    assert sorted(found) == [(i, j) for i in range(250) for j in range(250) if score(every[i], every[j]) >= threshold]


@settings(max_examples=50)
@given(st.lists(st.text("abc", min_size=0, max_size=8), max_size=12, unique=True), st.integers(0, 100))
def test_first_fit_leaders(templates, threshold):
    found = first_fit(list(range(len(templates))), [t.encode() for t in templates], threshold)
    assert list(found.ords) == sorted(set(brute_first_fit(templates, threshold)))


@settings(max_examples=200)
@given(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=200))
def test_normalize_any_line(line):
    template, notes = normalizer()(line)
    assert isinstance(template, str) and all(isinstance(v, str) for _, v in notes)


def test_lines_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A scan of one large row group has partitions enough, but all lines are in one of them."""
    spark.range(200_000).selectExpr("id AS line_no", "md5(cast(id AS string)) AS line").coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() > 4
        sizes = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= 4 and max(sizes) < 60_000


def test_numbered(spark):
    rows = numbered(Scratch(spark, "t"), spark.range(0, 1000, 1, 7).selectExpr("id * 7919 % 1000 AS v"), "v").collect()
    assert sorted((r.v, r.n) for r in rows) == [(i, i) for i in range(1000)]


def test_settings():
    assert parse_size("1M") == 1 << 20 and parse_size(" 5k ") == 5120 and parse_size("7") == 7
    assert parse_format("MD") == "markdown" and parse_format("jsonl") == "json" and parse_detectors("ip, hash") == {"ip", "hash"}
    for bad in (lambda: parse_size("x"), lambda: parse_format("xml"), lambda: parse_detectors("nope"), lambda: FoldConfig(threshold=101), lambda: FoldConfig(min_collapse=1), lambda: FoldConfig(max_lines=0)):
        with pytest.raises(ValueError):
            bad()
