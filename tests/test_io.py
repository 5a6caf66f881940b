"""Sources, native expressions against the Python detectors, streams, and the command line."""

import io
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineweave import cli, queries
from lineweave.config import FoldConfig
from lineweave.functions import detectors as d
from lineweave.functions import native
from lineweave.operators import lines as ln
from lineweave.operators.similarity import score
from lineweave.sources import lines as src
from lineweave.streaming import fold as streaming

SF = "/root/testdata/sf0.001"


def test_read_files(spark, tmp_path, capsys):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes(b"one\r\ntwo\n\nfour")
    b.write_bytes(b"five\n")
    got = src.read_lines(spark, [str(b), str(tmp_path / "none"), "-", str(a)], stdin=["in 1\n", "in 2"]).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == list(enumerate(["five", "in 1", "in 2", "one", "two", "", "four"], 1))
    assert "cannot be read" in capsys.readouterr().err
    with pytest.raises(src.NoInputError):
        src.read_lines(spark, [str(tmp_path / "none")])


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("\n".join(f"line {i} " + "x" * (i % 50) for i in range(5000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = src.read_lines(spark, [str(path)])
        assert rows.filter(~F.col("line").startswith(F.concat(F.lit("line "), (F.col("line_no") - 1).cast("string"), F.lit(" ")))).count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("expression", "detector"),
    [(native.hashes, d.hashes), (native.emails, d.email), (native.identifiers, d.uuid), (native.processes, d.process), (native.measures, d.duration)],
)
def test_native_equals_python(spark, expression, detector):
    texts = ["sha 0123abcd", "a@b.org a.@b.org x_y@c.d.io", "request id 7 trace=a1b2 0123456789abcdef0123456789abcdef", "[1] pid=2 (3) Thread-4 id=5", "took 5ms, 3 KB, 0xff, status 404, 7%, 1.5 and 1234", "plain", "", "session:x correlation_id=9", 'duration "1h2m3s" latencyDuration=0.12']
    rows = spark.createDataFrame([(t,) for t in texts], "line string").select("line", expression(F.col("line")).alias("out")).collect()
    assert [r.out for r in rows] == [detector.run(r.line)[0] for r in rows]


def test_native_values(spark):
    values = ["5%", "7ms", "7s", "3GB", "x bytes", "9rps", "1/s", "ON", "1.5", "10.0.0.1", "10.0.0.300", "fe80::1", "https://a", "news", "", "1.2.3"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", native.value_type(F.col("v")).alias("t"), native.ipv6_plausible(F.col("v")).alias("p")).collect()
    assert [(r.v, r.t) for r in rows] == [(v, d.value_type(v)) for v in values]
    assert [r.p for r in rows] == [d.ipv6_like(v) for v in values]


@pytest.mark.parametrize(("address", "masked"), [("user@example.com", "u***@e***.com"), ("u@localhost", "u***@l***"), ("@x.org", "@x.org"), ("a@", "a@"), ("a@b@c", "a@b@c"), ("none", "none"), ("a@b.", "a@b."), ("a@mail.x.org", "a***@m***.org")])
def test_half_masked(spark, address, masked):
    assert spark.createDataFrame([(address,)], "a string").select(ln.half_masked(F.col("a"))).first()[0] == masked


def test_open_groups_evict(monkeypatch):
    monkeypatch.setattr(streaming, "MAX_OPEN", 3)
    groups = streaming.OpenGroups(FoldConfig())
    out = [groups.add(i, t, t) for i, t in enumerate(["aaaa"] * 3 + ["bbbbbbbbbbbb", "c" * 30, "d" * 90, "e" * 300], 1)]
    assert [o and o[1] for o in out] == [None] * 5 + ["aaaa", None]
    again = streaming.OpenGroups(FoldConfig(), groups.state())
    assert again.state() == groups.state() and again.add(8, "x", "b" * 12) is None and next(iter(again.rows.values()))[2] == 2
    # Small groups go once they are old.
    for i in range(9, 120):
        gone = again.add(i, "b" * 12, "b" * 12)
        if gone:
            break
    assert gone[1] == "b" * 12


def brute_open_groups(templates, config, most, distance):
    """Line by line: every open group in order, and the first that may go when too many are open."""
    rows, out = [], []
    for n, t in enumerate(templates, 1):
        row = next((r for r in rows if score(r[1].encode(), t.encode()) >= config.threshold), None)
        if row is None:
            rows.append(row := [n, t, 0, f"line {n}", None, n, n])
        row[2:3], row[4:6] = [row[2] + 1], [f"line {n}", n]
        if len(rows) > most and (gone := next((r for r in rows if r[2] >= config.min_collapse or n - r[6] > distance), None)):
            rows.remove(gone)
            out.append(gone)
    return out, rows


@pytest.mark.parametrize("threshold", [0, 50, 69, 75, 100])
def test_open_groups_by_steps(monkeypatch, threshold):
    monkeypatch.setattr(streaming, "FRESH", 7)
    monkeypatch.setattr(streaming, "STEP", 40)
    monkeypatch.setattr(streaming, "KNOWN", 50)
    rng, config = random.Random(threshold), FoldConfig(threshold=threshold)
    for most in (3, 25):
        monkeypatch.setattr(streaming, "MAX_OPEN", most)
        templates = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(900)]
        groups = streaming.OpenGroups(config)
        out = list(groups.add_all(list(range(1, 901)), templates, lambda n: f"line {n + 1}"))
        assert (out, list(groups.rows.values())) == brute_open_groups(templates, config, most, streaming.SAFE_DISTANCE)


def test_open_groups_look_up_known_templates(monkeypatch):
    """A log of few templates is compared by them, not by its lines."""
    calls, pairs = [], streaming.similar_pairs
    monkeypatch.setattr(streaming, "similar_pairs", lambda a, b, threshold: calls.append(sum(len(x.sizes) for x in a)) or pairs(a, b, threshold))
    templates = [f"template {'xyz'[n % 3] * 20}" for n in range(20_000)]
    groups = streaming.OpenGroups(FoldConfig())
    assert not list(groups.add_all(list(range(20_000)), templates, str)) and len(groups.rows) == 3
    assert sum(calls) < 20


def test_spool_puts_lines_in_order(monkeypatch):
    monkeypatch.setattr(streaming, "SPOOL_BYTES", 2000)
    monkeypatch.setattr(streaming, "WINDOW", 70)
    numbers = random.Random(1).sample(range(10_000), 500)
    spool = streaming.Spool()
    for at in range(0, 500, 60):
        some = numbers[at : at + 60]
        spool.add(pd.DataFrame({"line_no": some, "line": [f"l{n} é" for n in some], "normalized": [f"t{n}" for n in some]}))
    got = [(n, t, line_at(k)) for found, texts, line_at in spool.windows() for k, (n, t) in enumerate(zip(found, texts))]
    assert got == [(n, f"t{n}", f"l{n} é") for n in sorted(numbers)] and os.path.exists(spool.path)
    spool.close()
    assert not os.path.exists(spool.path)


def test_stream_counts_equal_batch(spark, tmp_path):
    lines = src.cluster_log(spark, 300)
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.template_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    from lineweave.functions.normalize import normalized

    batch = normalized(lines).groupBy("normalized").count()
    assert sorted((r.normalized, r["count"]) for r in spark.table("counts").collect()) == sorted(map(tuple, batch.collect()))


def test_stream_folds_batches(spark, tmp_path):
    src.from_strings(spark, [f"job {i} done in {i}ms" for i in range(100, 120)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_no long, line string").parquet(str(tmp_path / "in"))
    seen = []
    streaming.fold_batches(stream, lambda df, n: seen.extend(r["count"] for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 20


def run(spark, tmp_path, rows, *argv):
    path = tmp_path / "in.log"
    path.write_text("".join(f"{r}\n" for r in rows))
    out, err = io.StringIO(), io.StringIO()
    code = cli.run(spark, cli.parser().parse_args([*argv, str(path)]), out, err)
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    rows = [f"ERROR connection refused to 10.0.0.{i}:8080" for i in range(4)] + ["INFO ok"]
    assert run(spark, tmp_path, rows, "-q")[1] == "ERROR connection refused to 10.0.0.0:8080\n[+2 similar | ipv4×4, port×1]\nERROR connection refused to 10.0.0.3:8080\nINFO ok\n"
    code, out, err = run(spark, tmp_path, rows, "--summary", "--fail-on-pattern", "refused")
    assert code == 1 and out == "[4x] ERROR connection refused to 10.0.0.0:8080\n[1x] INFO ok\n" and "(2 of 2 patterns, 5 of 5 lines, 100% coverage)" in err
    assert run(spark, tmp_path, rows, "--top", "1")[1].startswith("[4x] ERROR")
    assert run(spark, tmp_path, rows, "--format", "json")[1].count("\n") == 3
    assert '"total_lines": 5' in run(spark, tmp_path, rows, "--preflight")[1]
    assert '"input_lines": 5' in run(spark, tmp_path, rows, "--stats-json")[2]
    assert "### Entry 1 (Folded)" in run(spark, tmp_path, rows, "--format", "markdown")[1]
    assert run(spark, tmp_path, rows, "--min-collapse", "1")[0] == 2 and run(spark, tmp_path, rows, "--fail-on-pattern", "(")[0] == 2
    assert cli.fit_budget(24) == 20 and cli.fit_budget(6) is None and all("top" in cli.completions(shell) for shell in cli.SHELLS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
def test_stream_emits_every_line(spark):
    """Every line of every language is in one group, also in a language that never has too many groups open."""
    got = queries.streaming_fold_documents(spark, SF).groupBy("log").agg(F.sum("count").alias("lines"), F.countDistinct("gid").alias("gids"), F.count("*").alias("groups")).collect()
    want = src.doc_lines(spark, SF).groupBy("lang").count().collect()
    assert {r.log: r.lines for r in got} == {r.lang: r["count"] for r in want}
    assert all(r.gids == r.groups for r in got)
