"""Operators on conversations, pages and vectors, and the pipeline."""

import base64
import collections
import hashlib
import io
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineweave.llm import projection, queries, quotes, warc
from lineweave.plans.scratch import Scratch

SF = "/root/testdata/sf0.001"

MESSAGES = "conv_id int, turn int, role string, text string, own string, level int, hash string"


def linked(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], MESSAGES)
    return sorted(quotes.linked(spark, frame).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn is None, r.turn or 0, r.text))


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "Hello there\nfriend\n\nsecond para"),
        (1, 1, "bot", "> hello   there\n> FRIEND\nI agree"),
        (1, 2, "user", "bob wrote:\n>> Hello there\n>> friend\n> I agree\n\nfine"),
        (1, 5, "user", None),
        (1, 9, "bot", "> second para\n> second para\n> unknown"),
        (2, 0, "user", "> second para\nno"),
        (None, 1, "user", "> x"),
        (3, None, "user", "y"),
    ]
    got = linked(spark, rows)
    assert [(r.conv_id, r.turn, r.position, r.reply_to, r.n_quotes, r.n_linked, r.text) for r in got] == [
        (1, 0, 0, None, 0, 0, "Hello there\nfriend\n\nsecond para"),
        (1, 1, 1, 0, 1, 1, "I agree"),
        (1, 2, 2, 1, 2, 2, "fine"),
        (1, 5, 3, 2, 0, 0, ""),
        (1, 9, 4, 5, 1, 0, ""),
        (2, 0, 0, None, 1, 0, "no"),
        (3, None, None, None, 0, 0, "y"),
        (None, 1, None, None, 0, 0, ""),
    ]


def test_quotes_in_upper_case_link(spark, tmp_path):
    """Letters whose upper case is several letters, or whose lower case depends on those around them."""
    texts = ["Straße und Maß, heiß.", "ΟΔΟΣ ΜΑΣ εδώ.", "İyi günler ŉ ᾀ ﬁ ΐ", "Gruß an alle dort.", "so weit.", "ﬂoß ß"]
    rows = [(1, turn, "user", text) for turn, text in enumerate(texts * 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in quotes.linked(spark, quotes.replies(table)).orderBy("turn").collect()]
    con = duckdb.connect()
    table.write.parquet(f"{tmp_path}/t")
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    assert got == con.sql(f"SELECT * FROM ({quotes.oracle(quotes.REPLIES)}) ORDER BY turn").fetchall()
    assert spark.range(1).select(quotes._upper(F.lit("aßb ŉ ﬁx")), quotes._upper(F.lit("")), quotes._upper(F.lit(None).cast("string"))).first()[:3] == ("AẞB ŉ ﬁX", "", None)


def test_quotes_odd_rows(spark):
    assert linked(spark, []) == []
    got = linked(spark, [(1, 0, "a", "x y"), (1, 0, "a", "x y"), (1, 3000, "b", "> x y\n> > deep"), (1, 3000, "b", "> x y\n> > deep"), (1, 5, "c", ">" * 5000 + " z\n" + "w " * 5000)])
    assert [(r.turn, r.position, r.reply_to, r.n_quotes, r.n_linked) for r in got] == [(0, 0, None, 0, 0)] * 2 + [(5, 1, 0, 1, 0)] + [(3000, 2, 0, 2, 1)] * 2
    plan = quotes.linked(spark, spark.createDataFrame([(1, 0, "a", "b", "c", 1, "d")], MESSAGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [(3, "http://a", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "v\r\nX: y", ""), (None, "w", "<p>é</p>"), (None, "w", "only"), (7, "z", "q" * 600_000), (8, "z", "WARC/1.1\r\n\r\n"), (9, "z", "same"), (9, "z", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    frame = spark.createDataFrame([(*p, 1, "k") for p in PAGES], "page_id long, url string, html string, first long, key string")
    s = Scratch(spark, "t")
    folder = f"file://{s.path.removeprefix('file://')}/bundles"
    index = warc.write_bundles(spark, frame.repartition(3), folder, s, least)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(index, folder).collect())
    want = collections.Counter()
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = min((j for j, _, x in PAGES if j is not None and (x or "") == (h or "")), default=None) if len(body) >= least else None
        copies = sum((x or "") == (h or "") for _, _, x in PAGES)
        other = first if first != i and first is not None and copies > 1 else None
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other is not None else "response", other] += 1
    assert got == want


def test_warc_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_seek_table_finds_frames():
    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    writer = warc.BundleWriter(out, frame_bytes=1000)
    records = [warc.record(i, f"u{i}", os.urandom(300).hex().encode(), None) for i in range(20)]
    places = [writer.add(r) for r in records]
    writer.close()
    import zstandard

    table = warc.seek_table(out)
    assert len(table) > 5
    for record, (frame, offset) in zip(records, places):
        at, packed, raw = table[frame]
        data = zstandard.ZstdDecompressor().decompress(out.getvalue()[at : at + packed])
        assert len(data) == raw and data[offset : offset + len(record)] == record
    # Plain readers see one stream of records: the seek table is a frame that they skip.
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True)
    assert reader.read() == b"".join(records)


def brute_vectors(rows, least=0.98):
    unit = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            unit[i] = (label, x / np.linalg.norm(x))
    links = {i: [j for j in unit if j != i and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= least] for i in unit}
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), min(seen) if i is not None else None)
    return out


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK", 20)
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((60, 32))
        for x in base:
            rows.append(x)
            for _ in range(rng.integers(0, 3)):
                rows.append(x + rng.standard_normal(32) * rng.uniform(0, 0.3))
        rows += [base[0] + rng.standard_normal(32) * 0.08 for _ in range(90)]  # a cluster larger than a window
        rows += [base[1] * 3, base[1] * 1e-30]
    data = [(i * 2 + 5, [float(np.float32(v)) for v in x], i * 2 // len(rows)) for i, x in enumerate(rows)]
    data += [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 32, 0), (9003, [float("nan")] * 32, 0), (9004, [1.0, None] * 16, 0), (9005, [float("inf")] + [1.0] * 31, 0), (9006, data[0][1], None), (9007, [1.0, 2.0], 0), (9008, [1.0, 2.0], 0)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in data], "vec_id long, embedding array<float>, label int, id long, code string")
    got = projection.near_vectors(spark, frame).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in data])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(data)


@pytest.mark.parametrize("whole", [projection.WHOLE, 0])
def test_near_vectors_of_a_dense_topic(spark, monkeypatch, whole):
    # A label with a cloud whose vectors are at cosine 0.965 to each other, far denser than a window, among others.
    monkeypatch.setattr(projection, "WHOLE", whole)
    monkeypatch.setattr(projection, "BLOCK", 100)
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    topic = unit(unit(rng.standard_normal((1, 64))) * np.sqrt(0.965) + unit(rng.standard_normal((1500, 64))) * np.sqrt(0.035))
    x = np.float32(np.r_[topic, unit(rng.standard_normal((6000, 64)))])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection.near_vectors(spark, frame).collect()}
    y = unit(x.astype(np.float64))
    links = {i: np.flatnonzero(y[:1500] @ y[i] >= 0.98) for i in range(1500)}
    root = {}
    for i in range(len(x)):
        todo = [] if i in root else [i]
        while todo:
            if (j := todo.pop()) not in root:
                root[j] = i
                todo += links[j].tolist() if j in links else []
    assert got == {i: (max(0, len(links.get(i, [])) - 1), root[i]) for i in range(len(x))}
    assert sum(n > 0 for n, _ in got.values()) > 50


def test_near_vectors_loses_no_link_of_a_large_label(spark, monkeypatch):
    # One pass with a window of one neighbour finds few of the links; what is returned does not depend on it, nor on
    # whether the label is larger than WHOLE, nor on how much room a block has.
    monkeypatch.setattr(projection, "BLOCK", 64)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((1200, 64)))
    near = unit(base[:200] + 0.19 * unit(rng.standard_normal((200, 64))))
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(np.r_[base, near])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    wanted = brute_vectors(rows)
    assert sum(n > 0 for n, _ in wanted.values()) == 400
    for whole, room in ((16 * 64, 1 << 22), (0, 1 << 22), (0, 1)):
        monkeypatch.setattr(projection, "WHOLE", whole)
        monkeypatch.setattr(projection, "ROOM", room, raising=False)
        got = projection.near_vectors(spark, frame, passes=1, window=1).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == wanted


def test_near_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert projection.near_vectors(spark, spark.createDataFrame([], schema)).collect() == []
    got = projection.near_vectors(spark, spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
def test_pipeline_equals_its_operators(spark):
    """The stages one by one, each against what its operator says of the rows before it."""
    from lineweave.llm import containment, mixing, setsketch, substrings, toxicity

    load = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = load("documents")
    columns = docs.columns
    model = toxicity.fit(spark, docs, load("labels"))
    keep = {r.doc_id for r in toxicity.scored(spark, docs, model).collect() if not r.predicted}
    step = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r.doc_id for r in step.collect()} == keep and step.columns == columns
    step = Scratch(spark, "t").write(step)
    after = corpus_pipeline.drop_near_duplicates(spark, step, SF)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in setsketch.near_duplicates(spark, step, 5).collect() if r.kept} and after.columns == columns
    step = Scratch(spark, "t").write(after)
    after = corpus_pipeline.cut_repeats(spark, step, SF)
    cut = {r.doc_id: r.kept for r in substrings.remove_repeats(spark, step).collect()}
    before = {r.doc_id: r.text for r in step.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == {i: t if cut[i] is None else cut[i] for i, t in before.items()} and after.columns == columns
    step = Scratch(spark, "t").write(after)
    after = corpus_pipeline.drop_leaks(spark, step, SF)
    leaks = {r.doc_id for r in containment.contained(spark, step, load("benchmark")).collect()}
    assert {r.doc_id for r in after.collect()} == set(before) - leaks and after.columns == columns
    step = Scratch(spark, "t").write(after)
    mix = {r.doc_id: r.taken for r in mixing.mix(spark, step).collect() if r.taken}
    assert {r.doc_id: r.taken for r in corpus_pipeline.mix_sources(spark, step, SF).collect()} == mix
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()} == mix
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
