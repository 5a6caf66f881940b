"""The registered queries of the fold engine, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.config import FoldConfig
from lineweave.functions import detectors as d
from lineweave.functions import native
from lineweave.functions.normalize import normalized
from lineweave.operators import groups as g
from lineweave.operators import lines as ln
from lineweave.operators import views
from lineweave.operators.similarity import score_column
from lineweave.plans import render
from lineweave.plans.fold import Fold, analyze
from lineweave.plans.scratch import Scratch, numbered
from lineweave.sources import lines as src
from lineweave.sources import shapes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _fold(spark: SparkSession, sf_dir: str, config: FoldConfig = FoldConfig()) -> Fold:
    return Fold(spark, shapes.group_log(spark, sf_dir), config)


# --- SQL parts ------------------------------------------------------------------------------------

#: The event log with the template and the token values that its lines must have.
EV = """SELECT event_id + 1 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS val, event_type, props,
  '<TIMESTAMP> <BRACKET_CONTEXT> <KEY_VALUE> event=' || event_type || ' value=<DECIMAL> props=' || props AS normalized,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END || '] user_id=' || user_id || ' event=' || event_type || ' value=' || CAST(value AS DECIMAL(18, 2)) || ' props=' || props AS line FROM events"""


def _score(a: str, b: str) -> str:
    """Similarity of two ASCII strings."""
    longer, shorter = f"greatest(strlen({a}), strlen({b}))", f"least(strlen({a}), strlen({b}))"
    same = f"coalesce(list_sum(list_transform(range(1, {shorter} + 1), lambda i: CASE WHEN substr({a}, i::INT, 1) = substr({b}, i::INT, 1) THEN 1 ELSE 0 END)), 0)"
    return f"CASE WHEN {a} = {b} THEN 100.0::DOUBLE WHEN {shorter}::DOUBLE / {longer} < 0.7 THEN {shorter}::DOUBLE / {longer} * 100 ELSE {same}::DOUBLE / {longer} * 100 END"


def grouped(threshold: int = 75) -> str:
    """First fit over the templates of the group log, in the order of their first lines; then lines with their group, groups
    and what varies in them. Which earlier templates are similar is found first; the fit then goes by their numbers."""
    return f"""WITH RECURSIVE ev AS ({shapes.GROUP_LOG}),
tm AS (SELECT normalized, min(line_no) AS ord, count(*) AS n, row_number() OVER (ORDER BY min(line_no)) AS k FROM ev GROUP BY normalized),
sim AS (SELECT b.k, list(a.k) AS near FROM tm a JOIN tm b ON a.k < b.k AND {_score("a.normalized", "b.normalized")} >= {threshold} GROUP BY b.k),
fit(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT f.k + 1, CASE WHEN len(list_intersect(f.leaders, coalesce(s.near, []::BIGINT[]))) > 0 THEN f.leaders ELSE list_append(f.leaders, f.k + 1) END FROM fit f LEFT JOIN sim s ON s.k = f.k + 1 WHERE f.k < (SELECT max(k) FROM tm)),
led AS (SELECT leaders FROM fit ORDER BY k DESC LIMIT 1),
cl AS (SELECT tm.*, CASE WHEN list_contains(leaders, tm.k) THEN tm.k ELSE list_min(list_intersect(leaders, sim.near)) END AS lk FROM tm LEFT JOIN sim ON sim.k = tm.k, led),
gi AS (SELECT cl.normalized, lt.normalized AS leader, cl.n, lt.ord AS gid FROM cl JOIN tm lt ON lt.k = cl.lk),
al AS (SELECT ev.*, gi.gid, gi.leader FROM ev JOIN gi USING (normalized)),
gr AS (SELECT gid, any_value(leader) AS template, count(*) AS count, arg_min(line, line_no) AS first_line, arg_max(line, line_no) AS last_line, max(line_no) AS last_line_no,
  arg_min(stamp, line_no) AS first_seen, arg_max(stamp, line_no) AS last_seen FROM al GROUP BY gid),
tk AS (SELECT gid, line_no, pos, t.type AS type, t.value AS value FROM (SELECT gid, line_no, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS t FROM al)),
fi AS (SELECT gid, type, value, min(line_no * 100 + pos) AS pl FROM tk JOIN gr USING (gid) WHERE gr.count >= 3 GROUP BY gid, type, value),
rk AS (SELECT *, row_number() OVER (PARTITION BY gid, type ORDER BY pl) AS rank FROM fi),
la AS (SELECT gid, type, max(line_no * 100 + pos) AS last FROM tk GROUP BY gid, type),
ro AS (SELECT rk.gid, rk.type, count(*) AS distinct_count, count(*) >= 64 AND any_value(la.last) > max(rk.pl) AS capped,
  list_sort(list_slice(list_sort(list({{'key': md5(gr.template || rk.type || rk.value), 'value': rk.value}}) FILTER (WHERE rk.type IN ('BRACKET_CONTEXT', 'EMAIL', 'IPV4'))), 1, 7).list_transform(lambda x: x.value)) AS samples
  FROM rk JOIN la ON la.gid = rk.gid AND la.type = rk.type JOIN gr ON gr.gid = rk.gid WHERE rank <= 64 GROUP BY rk.gid, rk.type),
st AS (SELECT (SELECT count(*) FROM ev) AS input_lines, sum(CASE WHEN count >= 3 THEN 3 ELSE count END)::BIGINT AS output_lines, count(*) FILTER (WHERE count >= 3) AS collapsed_groups, coalesce(sum(count - 3) FILTER (WHERE count >= 3), 0)::BIGINT AS lines_saved,
  coalesce(sum(count - 1) FILTER (WHERE count >= 3), 0)::BIGINT AS json_saved, count(*) AS groups FROM gr)
"""


GROUPED = grouped()
#: Texts of groups: markers of what varies, members of small groups.
TEXTS = f"""{GROUPED}, vm AS (SELECT gid, string_agg(lower(type) || '×' || distinct_count || CASE WHEN capped THEN '+' ELSE '' END
  || CASE WHEN distinct_count <= 3 AND NOT capped AND samples IS NOT NULL THEN ' {{' || array_to_string(samples, ', ') || '}}' ELSE '' END, ', ' ORDER BY type) AS v FROM ro WHERE samples IS NOT NULL OR distinct_count <= 3 GROUP BY gid),
sm AS (SELECT gid, string_agg(line, chr(10) ORDER BY line_no) AS members FROM al GROUP BY gid),
tx AS (SELECT gr.gid, count, template, CASE WHEN count < 3 THEN members ELSE first_line || chr(10) || '[+' || (count - 2) || ' similar | ' || first_seen || ' → ' || last_seen || CASE WHEN v IS NULL THEN '' ELSE ' | ' || v END || ']' || chr(10) || last_line END AS text
FROM gr JOIN sm USING (gid) LEFT JOIN vm USING (gid))
"""


def _chained(column: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return column


# --- sources, filters, projections ----------------------------------------------------------------


@query(src.EVENT_LOG)
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, SRC6: text files written in order and read back with line numbers."""
    path = f"{Scratch(spark, 'text').path}/lines"
    src.event_log(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    return src.read_lines(spark, [path])


@query(f"SELECT row_number() OVER (ORDER BY event_id % 2 DESC, event_id) AS line_no, line FROM ({src.EVENT_LOG}) l JOIN events e ON e.event_id + 1 = l.line_no")
def many_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3 to SRC5: several inputs in the order of arguments, one that is not there, and lines that end in two characters."""
    path, log = Scratch(spark, "text").path, src.event_log(spark, sf_dir)
    for k in (0, 1):
        part = log.filter((F.col("line_no") - 1) % 2 == k).repartitionByRange("line_no").sortWithinPartitions("line_no").select("line")
        part.write.option("lineSep", "\r\n").text(f"{path}/{k}")
    return src.read_lines(spark, [f"{path}/1", f"{path}/none", f"{path}/0"])


@query(f"SELECT line_no, line FROM ({src.DOC_LINES}) WHERE line_no <= 500 * 1048576")
def line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1: the feature is the limit."""
    return ln.first_lines(src.doc_lines(spark, sf_dir), 500 << 20).select("line_no", "line")


@query(f"SELECT line_no, line FROM ({src.DOC_LINES}) WHERE octet_length(encode(line)) <= 200")
def line_length_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.short_lines(src.doc_lines(spark, sf_dir), 200).select("line_no", "line")


@query(f"SELECT max(regexp_matches(line, 'error.*value=1[0-9]')) AS matched FROM ({src.EVENT_LOG})")
def fail_on_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.any_match(src.event_log(spark, sf_dir), "error.*value=1[0-9]")


@query(rf"SELECT line_no, regexp_replace(line, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g') AS line FROM ({src.ANSI_LOG})")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ansi_log(spark, sf_dir).select("line_no", ln.plain(F.col("line")).alias("line"))


@query(f"SELECT line_no, {_chained('line', (ln.EMAIL, '<EMAIL>'))} AS masked FROM ({src.DOC_LINES})")
def email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.doc_lines(spark, sf_dir).select("line_no", ln.masked(F.col("line")).alias("masked"))


@query(
    f"""WITH e AS (SELECT line_no, unnest(range(1, len(found) + 1)) AS place, unnest(found) AS a FROM (SELECT line_no, regexp_extract_all(line, '{ln.EMAIL}') AS found FROM ({src.DOC_LINES})))
SELECT line_no, (place - 1)::INT AS place, a AS email, a[1] || '***@' || split_part(a, '@', 2)[1] || '***.' || regexp_extract(a, '[^.]*$') AS masked FROM e"""
)
def email_partial_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3, over all addresses of every line."""
    found = src.doc_lines(spark, sf_dir).select("line_no", F.posexplode(F.regexp_extract_all("line", F.lit(ln.EMAIL), 0)).alias("place", "email"))
    return found.withColumn("masked", ln.half_masked(F.col("email")))


# --- native detectors -----------------------------------------------------------------------------

_DETECT = {
    "normalize_hash": (src.doc_lines, src.DOC_LINES, native.hashes, tuple((rf"\b[a-fA-F0-9]{{{n}}}\b", "<HASH>") for n in d.HEX_LENGTHS), None),
    "normalize_email": (src.doc_lines, src.DOC_LINES, native.emails, ((r"\b[a-zA-Z0-9](?:[a-zA-Z0-9._+-]{0,62}[a-zA-Z0-9_+-])?@[a-zA-Z0-9][a-zA-Z0-9.-]{0,253}\.[a-zA-Z]{2,}\b", "<EMAIL>"),), None),
    "normalize_uuid": (partial(shapes.shaped_log, detector="uuid"), shapes.shaped_lines("uuid"), native.identifiers, ((d.UUID.pattern, "<UUID>"), (d.REQUEST_ID.pattern, "request_id=<UUID>"), (d.TRACE_ID.pattern, "trace=<UUID>"), (d.SESSION_ID.pattern, "session=<UUID>"), (d.CORRELATION_ID.pattern, "correlation_id=<UUID>"), (d.HEX_32.pattern, "<UUID>")), "line LIKE '%-%' OR line LIKE '%req%' OR line LIKE '%trace%' OR line LIKE '%session%' OR octet_length(encode(line)) > 20"),
    "normalize_process": (partial(shapes.shaped_log, detector="process"), shapes.shaped_lines("process"), native.processes, ((d.PID_BRACKET.pattern, "[pid=<PID>]"), (d.PID_EQUALS.pattern, "pid=<PID>"), (d.THREAD.pattern, "Thread-<TID>"), (d.TID.pattern, "tid=<TID>"), (d.THREAD_NAME.pattern, "[thread:<TID>]"), (d.ID_EQUALS.pattern, "id=<PID>"), (d.PID_PAREN.pattern, "(<PID>)")), None),
    "normalize_duration": (src.order_log, src.ORDER_LOG, native.measures, ((d.DURATION_FIELD.pattern, "<DURATION_FIELD>"), (d.DURATION.pattern, "<DURATION>"), (d.ADDRESS.pattern, "<ADDR>"), (d.SIZE.pattern, "<SIZE>"), (r"(?i)((?:status|error|code|returned?)\s+)[1-5][0-9][0-9]\b", r"\1<HTTP_STATUS>"), (d.PERCENT.pattern, "<PCT>"), (d.DECIMAL.pattern, "<DECIMAL>"), (d.INTEGER.pattern, "<NUMBER>")), "regexp_matches(line, '[.%smh]|KB|MB')"),
    "normalize_ipv4": (src.url_log, src.URL_LOG, native.addresses, ((d.IPV4_PORT.pattern, "<IP>:<PORT>"), (d.IPV4.pattern, "<IP>")), None),
    "http_status_class": (src.url_log, src.URL_LOG, native.access_status, tuple((rf'("(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+[^"]*"\s+){c}\d{{2}}(\s+\d+)', rf"\1<HTTP_STATUS_{c}XX>\2") for c in "12345"), None),
}


def _detecting(view: Callable[[SparkSession, str], DataFrame], put: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: view(spark, sf_dir).select("line_no", put(F.col("line")).alias("normalized"))


for _name, (_view, _sql, _put, _steps, _gate) in _DETECT.items():
    QUERIES[_name] = _detecting(_view, _put)
    _text = _chained("line", *_steps)
    ORACLES[_name] = f"SELECT line_no, {f'CASE WHEN {_gate} THEN {_text} ELSE line END' if _gate else _text} AS normalized FROM ({_sql})"

_VALUES = """SELECT DISTINCT value FROM (SELECT CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || u AS value FROM events, (SELECT unnest(['', '%', 'ms', 's', 'MB', ' bytes', 'rps', '/s']) AS u)
  UNION ALL SELECT event_type FROM events UNION ALL SELECT url FROM pages UNION ALL SELECT '10.0.' || page_id % 300 || '.7' FROM pages)"""


@query(
    f"""SELECT value, CASE WHEN value LIKE '%\\%' ESCAPE '\\' THEN 'percentage' WHEN regexp_matches(value, '(ms|us|ns|[0-9]s)$') THEN 'duration' WHEN regexp_matches(value, '(MB|GB|KB|bytes|byte)$') THEN 'size'
  WHEN regexp_matches(value, '(rps|qps|/s|/min|/hr)$') THEN 'rate' WHEN lower(value) IN ('true', 'false', 'enabled', 'disabled', 'on', 'off') THEN 'boolean' WHEN regexp_full_match(value, '[0-9.]*') THEN 'number' WHEN regexp_full_match(value, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AND list_max(list_transform(string_split(value, '.'), lambda x: x::INT)) <= 255 THEN 'ip'
  WHEN regexp_matches(value, '^(http|https|ftp)://') THEN 'url' ELSE 'string' END AS value_type FROM ({_VALUES})"""
)
def value_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12a, over numbers with units, words, URLs and addresses made of the tables."""
    events, pages = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    units = F.explode(F.array(*map(F.lit, ("", "%", "ms", "s", "MB", " bytes", "rps", "/s"))))
    numbers = events.select(F.col("value").cast("decimal(18,2)").cast("string").alias("v"), units.alias("u")).select(F.concat("v", "u").alias("value"))
    values = numbers.union(events.select("event_type")).union(pages.select("url")).union(pages.select(F.concat(F.lit("10.0."), (F.col("page_id") % 300).cast("string"), F.lit(".7")))).distinct()
    return values.withColumn("value_type", native.value_type(F.col("value")))


_HEXES = "SELECT DISTINCT text FROM (SELECT unnest([substr(h, 1, 4) || ':' || substr(h, 5, 3), '::' || substr(h, 8, 2), substr(h, 1, 6), h || ':' || h || ':' || h || ':' || h, '::', 'g:' || h, ':']) AS text FROM (SELECT md5(event_id::VARCHAR) AS h FROM events))"


@query(f"SELECT text, length(text) BETWEEN 2 AND 100 AND regexp_full_match(text, '[0-9a-fA-F:.]*') AND contains(text, ':') AND (text = '::' OR regexp_matches(text, '[0-9a-fA-F]')) AS ok FROM ({_HEXES})")
def ipv6_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    colon = F.lit(":")
    forms = F.array(F.concat(F.substring(h, 1, 4), colon, F.substring(h, 5, 3)), F.concat(F.lit("::"), F.substring(h, 8, 2)), F.substring(h, 1, 6), F.concat(h, colon, h, colon, h, colon, h), F.lit("::"), F.concat(F.lit("g:"), h), colon)
    texts = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(forms).alias("text")).distinct()
    return texts.withColumn("ok", native.ipv6_plausible(F.col("text")))


def _detected(detector: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = normalized(shapes.shaped_log(spark, sf_dir, detector), FoldConfig(disabled=shapes.WITHOUT.get(detector, frozenset())))
        return rows.select("line_no", "normalized", _notes().alias("tokens"))

    return run


def _notes() -> Column:
    return F.array_join(F.transform("tokens", lambda t: F.concat(t["type"], F.lit("="), t["value"])), "|")


for _name in shapes.SHAPES:
    QUERIES[f"detect_{_name}"] = _detected(_name)
    ORACLES[f"detect_{_name}"] = shapes.expected(_name)


# --- normalization and folding --------------------------------------------------------------------


@query(f"SELECT line_no, normalized, 'TIMESTAMP=' || stamp || '|BRACKET_CONTEXT=' || level || '|KEY_VALUE=user_id=number|DURATION=' || val AS tokens FROM ({EV})")
def full_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N0 over the event log."""
    return normalized(src.event_log(spark, sf_dir)).select("line_no", "normalized", _notes().alias("tokens"))


@query()
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N0 over the lines of all documents."""
    return normalized(src.doc_lines(spark, sf_dir).select("line_no", "line")).select("line_no", "normalized", F.size("tokens").alias("n_tokens"))


@query()
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N0 over the access log."""
    return normalized(src.url_log(spark, sf_dir)).select("line_no", "normalized", F.size("tokens").alias("n_tokens"))


@query(f"SELECT normalized, count(*) AS count, arg_min(line, line_no) AS first_line, arg_max(line, line_no) AS last_line, min(line_no) AS first_line_no, max(line_no) AS last_line_no FROM ({EV}) GROUP BY normalized")
def fold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1: groups of equal templates."""
    rows = normalized(src.event_log(spark, sf_dir))
    return rows.groupBy("normalized").agg(F.count("*").alias("count"), F.min_by("line", "line_no").alias("first_line"), F.max_by("line", "line_no").alias("last_line"), F.min("line_no").alias("first_line_no"), F.max("line_no").alias("last_line_no"))


def _with_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fold(spark, sf_dir).clusters
    leaders = found.filter("ord = gid").select("gid", F.col("normalized").alias("leader"))
    return found.join(leaders, "gid")


@query(f"{GROUPED} SELECT normalized, leader, n FROM gi")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1: the leader of every template."""
    return _with_leader(spark, sf_dir).select("normalized", "leader", "n")


@query(f"{GROUPED} SELECT normalized, leader, round({_score('leader', 'normalized')}, 6) AS score FROM gi")
def similarity_to_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1a: how similar templates are to their leaders."""
    return _with_leader(spark, sf_dir).select("normalized", "leader", F.round(score_column(F.col("leader"), F.col("normalized")), 6).alias("score"))


@query(f"{GROUPED} SELECT gid, count, first_line, last_line, last_line_no FROM gr")
def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, AGG1, SRT1."""
    return _fold(spark, sf_dir).groups.select("gid", "count", F.col("first.line").alias("first_line"), F.col("last.line").alias("last_line"), F.col("last.line_no").alias("last_line_no"))


#: Logs of shapes whose values fall into each bucket, and all their values as SQL.
_MIXED = ("timestamp", "network", "hash", "uuid", "process", "duration", "http_status", "kubernetes", "bracket", "email", "path", "name")
_MIXED_TOKENS = " UNION ALL ".join(f"SELECT unnest(string_split(tokens, '|')) AS t FROM ({shapes.expected(d)}) WHERE tokens <> ''" for d in _MIXED)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = [shapes.shaped_log(spark, sf_dir, d) for d in _MIXED]
    return normalized(reduce(DataFrame.unionByName, logs))


@query(f"""WITH tk AS (SELECT split_part(t, '=', 1) AS type FROM ({_MIXED_TOKENS}))
SELECT {", ".join(f"count(*) FILTER (WHERE type IN ({', '.join(repr(t) for t in types)})) AS {bucket}" for bucket, types in g.BUCKETS.items())} FROM tk""")
def token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5, over lines of many shapes."""
    return g.token_hits(_mixed(spark, sf_dir))


@query(f"""SELECT count(*) AS lines, count(*) FILTER (WHERE tokens <> '') AS patterns_detected FROM ({" UNION ALL ".join(shapes.expected(d) for d in _MIXED)})""")
def patterns_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3, AGG4, over lines of many shapes, of which some have no values."""
    return _mixed(spark, sf_dir).agg(F.count("*").alias("lines"), F.count_if(F.size("tokens") > 0).alias("patterns_detected"))


@query(f"{GROUPED} SELECT gid, type, distinct_count, capped FROM ro")
def rollup_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AGG13."""
    return _fold(spark, sf_dir).rollup.select("gid", "type", "distinct_count", "capped")


@query(f"{GROUPED} SELECT gid, type, coalesce(array_to_string(samples, '|'), '') AS samples FROM ro")
def rollup_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12."""
    return _fold(spark, sf_dir).rollup.select("gid", "type", F.array_join("samples", "|").alias("samples"))


@query(f"{GROUPED} SELECT gid, 'BRACKET_CONTEXT|DURATION|EMAIL|IPV4|TIMESTAMP' AS token_types FROM gr")
def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14."""
    return _fold(spark, sf_dir).groups.select("gid", F.array_join(g.token_types(), "|").alias("token_types"))


@query(f"{GROUPED} SELECT gid, first_seen, last_seen FROM gr")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15."""
    return _fold(spark, sf_dir).groups.select("gid", g.first_timestamp(F.col("first.tokens")).alias("first_seen"), g.first_timestamp(F.col("last.tokens")).alias("last_seen"))


@query(
    f"""{GROUPED} SELECT input_lines, output_lines, round(lines_saved::DOUBLE / input_lines * 100, 9) AS compression_ratio, round((input_lines - output_lines)::DOUBLE / input_lines * 100, 9) AS markdown_ratio,
  collapsed_groups, lines_saved, input_lines AS patterns_detected, 4 AS categories FROM st"""
)
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2, AGG3, AGG4, AGG6 to AGG10, SNK6, SNK8."""
    return _stats(_fold(spark, sf_dir))


def _stats(fold: Fold) -> DataFrame:
    out = g.stats(fold.normalized, fold.groups, fold.config)
    return out.select("input_lines", "output_lines", *(F.round(c, 9).alias(c) for c in ("compression_ratio", "markdown_ratio")), "collapsed_groups", "lines_saved", "patterns_detected", "categories")


@query(f"""{GROUPED} SELECT input_lines, groups AS output_lines, round(json_saved::DOUBLE / input_lines * 100, 9) AS compression_ratio, round((input_lines - groups)::DOUBLE / input_lines * 100, 9) AS markdown_ratio,
  collapsed_groups, json_saved AS lines_saved, input_lines AS patterns_detected, 4 AS categories FROM st""")
def stats_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, AGG8 for records: each group is one line."""
    return _stats(_fold(spark, sf_dir, FoldConfig(output_format="json")))


@query(f"""{GROUPED} SELECT input_lines, groups AS output_lines, round((input_lines - groups)::DOUBLE / input_lines * 100, 9) AS compression_ratio, round((input_lines - groups)::DOUBLE / input_lines * 100, 9) AS markdown_ratio,
  0::BIGINT AS collapsed_groups, input_lines - groups AS lines_saved, input_lines AS patterns_detected, 4 AS categories FROM st""")
def stats_of_essence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7, AGG8 for templates alone."""
    return _stats(_fold(spark, sf_dir, FoldConfig(essence=True)))


@query(f"{GROUPED} SELECT count, template AS normalized, first_line AS line FROM gr ORDER BY count DESC, template LIMIT 10")
def top_n_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT2: the ten largest groups."""
    return views.top_n(_fold(spark, sf_dir).groups, 10).select("count", F.col("first.normalized").alias("normalized"), F.col("first.line").alias("line"))


@query(f"{GROUPED} SELECT count, first_line AS line FROM gr ORDER BY count DESC, first_line LIMIT 30")
def summary_default_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT3, LIM1, AGG16: the summary with its default cap."""
    return views.summary(_fold(spark, sf_dir).groups).limit(views.SUMMARY_CAP)


@query(f"{GROUPED} SELECT '[' || count || 'x] ' || CASE WHEN length('[' || count || 'x] ' || first_line) > 60 THEN left(first_line, 60 - length('[' || count || 'x] ') - 3) || '...' ELSE first_line END AS line FROM gr")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10: summary lines, 60 characters wide."""
    return views.summary(_fold(spark, sf_dir).groups).select(views.summary_line(F.col("count"), F.col("line"), 60).alias("line"))


@query(f"{GROUPED} SELECT (sum(count) * 100 // (SELECT count(*) FROM ev))::BIGINT AS coverage FROM (SELECT count FROM gr ORDER BY count DESC, template LIMIT 2)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17: the share of the two largest groups, truncated."""
    fold = _fold(spark, sf_dir)
    total = fold.normalized.agg(F.count("*").alias("total"))
    return views.top_n(fold.groups, 2).agg(F.sum("count").alias("n")).join(total).select(F.floor(F.col("n") * 100 / F.col("total")).alias("coverage"))


@query(
    f"""WITH tk AS (SELECT normalized, t.type AS type, t.value AS value FROM (SELECT normalized, unnest(tokens) AS t FROM ({shapes.GROUP_LOG}))),
dc AS (SELECT type, count(DISTINCT value) AS c FROM tk GROUP BY normalized, type),
so AS (SELECT type, list_sort(list(c)) AS cs, count(*) AS n FROM dc GROUP BY type)
SELECT type, n, {", ".join(f"cs[(floor((n - 1) * {p} + 0.5) + 1)::INT] AS p{p * 100:g}" for p in (0.5, 0.9, 0.95, 0.99))}, cs[-1] AS max FROM so"""
)
def calibration_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21."""
    return views.percentiles(views.template_counts(normalized(shapes.group_log(spark, sf_dir))))


def _simulated(threshold: int, least: int) -> str:
    """The estimate of a simulation as text."""
    return f"""({grouped(threshold)} SELECT printf('%.1f%% (%d lines)', (1 - lines::DOUBLE / total) * 100, lines::BIGINT) FROM (SELECT sum(CASE WHEN count >= {least} THEN 1 ELSE count END) AS lines, sum(count) AS total FROM gr))"""


@query(f"SELECT {_simulated(85, 4)} AS at_85, {_simulated(70, 3)} AS at_70")
def simulated_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: what groups of four at 85 and of three at 70 would make of the log."""
    found = analyze(spark, shapes.group_log(spark, sf_dir))["estimated_compression"]
    return spark.createDataFrame([(found["default"], found["aggressive"])], "at_85 string, at_70 string")


@query(
    f"""WITH ev AS ({shapes.GROUP_LOG}), tk AS (SELECT line_no, unnest(range(1, 6)) AS pos, unnest(tokens) AS t FROM ev),
f AS (SELECT CASE t.type WHEN 'TIMESTAMP' THEN 'timestamps' ELSE 'ips' END AS kind, t.value AS value, min(line_no * 100 + pos) AS pl FROM tk WHERE t.type IN ('TIMESTAMP', 'IPV4') GROUP BY ALL)
SELECT kind, value, (row_number() OVER (PARTITION BY kind ORDER BY pl))::INT AS place FROM f QUALIFY place <= CASE kind WHEN 'timestamps' THEN 3 ELSE 5 END"""
)
def analysis_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: the first distinct values of sampled kinds."""
    return views.analysis_samples(normalized(shapes.group_log(spark, sf_dir)))


@query(
    """SELECT kind, text FROM (SELECT unnest(['few', 'stamps', 'addresses', 'hashes', 'paths']) AS kind, unnest(['Times, addresses and hashes are rare here: expect little folding.',
  'Nearly all lines carry a time, which the defaults fold.', 'Network addresses are in most lines and will fold.', 'Hashes are frequent and will fold.', 'Paths vary a lot: leave their detector on.']) AS text)"""
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20: what is recommended for logs that are mostly of one kind."""
    of = {"few": "name", "stamps": "timestamp", "addresses": "network", "hashes": "hash", "paths": "path"}
    rows = [(kind, text) for kind, d in of.items() for text in views.recommendations(views.analysis_counts(normalized(shapes.shaped_log(spark, sf_dir, d))).first().asDict()) if kind == "few" or "rare" not in text]
    return spark.createDataFrame(rows, "kind string, text string")


# --- renderers ------------------------------------------------------------------------------------


@query(f"{TEXTS} SELECT gid, count, text FROM tx")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK2: the folded text of every group."""
    return _fold(spark, sf_dir).text().select("gid", "count", "text")


@query(f"{GROUPED} SELECT gid, template AS text FROM gr")
def essence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6."""
    return _fold(spark, sf_dir, FoldConfig(essence=True)).text().select("gid", "text")


@query(
    f"""{GROUPED}, vs AS (SELECT gid, string_agg(type || ':' || distinct_count || ':' || coalesce(array_to_string(samples, '|'), '') || ':' || capped::VARCHAR, ';' ORDER BY type) AS variation FROM ro GROUP BY gid)
SELECT (row_number() OVER (ORDER BY gr.gid) - 1)::BIGINT AS id, count, template AS normalized, first_line, gr.gid AS first_line_no, last_line, last_line_no, first_seen, last_seen, coalesce(variation, '') AS variation FROM gr LEFT JOIN vs USING (gid)"""
)
def group_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5 in columns: what the JSON records hold, numbered by first lines."""
    fold = _fold(spark, sf_dir, FoldConfig(output_format="json"))
    entry = lambda e: F.concat_ws(":", e["type"], e["distinct_count"], F.array_join(e["samples"], "|"), e["capped"])
    first, last = F.col("first"), F.col("last")
    cols = [first["normalized"].alias("normalized"), first["line"].alias("first_line"), first["line_no"].alias("first_line_no"), last["line"].alias("last_line"), last["line_no"].alias("last_line_no")]
    seen = [g.first_timestamp(first["tokens"]).alias("first_seen"), g.first_timestamp(last["tokens"]).alias("last_seen")]
    return numbered(fold.scratch, fold.described, "gid", name="id").select("id", "count", *cols, *seen, F.array_join(F.transform("variation", entry), ";").alias("variation"))


@query(f"""{GROUPED}, fl AS (SELECT gid, any_value(count) AS count, arg_min(tokens, line_no) AS a, arg_max(tokens, line_no) AS b FROM al JOIN gr USING (gid) GROUP BY gid),
vy AS (SELECT gid, count, array_to_string(list_sort(list_transform(list_filter(range(1, 6), lambda i: a[i].value <> b[i].value), lambda i: CASE a[i].type WHEN 'IPV4' THEN 'IP' ELSE lower(a[i].type) END)), ', ') AS v FROM fl)
SELECT gid, '[+' || (count - 2) || ' similar' || CASE WHEN v <> '' THEN ', varying: ' || v ELSE '' END || ']' AS marker FROM vy""")
def plain_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SNK4: markers that only name what varies."""
    return _fold(spark, sf_dir).groups.select("gid", render.plain_marker(F.col("count") - 2, F.col("first.tokens"), F.col("last.tokens"), FoldConfig()).alias("marker"))


@query(f"SELECT line_no, regexp_replace(line, '{ln.EMAIL}', '<EMAIL>', 'g') AS masked FROM ({src.DOC_LINES}) WHERE regexp_matches(line, '{ln.EMAIL}')")
def email_mask_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, PRJ2: lines with addresses, masked by the tokens that normalization found."""
    rows = normalized(src.doc_lines(spark, sf_dir).select("line_no", "line")).filter(F.exists("tokens", lambda t: t["type"] == "EMAIL"))
    return rows.select("line_no", ln.masked_by(F.col("line"), F.col("tokens")).alias("masked"))


@query(f"SELECT line_no, '<TIMESTAMP> <BRACKET_CONTEXT> <KEY_VALUE> event=' || event_type || ' value=' || val || ' props=' || props AS normalized FROM ({EV})")
def disabled_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5: normalization without measures."""
    return normalized(src.event_log(spark, sf_dir), FoldConfig(disabled=frozenset({"duration"}))).select("line_no", "normalized")


#: A record of a group as JSON; the values of the log need no escapes.
_RECORD = f"""{GROUPED}, vj AS (SELECT gid, string_agg('"' || type || '":{{"distinct_count":' || distinct_count || ',"samples":[' || coalesce('"' || array_to_string(samples, '","') || '"', '') || '],"capped":' || capped::VARCHAR || '}}', ',' ORDER BY type) AS variation FROM ro GROUP BY gid)
SELECT (row_number() OVER (ORDER BY gr.gid) - 1)::BIGINT AS id, '{{"type":"group","id":' || (row_number() OVER (ORDER BY gr.gid) - 1) || ',"count":' || count || ',"token_types":["BRACKET_CONTEXT","DURATION","EMAIL","IPV4","TIMESTAMP"],"normalized":"' || template
  || '","first":{{"line":"' || first_line || '","line_no":' || gr.gid || '}},"last":{{"line":"' || last_line || '","line_no":' || last_line_no || '}},"time_range":{{"first_seen":"' || first_seen || '","last_seen":"' || last_seen || '"}},"variation":{{' || coalesce(variation, '') || '}}}}' AS record
FROM gr LEFT JOIN vj USING (gid)"""


@query(_RECORD)
def group_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: the JSON records."""
    return _fold(spark, sf_dir, FoldConfig(output_format="json")).records()


_RATIO = "printf('%.1f', lines_saved::DOUBLE / input_lines * 100)"


@query(
    f"""{TEXTS} SELECT gid, text FROM tx UNION ALL SELECT -1, '# Log Analysis' || chr(10) || '*Generated by lineweave on 1970-01-01T00:00:00Z*' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- **Original lines**: ' || input_lines || chr(10)
  || '- **Compressed lines**: ' || output_lines || chr(10) || '- **Compression ratio**: ' || printf('%.1f', (input_lines - output_lines)::DOUBLE / input_lines * 100) || '%' || chr(10) || chr(10) || '## Compressed Logs' || chr(10) FROM st"""
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: the head of the report and its entries."""
    fold = _fold(spark, sf_dir, FoldConfig(output_format="markdown"))
    head = spark.createDataFrame([(-1, render.markdown_head(fold.stats, "1970-01-01T00:00:00Z"))], "gid long, text string")
    return head.unionByName(fold.text().select("gid", "text"))


@query(
    f"""{GROUPED}, rl AS (SELECT [{", ".join(f"'| {name} | ' || {{}} || ' | {text} |'" for _, name, text in render.DISTRIBUTION if name in ("Times", "Network", "Durations", "Other values", "E-mail")).format(*["input_lines"] * 5)}] AS rows, * FROM st)
SELECT array_to_string(list_concat(['', '---', '# Fold statistics', '*lineweave, 1970-01-01T00:00:00Z*', '', '- lines read: ' || input_lines, '- lines written: ' || output_lines,
  '- share folded away: ' || {_RATIO} || '% (' || CASE WHEN lines_saved * 100 > 90 * input_lines THEN 'high' WHEN lines_saved * 100 > 70 * input_lines THEN 'medium' ELSE 'low' END || ')', '- lines with values: ' || input_lines, '- kinds of values: 4',
  '- folded groups: ' || collapsed_groups || ', which save ' || lines_saved || ' lines', '', '| Values | Count | What they are |', '|---|---|---|'], list_concat(rows, CASE WHEN collapsed_groups > 50 THEN ['', 'More than 50 groups were folded: start with the largest (--top).', '---'] ELSE ['---'] END)), chr(10)) AS report FROM rl"""
)
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: the footer of a fold."""
    return spark.createDataFrame([(render.stats_report(_fold(spark, sf_dir).stats, "1970-01-01T00:00:00Z"),)], "report string")


@query(f"""{GROUPED}, sh AS (SELECT sum(count) AS lines FROM (SELECT count FROM gr ORDER BY count DESC, first_line LIMIT 30)), n AS (SELECT count(*) AS patterns FROM gr)
SELECT CASE WHEN patterns > 30 THEN '(30 of ' || patterns || ' patterns, ' || printf('%.0f', lines::DOUBLE / input_lines * 100) || '% coverage — use --top N to adjust, or --top 0 for all)'
  ELSE '(' || patterns || ' of ' || patterns || ' patterns, ' || input_lines || ' of ' || input_lines || ' lines, 100% coverage)' END AS message FROM sh, n, st""")
def coverage_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11: what a summary says of the lines that it shows."""
    return spark.createDataFrame([(_fold(spark, sf_dir).summary()[1],)], "message string")


@query(f"{TEXTS} SELECT count, '[' || count || 'x] ' || text AS line FROM tx ORDER BY count DESC, template LIMIT 20")
def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12, LIM2: the texts of the twenty largest groups."""
    return _fold(spark, sf_dir).top(20).select("count", F.concat(F.lit("["), F.col("count").cast("string"), F.lit("x] "), "text").alias("line"))


@query(
    f"""{GROUPED} SELECT '{{"total_lines": ' || input_lines || ', "estimated_compression": {{' || array_to_string(list_transform(['default', 'with_paths', 'with_numbers', 'aggressive'], lambda k: '"' || k || '": "' || {_RATIO} || '% compression"'), ', ')
  || '}}, "pattern_distribution": {{"timestamps": ' || input_lines || ', "ips": ' || input_lines || ', "paths": 0, "hashes": 0, "numbers": ' || input_lines || ', "uuids": 0, "pids": 0}}, "recommendations": ["' || {_RATIO} || '% of the lines fold away.", "'
  || (input_lines - lines_saved) || ' of ' || input_lines || ' lines remain.", "' || CASE WHEN lines_saved * 100 > 90 * input_lines THEN 'Nearly all of it repeats: fold it.' WHEN lines_saved * 100 > 70 * input_lines THEN 'Most of it repeats: folding pays.' ELSE 'Little of it repeats: folding may not pay.' END
  || '"], "sample_patterns": {{"paths": [], "numbers": [], "timestamps": [], "ips": []}}}}' AS document FROM st"""
)
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13."""
    return spark.createDataFrame([(json.dumps(_fold(spark, sf_dir).preflight()),)], "document string")


@query()
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, AGG18 to AGG20, over the business log."""
    return spark.createDataFrame([(json.dumps(analyze(spark, src.order_log(spark, sf_dir))),)], "document string")


@query()
def document_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 at many different templates: groups of the lines of all documents."""
    return Fold(spark, src.doc_lines(spark, sf_dir)).groups.select("gid", "count", F.col("first.normalized").alias("normalized"))


@query(f"SELECT normalized, count(*) AS count, min(line_no) AS first_line_no, max(line_no) AS last_line_no FROM ({EV}) GROUP BY normalized")
def streaming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: templates counted over the event log as a stream."""
    from lineweave.streaming.fold import template_counts

    s = Scratch(spark, "stream")
    lines = s.write(src.event_log(spark, sf_dir), "lines")
    stream = spark.readStream.schema(lines.schema).parquet(lines._scratch_path)  # noqa: SLF001
    out = f"{s.path}/out"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = template_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{s.path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


@query(f"{TEXTS} SELECT gid, count, text FROM tx")
def streaming_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: a stream whose micro-batches are folded one by one; here all lines come in one of them."""
    from lineweave.streaming.fold import fold_batches

    s = Scratch(spark, "stream")
    lines = s.write(shapes.group_log(spark, sf_dir), "lines")
    out = f"{s.path}/out"
    stream = spark.readStream.schema(lines.schema).parquet(lines._scratch_path)  # noqa: SLF001
    write = fold_batches(stream, lambda texts, batch_id: texts.select("gid", "count", "text").write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
    write.option("checkpointLocation", f"{s.path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("gid", "count", "text")


@query(f"{GROUPED} SELECT 'all' AS log, gid, count, template AS normalized, first_line, last_line, last_line_no AS last_no FROM gr")
def streaming_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1, STR3: groups of one ordered log that comes as a stream, with those that are open at its end."""
    return _streamed(spark, shapes.group_log(spark, sf_dir).select(F.lit("all").alias("log"), "line_no", "line"))


@query()
def streaming_fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1 to STR3: the same with more groups than may be open, over the lines of all documents, one log for each language."""
    return _streamed(spark, src.doc_lines(spark, sf_dir).select(F.col("lang").alias("log"), "line_no", "line"))


def _streamed(spark: SparkSession, lines: DataFrame) -> DataFrame:
    from lineweave.streaming.fold import OUT, fold_stream

    s = Scratch(spark, "stream")
    lines = s.write(lines, "lines")
    stream = spark.readStream.schema(lines.schema).parquet(lines._scratch_path)  # noqa: SLF001
    write = fold_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{s.path}/out").option("checkpointLocation", f"{s.path}/state").trigger(availableNow=True)
    write.start().awaitTermination()
    ends = lines.select("log", F.lit(0).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line")).distinct()
    ends.write.mode("append").parquet(lines._scratch_path)  # noqa: SLF001
    write.start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{s.path}/out")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


