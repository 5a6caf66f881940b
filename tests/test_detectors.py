"""Placeholders and values of every detector, their gates and their order."""

import random
import re
import time

import pytest

from lineweave.config import FoldConfig
from lineweave.functions import detectors as d
from lineweave.functions import normalize, rewrite, timestamps
from lineweave.functions.normalize import normalizer, quoted

norm = normalizer()


@pytest.mark.parametrize(
    ("detector", "text", "template", "notes"),
    [
        (d.email, "to a.b+c@mail.example.org now", "to <EMAIL> now", [("EMAIL", "a.b+c@mail.example.org")]),
        (d.email, "a.@x.org", "a.@x.org", []),
        (d.email, f"{'a' * 63}@{'b.' * 130}org", f"{'a' * 63}@{'b.' * 130}org", []),
        (d.path, "open /var/log/app.log ok", "open <PATH> ok", [("PATH", "/var/log/app.log")]),
        (d.path, "see /x", "see /x", []),
        (d.path, r"in C:\Temp\a.txt", "in <PATH>", [("PATH", r"C:\Temp\a.txt")]),
        (d.path, "run --dry-run -v", "run <FLAG> <FLAG>", [("PATH", "--dry-run"), ("PATH", "-v")]),
        (d.path, "main.go:42] x", "main.go:<LINE>] x", [("PATH", "main.go:42]")]),
        (d.path, "GET https://h.example/a?b=1 x", "GET <PATH> x", [("PATH", "https://h.example/a?b=1")]),
        (d.path, "/12345678", "/<PATH>", [("PATH", "/12345678")]),
        (d.path, 'x &Event{a b} \\"{volumeName: a}\\" y', "x <EVENT_OBJECT> <VOLUME_SPEC> y", [("PATH", "&Event{a b}"), ("PATH", '\\"{volumeName: a}\\"')]),
        (d.json, '\\"{ObjectMeta: a}\\"', "<K8S_OBJECT>", [("JSON", '\\"{ObjectMeta: a}\\"')]),
        (d.json, "{a: b}", "{a: b}", []),
        (d.uuid, "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "<UUID>", [("UUID", "3f2504e0-4f89-11d3-9a0c-0305e82c3301")]),
        (d.uuid, "request done", "request_id=<UUID> done", [("UUID", "uest")]),
        (d.uuid, "trace=ab session:x1 correlation-id=abcd", "trace=<UUID> session=<UUID> correlation_id=<UUID>", [("UUID", "abcd")]),
        (d.uuid, "0123456789abcdef0123456789abcdef", "<UUID>", [("UUID", "0123456789abcdef0123456789abcdef")]),
        (d.uuid, "01234567890123456789012345678901", "<UUID>", []),
        (d.network(), "10.0.0.1:80 and 10.0.0.1", "<IP>:<PORT> and <IP>", [("IPV4", "10.0.0.1"), ("PORT", "80")]),
        (d.network(), "10.0.0.1:99999", "<IP>:<PORT>", []),
        (d.network(), "[fe80::1]:22 at 2001:db8::7", "[<IP>]:<PORT> at <IP>7", [("IPV6", "fe80::1"), ("PORT", "22"), ("IPV6", "2001:db8::")]),
        (d.network(), "host:8080 main.go:123", "host:<PORT> <FQDN>:123", [("PORT", "8080"), ("IPV4", "main.go")]),
        (d.network(fqdns=False), "a.example.com:443", "a.example.com:<PORT>", [("PORT", "443")]),
        (d.network(ips=False, ports=False), "db.example.com", "<FQDN>", [("IPV4", "db.example.com")]),
        (d.hashes, "sha 0123abcd and cafe", "sha <HASH> and cafe", [("HASH", "0123abcd")]),
        (d.hashes, "f" * 64 + " " + "a" * 40, "<HASH> <HASH>", [("HASH", "f" * 64), ("HASH", "a" * 40)]),
        (d.process, "[12] pid=12 Thread-3 tid=0xff [thread:io-1] id=7 (9)", "[pid=<PID>] pid=<PID> Thread-<TID> tid=<TID> [thread:<TID>] id=<PID> (<PID>)", [("PID", "12"), ("THREAD_ID", "Thread-3"), ("THREAD_ID", "0xff"), ("THREAD_ID", "io-1"), ("PID", "7"), ("PID", "9")]),
        (d.process, "[0] [4194305] [99999999999]", "[pid=<PID>] [pid=<PID>] [pid=<PID>]", []),
        (d.kubernetes, "namespace:kube-system", "namespace:<NAMESPACE>", [("K8S_NAMESPACE", "kube-system")]),
        (d.kubernetes, "namespace:mine", "namespace:mine", []),
        (d.kubernetes, "volume kube-api-access-x1", "volume kube-api-access-<SUFFIX>x1", []),
        (d.kubernetes, 'volume "db-secret" plugin type="csi"', 'volume "<VOLUME_NAME>" plugin type="<PLUGIN>"', [("K8S_VOLUME", "db-secret"), ("K8S_PLUGIN", "csi")]),
        (d.kubernetes, 'pod podName="a-1" nodeName:n7', 'pod podName="<K8S_NAME>" nodeName: <K8S_NAME>', [("K8S_NAMESPACE", "a-1"), ("K8S_NAMESPACE", "n7")]),
        (d.http_status, '"GET /a HTTP/1.1" 404 12', '"GET /a HTTP/1.1" <HTTP_STATUS_4XX> 12', [("HTTP_STATUS_CLASS", "4xx")]),
        (d.http_status, '"GET /a" 999 12', '"GET /a" <HTTP_STATUS_UNKNOWN> 12', [("HTTP_STATUS_CLASS", "unknown")]),
        (d.http_status, "PUT 502 -> x 200", "PUT <HTTP_STATUS_5XX> -> <HTTP_STATUS_2XX>", [("HTTP_STATUS_CLASS", "5xx"), ("HTTP_STATUS_CLASS", "2xx")]),
        (d.bracket, "[error] [proxy] x [abc]", "<BRACKET_CONTEXT>x [abc]", [("BRACKET_CONTEXT", "error,proxy")]),
        (d.bracket, "[Kernel] kubelet", "[Kernel] kubelet", []),
        (d.key_value, "cpu usage load=0.5", "cpu usage <KEY_VALUE>", [("KEY_VALUE", "load=number")]),
        (d.key_value, "config a=b", "config <KEY_VALUE>", [("KEY_VALUE", "a=string")]),
        (d.key_value, '{"msg": "hi", "n": 3}', '{"msg": <KEY_VALUE>, "n": <KEY_VALUE>}', [("KEY_VALUE", "msg=string"), ("KEY_VALUE", "n=number")]),
        (d.key_value, "max_wait: 30ms if x", "max_wait: 30ms if x", []),
        (d.log_module, "[error] mod_ssl_x y", "<LOG_WITH_MODULE> y", [("LOG_WITH_MODULE", "error:mod_ssl_x")]),
        (d.log_module, "INFO [app.web] x", "INFO [<LOG_WITH_MODULE>] x", [("LOG_WITH_MODULE", "info:app.web")]),
        (d.log_module, "[info] auth.err sshd: x", "[info] auth.err <LOG_WITH_MODULE>: x", [("LOG_WITH_MODULE", "error:sshd")]),
        (d.structured, "level=info component=billing-api", "<STRUCTURED_MESSAGE>", [("STRUCTURED_MESSAGE", "billing-api:info")]),
        (d.structured, '{"level":"warn","data":1}', '{"level":"warn","data":1}', []),
        (d.structured, '{"level":"warn","service":"cart"}', "<STRUCTURED_MESSAGE>", [("STRUCTURED_MESSAGE", "cart:warn")]),
        (d.duration, "took 5ms 1h2m 0xff 3 KB status 404 7% 1.5 1234 12", "took <DURATION> <DURATION> <ADDR> <SIZE> status <HTTP_STATUS> <PCT> <DECIMAL> <NUMBER> 12", [("DURATION", "5ms"), ("DURATION", "1h2m"), ("NUMBER", "0xff"), ("SIZE", "3 KB"), ("HTTP_STATUS", "404"), ("NUMBER", "7%"), ("DURATION", "1.5"), ("NUMBER", "1234")]),
        (d.duration, "E1 1234", "E1 1234", []),
        (d.name, "web-7f9x2 kube-proxy-abc12 my-worker", "<COMPONENT>-<SUFFIX> kube-proxy-<SUFFIX> my-worker", [("NAME", "web-7f9x2"), ("NAME", "kube-proxy-abc12")]),
        (quoted, '"short" "at 10.0.0.1 now" "this one has no token at all"', '"short" "at <IP> now" <QUOTED_STRING>', [("QUOTED_STRING", '"at 10.0.0.1 now"'), ("QUOTED_STRING", '"this one has no token at all"')]),
        (quoted, r'"{\"a\": 1}"', "<ESCAPED_JSON>", [("QUOTED_STRING", r'"{\"a\": 1}"')]),
    ],
)
def test_detector(detector, text, template, notes):
    assert detector.run(text) == (template, notes)


@pytest.mark.parametrize(
    ("text", "template"),
    [
        ("2024-01-02T03:04:05.678Z x", "<TIMESTAMP> x"),
        ("2024-01-02 03:04:05,678 [main]", "<TIMESTAMP> [main]"),
        ("[10/Oct/2023:13:55:36 +0000] x", "<TIMESTAMP> x"),
        ("Jan  5 10:00:00 host", "<TIMESTAMP> host"),
        ("I0915 10:00:00.123456 x", "<TIMESTAMP> x"),
        ("12/31/2024 11:59:59 PM x", "<TIMESTAMP> x"),
        ("Mon, 01 Jan 2024 10:00:00 +0000: x", "<TIMESTAMP>: x"),
        ("1700000000", "1700000000"),
        ("[1700000000]: x", "<TIMESTAMP>: x"),
        ("at: T 10:00:00", "at: T <TIMESTAMP>"),
        ("2024-W05-2: x", "<TIMESTAMP>: x"),
        ("10:00 only", "10:00 only"),
    ],
)
def test_timestamps(text, template):
    assert timestamps.run(text)[0] == template


def test_overlaps_prefer_specific_formats():
    assert timestamps.find("2024-01-02T03:04:05Z 03:04:06") == [(0, 20), (21, 29)]


def test_order_of_stages_and_one_pass_only():
    assert norm("2024-01-01 10:00:00 a@b.org /var/x 10.0.0.1:80") == ("<TIMESTAMP> <EMAIL> <PATH> <IP>:<PORT>", [("TIMESTAMP", "2024-01-01 10:00:00"), ("EMAIL", "a@b.org"), ("PATH", "/var/x"), ("IPV4", "10.0.0.1"), ("PORT", "80")])
    once = norm("P 0%:")[0]
    assert once == "P <PCT>:" and norm(once)[0] != once


def test_disabled_detectors():
    off = normalizer(FoldConfig(disabled=frozenset({"email", "ip", "fqdn"})))
    assert off("a@b.org 10.0.0.1:80")[0] == "a@b.org <DECIMAL>.<DECIMAL>:80"


@pytest.mark.parametrize(("value", "kind"), [("5%", "percentage"), ("7ms", "duration"), ("7s", "duration"), ("3GB", "size"), ("9rps", "rate"), ("ON", "boolean"), ("1.5", "number"), ("10.0.0.1", "number"), ("+1.0.0.1", "ip"), ("10.0.0.300x", "string"), ("fe80::1", "ip"), ("https://a", "url"), ("news", "string"), ("", "number")])
def test_value_type(value, kind):
    assert d.value_type(value) == kind


@pytest.mark.parametrize("make", [lambda n: "a" * n, lambda n: "0123456789abcdef" * (n // 16), lambda n: "a:" * (n // 2), lambda n: '"' + "x" * n + '"', lambda n: "[a] " * (n // 4), lambda n: "a-" * (n // 2), lambda n: "1." * (n // 2), lambda n: "/a" * (n // 2)])
def test_time_grows_with_length(make):
    def took(text):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            norm(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(make(8000)) < 10 * took(make(2000)) + 0.02


PIECES = ["2024-01-02 03:04:05", "2024-01-02T03:04:05.123Z", "Jan 02 03:04:05", "1700000000", "[1700000000.5]", "03/01/2024 10:11:12", "10.0.0.1:8080", "256.1.1.1", "host:8080", "host:0808", "a.b.com", "fe80::1", "[error]", "[2001:db8::1]", "[2]", "user_id=12", "timeout=30s", "status 503", "status 603", "0x1f", "1x1f", "tid=0x12", "tid=1x12", "pid=77", "(123)", "pod cilium-test-1/web-1a2b3", "pod cilium-test-2/x-11111", "INFO [log4j]", "INFO [log5j]", '"GET /a/b HTTP/1.1" 200 12', '" 2', '" 7', "/v1/", "/v7/", "/api/v1/users/123", "d41d8cd98f00b204e9800998ecf8427e", "1234567", '"k"', '"12ms"', "5ms", "12 KB", "99%", "level=error component=auth-service", "web-1a2b3", "200 -> 404"]


def test_masks_change_nothing(monkeypatch):
    """Lines that differ in digits only, with and without what stages and passes remember of their masks."""
    rng = random.Random(5)
    lines = []
    for _ in range(3000):
        line = rng.choice([" ", "", ": "]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 6)))
        lines += [line, *(re.sub("[0-9]", lambda m: rng.choice("0123456789"), line) for _ in range(3))]
    run = normalizer()
    remembered = [run(x) for x in lines]
    monkeypatch.setattr(rewrite, "remember", lambda known, masked: None)
    monkeypatch.setattr(normalize, "remember", lambda known, masked: None)
    for stage in normalize.stages(FoldConfig()):
        for step in getattr(stage, "passes", ()):
            step.known.clear()
    normalize._remembered.cache_clear()
    plain = normalizer()
    for line, got in zip(lines, remembered):
        timestamps._known.clear()
        assert plain(line) == got, line


MANY = {
    "timestamp": lambda i: f"2024-01-02 {i % 24:02}:{i % 60:02}:{i // 60 % 60:02}.{i}",
    "email": lambda i: f"user{i}@host{i}.org",
    "path": lambda i: f"/var/lib/{i}/data{i}.db",
    "uuid": lambda i: f"{i:08x}-0000-4000-8000-{i:012x}",
    "ipv4": lambda i: f"10.{i >> 16 & 255}.{i >> 8 & 255}.{i & 255}",
    "port": lambda i: f"host{i}:{i % 60000 + 1024}",
    "hash": lambda i: f"{i:040x}",
    "pid": lambda i: f"({i})",
    "pod": lambda i: f"pod default/web-{i:05}",
    "bracket": lambda i: "[error]",
    "pair": lambda i: f"max_k{i}=v{i}",
    "duration": lambda i: f"{i}ms",
    "name": lambda i: f"svc-a{i:05}",
    "quoted": lambda i: f'"value {i} of a list"',
}


@pytest.mark.parametrize("kind", sorted(MANY))
def test_time_grows_with_distinct_values(kind):
    """Four times the values take less than eight times as long."""

    def took(n):
        best = 9.0
        for k in range(3):
            text, run = " ".join(MANY[kind](i + k * n) for i in range(n)), normalizer()
            timestamps._known.clear()
            began = time.perf_counter()
            run(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(4000) < 8 * took(1000) + 0.02


RECIPE_LINES = [
    "2024-0{}-1{} 0{}:3{}:2{} [info] words here from 10.{}{}{}.{}.{} as u{}@corp.org took {}{}.{}ms",
    "10.0.{}.{}{}{} and 10.0.{}.{}{}{} at {}{}{}.{}.1.2",
    "status {}{}{} of 2{}0{}-01-0{} 10:1{}:00 and {}{}{} KB",
    "host{}:{}{}{}{} pid={} id={} [{}] ({}) x{} y{}{} /v{}/thing",
    "{}{}:0{}:1{} at 1{}{}{}{}{}{}{}{}{}{} and a{}",
    "max_{}=10.{}{}{}.1.{} web-a{}{}{}{} \"{}0.{}s\" 0x{}{}",
    "Mar 1{} 10:{}{}:1{} order {}{}{}{} of {} {} took {}{}m{}s <IP> {}",
    "order {} of {} and {}",
    "{}{}/{}{}/2024 10:00:00 a {}{}{}{}{}{}{}{}{}{}{}{}{}",
]


@pytest.mark.parametrize("form", RECIPE_LINES)
def test_recipes_change_nothing(form):
    """Lines with the same mask come again and again; each must be done as if it were the only one."""
    rng = random.Random(5)
    one = normalizer()
    for _ in range(1500):
        line = form.format(*(rng.choice("0123456789" if rng.random() < 0.8 else "12") for _ in range(form.count("{}"))))
        text, notes = line, []
        for stage in normalize.stages(FoldConfig()):
            text, found = stage.run(text)
            notes += found
        assert one(line) == (text, notes)


def test_recipes_are_used(monkeypatch):
    one = normalizer()
    lines = [f"2024-01-01 10:00:{k:02} [info] job took {k}.5ms as u{k}@corp.org" for k in range(10, 60)]
    want = [one(line) for line in lines]
    monkeypatch.setattr(timestamps, "find", None)  # no stage runs any more
    assert [one(line) for line in lines] == want
