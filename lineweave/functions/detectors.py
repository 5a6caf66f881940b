"""The detectors, as tables of passes over fixed patterns.

Each table states what a detector finds, what it puts in its place and what it notes. Patterns and word lists are
fixed values: they decide which lines share a template.
"""

from __future__ import annotations

import re

from .rewrite import Detector, Match, Note, Pass, always, group, has, number, whole, within

# --- e-mail ---------------------------------------------------------------------------------------

# Fixed value.
EMAIL = re.compile(r"\b[a-zA-Z0-9][a-zA-Z0-9._+-]{0,63}@[a-zA-Z0-9][a-zA-Z0-9.-]{0,253}\.[a-zA-Z]{2,}\b")


def _mailable(m: Match, text: str) -> bool:
    return len(m[0]) <= 320 and not m[0].split("@")[0].endswith(".")


email = Detector(has("@"), [Pass(EMAIL, "<EMAIL>", whole("EMAIL"), accept=_mailable)], always)

# --- paths and escaped structures -----------------------------------------------------------------

# Fixed values.
EVENT = re.compile(r"&Event\{[^}]*\}")
STRUCT = re.compile(r'(\\"?\{[\\"\w\s:,\[\]$/_-]*\}\\"?)')
FLAG = re.compile(r"\s--?[a-zA-Z][a-zA-Z0-9\-_]*")
SOURCE_LINE = re.compile(r"([a-zA-Z_][a-zA-Z0-9_\-]*\.(go|rs|py|js|java|c|cpp|h|hpp|rb|php|ts|tsx|jsx|cs|swift|kt|m|mm|scala|clj|ex|exs|erl|hrl)):\d+\]")
URL = re.compile(r'https?://[^/\s]+(?:/[^\s"]*)')
FILE_PATH = re.compile(r"(/[a-zA-Z0-9_.\-/]+(?:\.[a-zA-Z0-9]+)?(?:/[a-zA-Z0-9_.\-]*)*/?)")
WINDOWS_PATH = re.compile(r"([A-Za-z]:\\[a-zA-Z0-9_.\-\\]+(?:\\[a-zA-Z0-9_.\-]*)*\\?)")
URL_PATH = re.compile(r"((?:/[a-zA-Z0-9_.\-~%]*)+(?:\?[a-zA-Z0-9_.\-~%&=]*)?(?:#[a-zA-Z0-9_.\-~%]*)?)")
ROUTE_ID = re.compile(r"/([0-9a-fA-F]{8,}|[0-9]{3,}|[a-fA-F0-9\-]{8,})")
SEGMENT = re.compile(r"/([a-zA-Z0-9][a-zA-Z0-9\-]{2,}[a-zA-Z0-9])")
QUERY = re.compile(r"\?([a-zA-Z0-9_\-]+=([^&\s]+)(&[a-zA-Z0-9_\-]+=([^&\s]+))*)")
SYSTEM_DIRS = ("/var/", "/usr/", "/etc/", "/home/", "/opt/", "/tmp/")
API_PARTS = ("/api/", "/v1/", "/v2/")
API_STARTS = ("/static/", "/assets/")
# Segments of a route that stay; those of fewer than four characters are never replaced.
ROUTE_WORDS = frozenset("api v1 v2 v3 alpha beta namespaces pods services deployments configmaps secrets serviceaccounts token status proxy logs exec static assets public health metrics".split())


def _struct_name(m: Match) -> str:
    return "<VOLUME_SPEC>" if "volumeName:" in m[0] else "<K8S_OBJECT>" if "ObjectMeta:" in m[0] else "<JSON_DATA>"


def _structures(kind: str) -> list[Pass]:
    return [Pass(EVENT, "<EVENT_OBJECT>", whole(kind), needs="&Event{"), Pass(STRUCT, _struct_name, whole(kind), needs="\\")]


def file_like(path: str) -> bool:
    """Whether a path looks like one of a file: an extension, several segments or a system directory."""
    return len(path) >= 3 and path.startswith("/") and ("." in path.rsplit("/", 1)[-1] or path.count("/") > 1 or any(d in path for d in SYSTEM_DIRS))


def route_like(path: str) -> bool:
    """Whether a path looks like one of a URL."""
    return len(path) >= 2 and path.startswith("/") and ("?" in path or path.count("/") > 1 or any(p in path for p in API_PARTS) or path.startswith(API_STARTS) or ROUTE_ID.search(path) is not None)


def route_template(path: str) -> str:
    """A URL path with identifiers, unknown words and query values replaced."""
    path = ROUTE_ID.sub("/<PATH>", path)
    path = SEGMENT.sub(lambda m: m[0] if m[1] in ROUTE_WORDS else "/<PATH>", path)
    return QUERY.sub(lambda m: "?" + "&".join(p.partition("=")[0] + "=<PATH>" for p in m[1].split("&")), path)


path = Detector(
    lambda text: True,
    [
        *_structures("PATH"),
        Pass(FLAG, " <FLAG>", lambda m, seen: [("PATH", m[0].strip())], needs="-"),
        Pass(SOURCE_LINE, lambda m: f"{m[1]}:<LINE>]", whole("PATH"), needs="]"),
        Pass(URL, "<PATH>", whole("PATH"), needs="://"),
        Pass(FILE_PATH, "<PATH>", whole("PATH"), accept=lambda m, t: file_like(m[1]), needs="/"),
        Pass(WINDOWS_PATH, "<PATH>", whole("PATH"), needs=":\\"),
        Pass(URL_PATH, lambda m: route_template(m[1]), whole("PATH"), accept=lambda m, t: route_like(m[1]), needs="/"),
    ],
    always,  # the parts of a route that have digits also have two slashes, which is enough
)
json = Detector(has("{"), _structures("JSON"), always)

# --- identifiers ----------------------------------------------------------------------------------

# Fixed values.
UUID = re.compile(r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b")
REQUEST_ID = re.compile(r"\b(?:req|request)[-_]?(?:id)?[=:]?\s*([a-zA-Z0-9\-_]+)\b")
TRACE_ID = re.compile(r"\btrace[=:]([a-zA-Z0-9\-_]+)\b")
SESSION_ID = re.compile(r"\bsession[=:]([a-zA-Z0-9\-_]+)\b")
CORRELATION_ID = re.compile(r"\bcorrelation[-_]?id[=:]([a-zA-Z0-9\-_]+)\b")
HEX_32 = re.compile(r"\b[0-9a-fA-F]{32}\b")
_HEX, _HEX_RUN = re.compile(r"[0-9a-fA-F]"), re.compile(r"[0-9a-fA-F]{7}")


def id_like(text: str) -> bool:
    return 4 <= len(text) <= 64 and re.search("[a-zA-Z0-9]", text) is not None


def mixed_hex(text: str) -> bool:
    """Whether 32 hex digits hold more than four letters and more than four digits."""
    digits = sum(c.isdigit() for c in text)
    return 4 < digits < len(text) - 4


uuid = Detector(
    lambda text: any(w in text for w in ("-", "req", "trace", "session")) or len(text.encode()) > 20 and _HEX.search(text) is not None,
    [
        Pass(UUID, "<UUID>", whole("UUID"), needs="-"),
        Pass(REQUEST_ID, "request_id=<UUID>", group("UUID", when=id_like), needs="req"),
        Pass(TRACE_ID, "trace=<UUID>", group("UUID", when=id_like), needs="trace"),
        Pass(SESSION_ID, "session=<UUID>", group("UUID", when=id_like), needs="session"),
        Pass(CORRELATION_ID, "correlation_id=<UUID>", group("UUID", when=id_like), needs="correlation"),
        Pass(HEX_32, "<UUID>", group("UUID", 0, mixed_hex), context=lambda t: _HEX_RUN.search(t) is not None, steady=True),
    ],
    always,
)

# --- network --------------------------------------------------------------------------------------

# Fixed values.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_OCTET6 = "(?:25[0-5]|(?:2[0-4]|1?[0-9])?[0-9])"
_H = "[0-9a-f]{1,4}"
IPV4_PORT = re.compile(rf"\b((?:{_OCTET}\.){{3}}{_OCTET}):(\d{{1,5}})\b")
IPV6_PORT = re.compile(r"\[([a-fA-F0-9:]+(?:%\w+)?)\]:(\d{1,5})\b")
IPV4 = re.compile(rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b")
IPV6 = re.compile(
    "(?i)(?:"
    rf"(?:{_H}:){{7}}{_H}|::(?:{_H}:){{0,6}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}"
    rf"|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{1,6}}|::(?:ffff(?::0{{1,4}})?:)?(?:{_OCTET6}\.){{3}}{_OCTET6}"
    rf"|(?:{_H}:){{6}}(?:{_OCTET6}\.){{3}}{_OCTET6}|::)"
)
HOST_PORT = re.compile(r"([a-zA-Z][a-zA-Z0-9.-]*):([1-9]\d{1,4})\b")
FQDN = re.compile(r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}\b")
#: What a text has if it has an address, or a name.
_DOTTED, _ENDING = re.compile(r"[0-9]\.[0-9]"), re.compile(r"\.[a-zA-Z]{2}")
#: What a text has if it has an address, a port or a name, besides six colons.
_NETWORK_LIKE = re.compile(r"\d\.\d+\.\d+\.\d|\]:\d|[a-zA-Z0-9.-]:\d\d|::|\.[a-zA-Z]{2}")
# A host that ends so is a source file and its number a line.
SOURCE_ENDS = (".go", ".rs", ".py", ".js", ".java", ".c", ".cpp", ".h")


def ipv6_like(text: str) -> bool:
    return 2 <= len(text) <= 100 and re.fullmatch("[0-9a-fA-F:.]*", text) is not None and ":" in text and (text == "::" or _HEX.search(text) is not None)


def _endpoint(kind: str, ports: bool):
    def note(m: Match, seen: list[Note]) -> list[Note]:
        port = number(m[2], 65535)
        return [] if port is None else [(kind, m[1]), *([("PORT", str(port))] if ports else [])]

    return note


def _unseen(kind: str, n: int, most: int | None = None):
    """Notes a group unless it was noted before; with a bound, as a number up to it."""

    def note(m: Match, seen: list[Note]) -> list[Note]:
        value = m[n] if most is None else None if (v := number(m[n], most)) is None else str(v)
        return [(kind, value)] if value is not None and (kind, value) not in seen else []

    return note


def network(ips: bool = True, ports: bool = True, fqdns: bool = True) -> Detector:
    def gate(text: str) -> bool:
        return ips and ("." in text or ":" in text) or ports and ":" in text or fqdns and "." in text and any(w in text for w in ("com", "org", "net"))

    addresses = [
        Pass(IPV4_PORT, "<IP>:<PORT>", _endpoint("IPV4", ports), needs=":"),
        Pass(IPV6_PORT, "[<IP>]:<PORT>", _endpoint("IPV6", ports), needs="]:"),
        Pass(IPV4, "<IP>", _unseen("IPV4", 0), context=lambda t: _DOTTED.search(t) is not None),
        Pass(IPV6, "<IP>", group("IPV6", 0, ipv6_like), context=lambda t: "::" in t or t.count(":") >= 6, needs=":"),
    ]
    hosts = [Pass(HOST_PORT, lambda m: f"{m[1]}:<PORT>", _unseen("PORT", 2, 65535), accept=lambda m, t: not m[1].endswith(SOURCE_ENDS), needs=":")]
    names = [Pass(FQDN, "<FQDN>", whole("IPV4"), context=lambda t: _ENDING.search(t) is not None)]
    return Detector(gate, addresses * ips + hosts * ports + names * fqdns, lambda text, masked: text.count(":") < 6 and not _NETWORK_LIKE.search(text))


# --- hashes and processes -------------------------------------------------------------------------

# Lengths of hex runs, in the order in which they are looked for.
HEX_LENGTHS = ("128", "64", "56", "48", "40", "32", "24", "16", "7,39")
hashes = Detector(lambda text: _HEX_RUN.search(text) is not None, [Pass(re.compile(rf"\b[a-fA-F0-9]{{{n}}}\b"), "<HASH>", whole("HASH"), steady=True) for n in HEX_LENGTHS], always)

# Fixed values.
PID_BRACKET = re.compile(r"\[pid=(\d+)\]|\[(\d+)\]")
PID_EQUALS = re.compile(r"\bpid=(\d+)\b")
THREAD = re.compile(r"\bThread-(\d+)\b")
TID = re.compile(r"\btid=(0x[a-fA-F0-9]+)\b")
THREAD_NAME = re.compile(r"\[thread:([a-zA-Z0-9_-]+)\]")
ID_EQUALS = re.compile(r"\bid=(\d+)\b")
PID_PAREN = re.compile(r"\((\d+)\)")
MOST_PID = 4_194_304


def _pid(once: bool):
    def note(m: Match, seen: list[Note]) -> list[Note]:
        value = number(next(g for g in m.groups() if g is not None), MOST_PID)
        return [("PID", str(value))] if value and not (once and ("PID", str(value)) in seen) else []

    return note


process = Detector(
    lambda text: True,
    [
        Pass(PID_BRACKET, "[pid=<PID>]", _pid(False), needs="["),
        Pass(PID_EQUALS, "pid=<PID>", _pid(True), needs="pid="),
        Pass(THREAD, "Thread-<TID>", group("THREAD_ID", prefix="Thread-"), needs="Thread-"),
        Pass(TID, "tid=<TID>", group("THREAD_ID"), needs="tid="),
        Pass(THREAD_NAME, "[thread:<TID>]", group("THREAD_ID"), needs="[thread:"),
        Pass(ID_EQUALS, "id=<PID>", _pid(True), needs="id="),
        Pass(PID_PAREN, "(<PID>)", _pid(True), needs="("),
    ],
    lambda text, masked: b"0x" not in masked,
)

# --- kubernetes -----------------------------------------------------------------------------------

# Fixed values.
NAMESPACES = frozenset("kube-system kube-public kube-node-lease default gpu-operator rook-ceph kubevirt traefik cilium-test-1 cattle-monitoring-system keycloak monitoring logging istio-system cert-manager".split())
_LABEL = "[a-z0-9][a-z0-9-]*[a-z0-9]"
NAMESPACE_FORMS = [rf"Namespace:({_LABEL})", rf"namespace:({_LABEL})", rf"pod ({_LABEL})/", rf"_({_LABEL})\("]
ACCESS_VOLUMES = ['volume "kube-api-access-[a-z0-9]+"', "volume kube-api-access-[a-z0-9]+"]
NAMED_VOLUMES = [rf'volume "({_LABEL}-secret)"', rf'volume "({_LABEL}-token)"', "volume (oidc-token)"]
PLUGIN = 'plugin type="([^"]+)"'
POD_FORMS = [rf"Name:({_LABEL}-[a-z0-9]+)", rf"pod ({_LABEL})/({_LABEL}-[a-z0-9]+)"]
NAME_FIELDS = [r'([a-zA-Z]*[Nn]ame): "([^"]+)"', r'([a-zA-Z]*[Nn]ame)="([^"]+)"', r"([a-zA-Z]*[Nn]ame):([a-zA-Z0-9-]+)\b", r"([a-zA-Z]*[Nn]ame)=([a-zA-Z0-9-]+)\b"]
NAME_PUTS = ['{}: "<K8S_NAME>"', '{}="<K8S_NAME>"', "{}: <K8S_NAME>", "{}=<K8S_NAME>"]


def _renamed(put: str, drop: str | None = None):
    """The match with every occurrence of its last group (or of a literal) replaced."""
    return lambda m: m[0].replace(drop or m[m.re.groups], put)


def _name_form(m: Match) -> str:
    return NAME_PUTS[("=" in m[0]) + 2 * ('"' not in m[0])].format(m[1])


_cluster = has("kube", "namespace", "pod", "volume")
kubernetes = Detector(
    _cluster,
    [
        *(Pass(re.compile(p), _renamed("<NAMESPACE>"), group("K8S_NAMESPACE"), accept=lambda m, t: m[1] in NAMESPACES) for p in NAMESPACE_FORMS),
        *(Pass(re.compile(p), _renamed("kube-api-access-<SUFFIX>", "kube-api-access-"), needs="kube-api-access-") for p in ACCESS_VOLUMES),
        *(Pass(re.compile(p), lambda m: _renamed("kube-api-access-<SUFFIX>", "kube-api-access-")(m) if "kube-api-access" in m[0] else _renamed("<VOLUME_NAME>")(m), group("K8S_VOLUME"), needs="volume ") for p in NAMED_VOLUMES),
        Pass(re.compile(PLUGIN), 'plugin type="<PLUGIN>"', group("K8S_PLUGIN"), needs="plugin type="),
        *(Pass(re.compile(p), _renamed("<POD_NAME>"), lambda m, seen: [("K8S_POD", m[m.re.groups])]) for p in POD_FORMS),
        *(Pass(re.compile(p), _name_form, group("K8S_NAMESPACE", 2), needs="ame") for p in NAME_FIELDS),
    ],
    lambda text, masked: not _cluster(text),
)

# --- HTTP status classes --------------------------------------------------------------------------

# Fixed values.
ACCESS_STATUS = re.compile(r'"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+[^"]*"\s+(\d{3})\s+\d+')
PROTOCOL_STATUS = re.compile(r'(?:"[^"]*(?:HTTP/\d\.\d)"?\s+)(\d{3})(?:\s+\d+(?:\s+|$))')
PROXY_STATUS = re.compile(r"(\d{3})\s*->\s*.*?(\d{3})")


def status_class(code: str) -> str:
    """'2xx' and so on; 'unknown' outside of 100 to 599."""
    return f"{code[0]}xx" if "1" <= code[0] <= "5" else "unknown"


def _ascii(m: Match, text: str) -> bool:
    return all(g.isascii() for g in m.groups())


def _status_mark(code: str) -> str:
    return f"<HTTP_STATUS_{status_class(code).upper()}>"


def _statuses(m: Match, seen: list[Note]) -> list[Note]:
    return [("HTTP_STATUS_CLASS", status_class(code)) for code in m.groups()]


_REQUESTS = ("HTTP/", "GET ", "POST ", "PUT ", "DELETE ")
_request_like = has(*_REQUESTS, '" 0')
http_status = Detector(
    has(*_REQUESTS, '" 2', '" 3', '" 4', '" 5'),
    [
        *(Pass(p, lambda m: within(1, _status_mark(m[1]))(m), _statuses, accept=_ascii, needs='"') for p in (ACCESS_STATUS, PROTOCOL_STATUS)),
        Pass(PROXY_STATUS, lambda m: f"{_status_mark(m[1])} -> {_status_mark(m[2])}", _statuses, accept=_ascii, needs="->"),
    ],
    lambda text, masked: not _request_like(masked.decode("utf-8", "surrogatepass")),
)

# --- bracketed contexts ---------------------------------------------------------------------------

# Fixed values.
BRACKET = re.compile(r"\[([a-zA-Z][a-zA-Z0-9_.-]*)\]")
BRACKET_CHAIN = re.compile(r"(?:\[([a-zA-Z][a-zA-Z0-9_.-]*)\]\s*){2,}")
NO_BRACKETS = ("[2001:", "array[", "index[", "param=", "[1 +", "[0-9")
K8S_WORDS = ("kubernetes.io/", "namespace/", "pod/", "service/", "configmap/", "secret/", "deployment/", "volumes/", "projected-", "volume-subpath", "projected", "apiserver", "kube-", "kubelet", "kube-proxy", "kube-scheduler", "kube-controller", "etcd", "coredns")
LOG_LEVELS = "error err warn warning info information debug trace fatal crit critical notice emerg emergency alert".split()
LOG_COMPONENTS = "upstream downstream proxy ssl tls auth config listener cluster backend frontend handler worker manager service client server connection request response session".split()
SYSTEM_CONTEXTS = "kernel systemd init cron syslog audit security firewall network storage memory".split()
CONTEXT_PARTS = "mod_jk mod_ssl mod_rewrite mod_security mod_proxy ngx_http core main event http".split()
CONTEXT_STARTS = ("mod_", "ngx_")
CONTEXT_ENDS = ("_service", "_manager", "_client", "_server")

_k8s, _no_brackets = has(*K8S_WORDS), has(*NO_BRACKETS)
_CONTEXTS = frozenset(LOG_LEVELS + LOG_COMPONENTS + SYSTEM_CONTEXTS)


def log_context(word: str) -> bool:
    w = word.lower()
    return w in _CONTEXTS or any(p in w for p in CONTEXT_PARTS) or w.startswith(CONTEXT_STARTS) or w.endswith(CONTEXT_ENDS)


def _chain(m: Match) -> list[str]:
    return [x.lower() for x in BRACKET.findall(m[0])]


def _log_chain(m: Match, text: str) -> bool:
    words = _chain(m)
    return any(map(log_context, words)) and all(len(w.encode()) != 1 for w in words)


bracket = Detector(
    lambda text: "[" in text and "]" in text and not _no_brackets(text) and not _k8s(text),
    [
        Pass(BRACKET_CHAIN, "<BRACKET_CONTEXT>", lambda m, seen: [("BRACKET_CONTEXT", ",".join(_chain(m)))], accept=_log_chain),
        Pass(BRACKET, "<BRACKET_CONTEXT>", lambda m, seen: [("BRACKET_CONTEXT", m[1].lower())], accept=lambda m, t: log_context(m[1])),
    ],
    lambda text, masked: b"[0" not in masked,
)

# --- key-value pairs ------------------------------------------------------------------------------

# Fixed values.
METRIC = re.compile(r"([a-zA-Z][a-zA-Z0-9_.-]*)\s*=\s*(\d+(?:\.\d+)?(?:%|ms|s|MB|GB|KB|rps|qps)?)")
SETTING = re.compile(r"([a-zA-Z][a-zA-Z0-9_.-]*)\s*=\s*([^\s,;|]+)")
JSON_PAIR = re.compile(r'"([a-zA-Z][a-zA-Z0-9_.-]*)"\s*:\s*(?:"([^"]+)"|(\d+(?:\.\d+)?)|true|false|null)')
PAIR = re.compile(r"([a-zA-Z][a-zA-Z0-9_.-]*)\s*[=:]\s*([^\s,;|]+(?:%|ms|s|MB|GB|KB|bytes?)?)")
NO_PAIRS = ("if ", "for ", "while ", "SELECT ", "http://", "https://", "ftp://")
METRIC_WORDS = "metrics stats performance monitor usage cpu memory disk network load throughput latency response_time error_rate success_rate".split()
SETTING_WORDS = "config configuration settings params parameters options properties environment variables".split()
JSON_WORDS = "level timestamp message msg component service logger severity time ts".split()
NO_PAIR_KEYS = frozenset("if for while switch".split())
ARITHMETIC = (" + ", " - ", " * ", " / ")
SQL_WORDS = ("SELECT ", "INSERT ", "UPDATE ", "DELETE ")
PAIR_KEYS = frozenset("timeout retries max_connections port host ssl debug verbose level user_id session_id request_id attempt_count failure_rate success_rate response_time cpu_usage memory_usage disk_usage queue_size buffer_size".split())
KEY_STARTS = ("max_", "min_")
KEY_ENDS = ("_timeout", "_limit", "_size", "_count", "_rate", "_usage")
VALUE_ENDS = ("ms", "%", "MB", "KB", "GB")
DURATION_ENDS = ("ms", "us", "ns")
SIZE_ENDS = ("MB", "GB", "KB", "bytes", "byte")
RATE_ENDS = ("rps", "qps", "/s", "/min", "/hr")
BOOLEANS = frozenset("true false enabled disabled on off".split())
URL_STARTS = ("http://", "https://", "ftp://")


_no_pairs, _arithmetic, _sql = has(*NO_PAIRS), has(*ARITHMETIC), has(*SQL_WORDS)


def ip_like(value: str) -> bool:
    parts = value.split(".")
    if len(parts) == 4:
        return all(re.fullmatch(r"\+?[0-9]+", p) and int(p) <= 255 for p in parts)
    return ":" in value and re.fullmatch("[0-9a-fA-F:]+", value) is not None


def value_type(value: str) -> str:
    """The kind of a value; the first of the kinds in this order that fits."""
    kinds = (
        ("percentage", lambda: value.endswith("%")),
        ("duration", lambda: value.endswith(DURATION_ENDS) or re.search("[0-9]s$", value) and not value.endswith("\n")),
        ("size", lambda: value.endswith(SIZE_ENDS)),
        ("rate", lambda: value.endswith(RATE_ENDS)),
        ("boolean", lambda: value.lower() in BOOLEANS),
        ("number", lambda: re.fullmatch("[0-9.]*", value)),
        ("ip", lambda: ip_like(value)),
        ("url", lambda: value.startswith(URL_STARTS)),
    )
    return next((kind for kind, fits in kinds if fits()), "string")


def _pair_key(m: Match, text: str) -> bool:
    return m[1] not in NO_PAIR_KEYS and (m[1] in PAIR_KEYS or m[1].startswith(KEY_STARTS) or m[1].endswith(KEY_ENDS) or m[2].endswith(VALUE_ENDS))


def _no_code(text: str) -> bool:
    return not _arithmetic(text) and not _sql(text.upper())


def _pair(m: Match, seen: list[Note]) -> list[Note]:
    return [("KEY_VALUE", f"{m[1].lower()}={value_type(m[2])}")]


def _json_pair(m: Match, seen: list[Note]) -> list[Note]:
    return [("KEY_VALUE", f"{m[1].lower()}={value_type(m[2] or m[3] or 'null')}")]


def _lower_has(words: list[str]):
    inner = has(*words)
    return lambda text: inner(text.lower())


key_value = Detector(
    lambda text: ("=" in text or ":" in text) and not _no_pairs(text),
    [
        Pass(METRIC, "<KEY_VALUE>", _pair, context=_lower_has(METRIC_WORDS), needs="=", steady=True),
        Pass(SETTING, "<KEY_VALUE>", _pair, context=_lower_has(SETTING_WORDS), needs="=", steady=True),
        Pass(JSON_PAIR, lambda m: f'"{m[1]}": <KEY_VALUE>', _json_pair, context=has(*JSON_WORDS), needs='"', steady=True),
        Pass(PAIR, "<KEY_VALUE>", _pair, accept=_pair_key, context=_no_code, steady=True),
    ],
    always,
)

# --- log levels with modules ----------------------------------------------------------------------

# Fixed values.
APACHE = re.compile(r"\[(error|warn|warning|info|information|debug|trace|fatal|crit|critical|notice)\]\s+(mod_\w+)")
NGINX = re.compile(r"\[(error|warn|warning|info|information|debug|trace|fatal|crit|critical|notice)\]\s+\d+#\d+:\s*\*?\d*\s+(ngx_\w+(?:_module)?)")
SYSLOG = re.compile(r"([a-zA-Z]+)\.(error|err|warn|warning|info|information|debug|trace|fatal|crit|critical|notice|emerg|emergency|alert)\s+([a-zA-Z][a-zA-Z0-9_-]+):")
FRAMEWORK = re.compile(r"(ERROR|WARN|WARNING|INFO|INFORMATION|DEBUG|TRACE|FATAL|CRITICAL)\s+\[([a-zA-Z][a-zA-Z0-9_.]+)\]")
SYSTEMD = re.compile(r"([a-zA-Z][a-zA-Z0-9_-]+)\[\d+\]:\s*\[(error|warn|warning|info|information|debug|trace|fatal)\]\s+([a-zA-Z][a-zA-Z0-9_]+):")
MODULE_MARKS = ("mod_", "ngx_", "[error]", "[warn", "[info", "[debug", "ERROR ", "WARN ", "INFO ", "DEBUG ")
CODE_WORDS = ("function ", "class ", "import ")
APACHE_MODULES = tuple("mod_jk mod_ssl mod_rewrite mod_security mod_proxy mod_deflate mod_expires mod_headers mod_auth mod_authz mod_authn mod_cache mod_fcgid mod_wsgi mod_php mod_perl mod_python mod_dir mod_alias mod_mime".split())
NGINX_MODULES = tuple("ngx_http_core ngx_http_ssl ngx_http_rewrite ngx_http_proxy ngx_http_upstream ngx_http_fastcgi ngx_http_gzip ngx_http_auth ngx_http_access ngx_http_limit ngx_http_log ngx_stream ngx_mail".split())
DAEMONS = frozenset("kernel sshd systemd cron postfix nginx apache mysql postgresql redis docker NetworkManager dhcpd named ntpd rsyslog auditd firewalld".split())
FRAMEWORKS = "spring hibernate slf4j logback log4j junit jackson servlet jdbc jpa security web mvc rest data cache redis mongodb elasticsearch . _".split()
SYSTEMD_ENDS = ("_manager", "_service", "_client", "_daemon")
SYSLOG_LEVELS = {"err": "error", "emerg": "emergency", "crit": "critical"}


_modules, _code = has(*MODULE_MARKS), has(*CODE_WORDS)


def _module(level: int, module: int):
    return lambda m, seen: [("LOG_WITH_MODULE", f"{m[level].lower()}:{m[module]}")]


def _with_module(text: str) -> bool:
    return "[" in text and _modules(text) and not _code(text) and not _k8s(text)


log_module = Detector(
    _with_module,
    [
        Pass(APACHE, "<LOG_WITH_MODULE>", _module(1, 2), accept=lambda m, t: m[2].startswith(APACHE_MODULES), needs="mod_"),
        Pass(NGINX, lambda m: f"[{m[1]}] <LOG_WITH_MODULE>", _module(1, 2), accept=lambda m, t: m[2].startswith(NGINX_MODULES) or "module" in m[2], needs="ngx_"),
        Pass(SYSLOG, lambda m: f"{m[1]}.{m[2]} <LOG_WITH_MODULE>:", lambda m, seen: [("LOG_WITH_MODULE", f"{SYSLOG_LEVELS.get(m[2], m[2])}:{m[3]}")], accept=lambda m, t: m[3] in DAEMONS or m[3].endswith("d") or "_service" in m[3] or "-service" in m[3], needs="."),
        Pass(FRAMEWORK, lambda m: f"{m[1]} [<LOG_WITH_MODULE>]", _module(1, 2), accept=lambda m, t: any(f in m[2] for f in FRAMEWORKS), needs="["),
        Pass(SYSTEMD, lambda m: f"{m[1]}[PID]: [{m[2]}] <LOG_WITH_MODULE>:", lambda m, seen: [("LOG_WITH_MODULE", f"{m[2]}:{m[1]}.{m[3]}")], accept=lambda m, t: m[3].endswith(SYSTEMD_ENDS), needs="]:"),
    ],
    lambda text, masked: not _with_module(text),
)

# --- structured messages --------------------------------------------------------------------------

# Fixed values.
CONTAINER = re.compile(r'\{"[^}]*"log":\s*"[^"]*\[(INFO|ERROR|WARN|DEBUG)\]\s+([^:]+):[^"]*"[^}]*\}')
LEVEL_FIRST = re.compile(r'\{"[^"]*(?:level|severity|lvl)"[^"]*:\s*"(error|warn|warning|info|information|debug|trace|fatal|critical)"[^}]*"(?:component|service|module|logger|source)"[^"]*:\s*"([^"]+)"[^}]*\}')
COMPONENT_FIRST = re.compile(r'\{"[^"]*"(?:component|service|module|logger|source)"[^"]*:\s*"([^"]+)"[^}]*"(?:level|severity|lvl)"[^"]*:\s*"(error|warn|warning|info|information|debug|trace|fatal|critical)"[^}]*\}')
LOGFMT = re.compile(r"(?:level|severity|lvl)=(error|warn|warning|info|information|debug|trace|fatal|critical)\s+(?:component|service|module|logger|source)=([^\s]+)")
STRUCTURED_MARKS = ('"level":', '"severity":', '"component":', '"service":', "level=", "component=")
NO_STRUCTURED = ('"data":', '"result":', '"response":')
NO_STRUCTURED_K8S = (
    *("kubernetes.io/", "namespace/", "pod/", "service/", "configmap/", "secret/", "deployment/", "volumes/", "projected-", "volume-subpath", "projected", "apiserver", "kube-"),
    *('"component":"kubelet', '"component":"scheduler', '"component":"proxy', '"component":"controller', '"component":"etcd', '"component":"coredns'),
    *("component=kubelet", "component=scheduler", "component=proxy", "component=controller", "component=etcd", "component=coredns"),
)
APPLICATION_PARTS = "application database cache auth payment notification user order inventory billing analytics monitoring logging metrics".split()
APPLICATION_ENDS = ("-service", "_service", "-api", "_api", "-client", "_client")
MICROSERVICE_PARTS = "service api gateway proxy balancer registry discovery config auth user payment order inventory notification".split()
FRAMEWORK_PARTS = "spring hibernate jackson slf4j logback jersey servlet tomcat jetty netty akka vertx reactor rxjava guava".split()
INFRASTRUCTURE_PARTS = "nginx apache haproxy envoy traefik consul vault nomad prometheus grafana elasticsearch logstash kibana fluentd redis memcached mongodb postgresql mysql".split()

_application = has(*APPLICATION_PARTS)
_marked, _excluded = has(*STRUCTURED_MARKS), has(*NO_STRUCTURED, *NO_STRUCTURED_K8S)
_component = has(*APPLICATION_PARTS, *MICROSERVICE_PARTS, *FRAMEWORK_PARTS, *INFRASTRUCTURE_PARTS)


def component_like(name: str) -> bool:
    return _component(name) or name.endswith(APPLICATION_ENDS) or "." in name and " " not in name or re.fullmatch(r"[a-zA-Z0-9_.-]{3,50}", name) is not None and not re.fullmatch("[0-9]+", name)


def _message(level: int, component: int):
    return lambda m, seen: [("STRUCTURED_MESSAGE", f"{m[component].lower()}:{m[level].lower()}")]


def _structured_like(text: str) -> bool:
    return _marked(text) and not _excluded(text)


structured = Detector(
    _structured_like,
    [
        Pass(CONTAINER, '{"log": "<STRUCTURED_MESSAGE>"}', _message(1, 2), accept=lambda m, t: _application(m[2]) or m[2].endswith(APPLICATION_ENDS), needs='"log":'),
        Pass(LEVEL_FIRST, "<STRUCTURED_MESSAGE>", _message(1, 2), accept=lambda m, t: component_like(m[2]), needs='{"'),
        Pass(COMPONENT_FIRST, "<STRUCTURED_MESSAGE>", _message(2, 1), accept=lambda m, t: component_like(m[1]), needs='{"'),
        Pass(LOGFMT, "<STRUCTURED_MESSAGE>", _message(1, 2), accept=lambda m, t: component_like(m[2]), needs="="),
    ],
    lambda text, masked: not _structured_like(text),
)

# --- durations and measures -----------------------------------------------------------------------

# Fixed values.
DURATION_FIELD = re.compile(r"\w*[Dd]uration=\d+\.\d+")
DURATION = re.compile(r'\b(?:\d+h(?:\d+m)?(?:\d+(?:\.\d+)?s)?|\d+m(?:\d+(?:\.\d+)?s)?|\d+(?:\.\d+)?(?:ms|μs|ns|s))\b|"[0-9h]*[0-9m]*[0-9.]+s"')
ADDRESS = re.compile(r"\b0x[a-fA-F0-9]+\b")
SIZE = re.compile(r"\b\d+(?:\.\d+)?\s*(?:bytes?|[KMGT]?B)\b")
STATUS = re.compile(r"(?i)(?:status|error|code|returned?)\s+([1-5][0-9][0-9])\b")
PERCENT = re.compile(r"\b\d+(?:\.\d+)?%")
_THREE = re.compile(r"\s[1-5][0-9][0-9]\b")
DECIMAL = re.compile(r"\b\d+\.\d+\b")
INTEGER = re.compile(r"\b\d{3,}\b")
MEASURE_MARKS = (".", "%", "ms", "s", "m", "h", "bytes", "KB", "MB")

_measured, _countable = has(*MEASURE_MARKS), re.compile(r'[\d"]')
duration = Detector(
    lambda text: _countable.search(text) is not None and _measured(text),
    [
        Pass(DURATION_FIELD, "<DURATION_FIELD>", whole("DURATION"), needs="uration="),
        Pass(DURATION, "<DURATION>", whole("DURATION"), steady=True),
        Pass(ADDRESS, "<ADDR>", whole("NUMBER"), needs="0x"),
        Pass(SIZE, "<SIZE>", whole("SIZE"), steady=True),
        Pass(STATUS, within(1, "<HTTP_STATUS>"), group("HTTP_STATUS"), context=lambda t: _THREE.search(t) is not None),
        Pass(PERCENT, "<PCT>", whole("NUMBER"), needs="%"),
        Pass(DECIMAL, "<DECIMAL>", whole("DURATION"), needs="."),
        Pass(INTEGER, "<NUMBER>", whole("NUMBER"), steady=True),
    ],
    lambda text, masked: b"0x" not in masked,  # a status code is an integer too
)

# --- names ----------------------------------------------------------------------------------------

# Fixed values.
NAME = re.compile(r"\b([a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)*)-([a-z0-9]{5,})\b")
COMMON_SUFFIXES = frozenset("stable latest master worker server client proxy cache store admin config service".split())
COMMON_PREFIXES = frozenset("kube-api-access kube-proxy kube-controller kube-scheduler nvidia-device-plugin nvidia-container-toolkit node-feature-discovery container-runtime csi-rbdplugin virt-handler cilium-envoy".split())


def variable_suffix(suffix: str) -> bool:
    return suffix not in COMMON_SUFFIXES and re.search("[a-z]", suffix) is not None and re.search("[0-9]", suffix) is not None


# Without a suffix there is nothing to find, and a long chain of short words would be searched from each of them.
_SUFFIX = re.compile(r"-[a-z0-9]{5,}\b")
name = Detector(lambda text: "-" in text and _SUFFIX.search(text) is not None, [Pass(NAME, lambda m: f"{m[1] if m[1] in COMMON_PREFIXES else '<COMPONENT>'}-<SUFFIX>", whole("NAME"), accept=lambda m, t: variable_suffix(m[2]))], always)


def by_words(text: str) -> bool:
    """Whether detectors whose words hold digits, or that compare values, come into question."""
    return _cluster(text) or any(w in text for w in _REQUESTS) or _marked(text)
