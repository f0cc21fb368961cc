"""Rule tables as data: patterns, labels and limits that the scanners and classifiers are built from."""

from __future__ import annotations

from typing import NamedTuple


class Signal(NamedTuple):
    """A line has this signal if it matches, holds `needs` in upper case, and holds none of `without`."""

    name: str
    pattern: str
    needs: str = ""
    without: tuple[str, ...] = ()


# Match terms of the log format that is read.
ERROR_WORD = r"(?i)\b(ERROR|FAIL|FAILED|Traceback|Exception|assert|CRITICAL|CommandFailedError|RuntimeError|ConnectionError|Timeout|Dead)\b"
TRACEBACK_START = r"Traceback \(most recent call last\):"
TRACEBACK_END = r"^(\w+(?:\.\w+)*(?:Error|Exception|Failure|Warning).*)"
TRACEBACK_CHAIN = r"(?i)^(During handling of the above exception|The above exception was the direct cause of|Caused by:)"
REMOTE_HOST = r"teuthology\.orchestra\.run\.(\w+)"
REMOTE_STDERR = r"teuthology\.orchestra\.run\.(\w+)\.stderr:(.*)"
REMOTE_COMMAND = r"DEBUG:teuthology\.orchestra\.run\.\w+:>"
COMMAND_TEXT = r":>\s*(.+)"
COMMAND_FAILED = r"Command failed on (\w+) with status (\d+)"
EXIT_CODE = r"got remote process result: (\d+)"
TASK_WARNING = r"WARNING:tasks\.\w+:"
SUMMARY_HEADER = r"(?i)^(=+ SUMMARY =+|summary of|\*+ RESULTS \*+|Results:)"
SUMMARY_DATA = r"(?i)^(description:|duration:|failure_reason:|flavor:|owner:|status:|success:)"
SIGNALS = (
    Signal("timeout", r"(?i)\b(timed? ?out|timeout|deadline exceeded|hung|not responding)\b", needs="ERROR"),
    Signal("health", r"(\[ERR\]|\[WRN\]|\[SEC\]|HEALTH_ERR|HEALTH_WARN)", without=("grep",)),
    Signal("connection", r"(?i)\b(Connection refused|ConnectionRefusedError|unreachable|ssh: connect|Network is unreachable|No route to host|Name or service not known|connection reset)\b"),
    Signal("crash", r"(?i)\b(ceph_assert|FAILED ceph_assert|segmentation fault|segfault|SIGSEGV|SIGABRT|core dumped|fatal signal|suicide timeout)\b"),
    Signal("resource", r"(?i)\b(No space left on device|Cannot allocate memory|out of memory|OOM|oom-killer|disk full|ENOSPC)\b"),
    Signal("permission", r"(?i)\b(Permission denied|EACCES|Forbidden|unauthorized|authentication failed)\b", without=("grep", "audit")),
    Signal("ansible", r"\b(fatal:|UNREACHABLE|MODULE FAILURE)\b"),
)
# what stands after ".stderr:" in a noise line; one search for that prefix serves all of them
_ON_STDERR = (
    r"\d+\.\d+\.\d+\.\d+:\d+/\d+\s*>>", r"conn\(0x[0-9a-f]+", r"s=STATE_", r"s=READY", r"s=BANNER", r"s=AUTH_", r"s=NONE", r"s=CLOSED", r"\.mark_down", r"\.stop$",
    r"\.ready entity", r"shutdown_connections", r"wait complete", r"Processor -- start", r"start start$", r"\.connect$", r"mon_subscribe", r"mon_getmap", r"mon_command",
    r"==== mon_", r"==== config\(", r"==== mgrmap", r"==== osd_map", r"_handle_peer_banner", r"Inferring config",
)
NOISE = "|".join(
    (
        r"journalctl@ceph\.mon\.\w+\.\w+\.stdout:.*dispatch$", r"journalctl@ceph\.mon\.\w+\.\w+\.stdout:.*Reconfiguring", r"gzip -5 --verbose", r"tar c -f - -C",
        r"-- replaced with .+\.gz$", r"^\s*\d+\.\d+% -- replaced", r"INFO:teuthology\.orchestra\.run\.\w+\.stderr:\s*(?:$|\d+\+\d+ records|\d+ bytes copied)",
        rf"\.stderr:.*(?:{'|'.join(_ON_STDERR)})", r"(?:real|user|sys)\s+\d+m[\d.]+s$",
    )
)
METADATA = r"(?i)^(===|---|\s*Job ID:|\s*Total lines:|\s*Total characters:|\s*Tracebacks|\s*Block #)"
ERROR_LINE = r"(?i)\b(ERROR|FAIL|FAILED|Traceback|Exception|CRITICAL|assert|timed out|CommandFailedError|ConnectionError)\b"

# Failure types in order of evaluation, on lower-cased text; patterns whose dots stay on one line.
TYPE_RULES = (
    ("test_bug", r"not valid:|invalid command|unused arguments|error einval|not in raw\|lvm|--objectstore not valid"),
    ("config", r"no module named"),
    ("infra", r"command failed on \S+ with status \d+.*sudo (yum|dnf|apt).*install|failed to fetch package version|error reimaging|reimage.*failed|command failed.*openstack"),
    ("test_bug", r"valgrind error|command failed \((workunit test|ragweed tests|bucket notification tests|s3.* tests)"),
    ("crash", r"segmentation fault|segfault|core dumped|sigsegv|sigabrt|ceph_assert|fatal signal|panic"),
    ("timeout", r"timed out|timeout|deadline exceeded"),
    ("network", r"connectionerror|connection refused|network is unreachable|name or service not known|no route to host|connection reset by peer|sslerror"),
    ("permission", r"permission denied|unauthorized|forbidden|eacces|authentication failed|keyring"),
    ("resource", r"out of memory|cannot allocate memory|no space left on device|disk full|oom"),
    ("crash", r"traceback|assertionerror|runtimeerror"),
    ("config", r"invalid config|parse error|bad value|unknown option"),
    ("infra", r"qa-proxy|node down|ssh: connect|artifact|404|commandfailederror"),
    ("test_bug", r"workunit|test failed|assert |expected"),
)
# Known error forms by falling severity; the first that matches wins.
CONCRETE_RULES = (
    ("crash", "critical", r"segmentation fault|segfault|SIGSEGV|core dumped|ceph_assert|suicide timeout"),
    ("resource", "critical", r"bluefs.*out of space|out of memory|OOM|oom-killer|Cannot allocate memory"),
    ("resource", "high", r"No space left on device"),
    ("config", "high", r"No module named"),
    ("infra", "high", r"Command failed on \S+ with status \d+.*sudo (yum|dnf|apt)|Failed to fetch package version|Error reimaging|reimage.*failed"),
    ("test_bug", "high", r"Command failed \((workunit test|ragweed tests|bucket notification tests)"),
    ("infra", "high", r"Command failed.*openstack"),
    ("permission", "high", r"Permission denied|EACCES|Forbidden"),
    ("test_bug", "medium", r"valgrind error"),
    ("network", "medium", r"Connection refused|ConnectionRefusedError"),
    ("timeout", "medium", r"timed? ?out|Timeout|deadline exceeded"),
    ("infra", "medium", r"ssh:.*connect|SSH.*timeout|ansible.*unreachable"),
)
STDERR_REASONS = (
    "not valid:.*", "Invalid command:.*", "Error [A-Z]+:.*", "EINVAL.*", "No such file or directory.*", "Permission denied.*", "Connection refused.*",
    "No space left on device.*", "Cannot allocate memory.*", "ModuleNotFoundError:.*", "ImportError:.*", "FileNotFoundError:.*",
)
SEVERITIES = ("critical", "high", "medium", "low")
FAILURE_TYPES = ("network", "crash", "timeout", "config", "test_bug", "infra", "permission", "resource", "unknown")
SEVERITY_ALIASES = {"sev1": "critical", "sev2": "high", "sev3": "medium", "sev4": "low"}
TYPE_ALIASES = {
    "connection": "network", "connectivity": "network", "dns": "network", "socket": "network", "http": "network",
    "command_failure": "infra", "commandfailederror": "infra", "infra_issue": "infra", "infrastructure": "infra", "configuration": "config",
    "permission_error": "permission", "auth": "permission", "authorization": "permission",
    "oom": "resource", "memory": "resource", "disk": "resource", "flaky": "test_bug", "test_failure": "test_bug",
}
CATEGORIES = {
    "network": "network/connectivity issue", "crash": "component crash/exception", "timeout": "operation timeout", "config": "configuration/dependency error",
    "test_bug": "test logic failure", "infra": "infrastructure/provisioning issue", "permission": "permission/authentication issue", "resource": "resource exhaustion",
    "unknown": "unknown issue",
}
HALLUCINATIONS = (
    "boto3", "boto", "aws sdk", "s3 operation", "read frame preamble", "state_connection_established", "messenger v2", "protocol version incompatibility",
)
# Signatures: a failed command, else a timeout, else a fatal word, each to the end of its line.
SIGNATURE_COMMAND = r"(?i)(CommandFailedError[^\n]{0,200})"
SIGNATURE_TIMEOUT = r"(?i)((?:timed?\s*out|timeout|deadline exceeded)[^\n]{0,150})"
SIGNATURE_FATAL = r"(?i)((?:FATAL|CRITICAL|segmentation fault|core dumped|panic)[^\n]{0,150})"
SIGNATURE_EXCEPTION = r"(?m)^(\w+(?:\.\w+)*(?:Error|Exception|Failure|Warning)[^\n]{0,200})"
VOLATILE = r"(?i)(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|0x[0-9a-f]{6,}|\bpid[= ]\d+|/tmp/[^\s]+|\b\d{10,}\b)"
# Block fingerprints: what to erase or replace, in order.
FINGERPRINT_STEPS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[\.\d]*\s*", ""),
    (r"\b\d+\.\d+\.\d+\.\d+\b", "<IP>"),
    (r"\b(trial|smithi|mira)\d+\b", "<HOST>"),
    (r"(?i)\bpid[= ]\d+\b", "pid=<PID>"),
    (r"\b\d{5,}\b", "<ID>"),
    (r"\s+", " "),
)
# The condensed text of a job.
HEADINGS = {
    "reason": "=== FAILURE REASON (from teuthology summary) ===",
    "stderr": "=== COMMAND STDERR (%d failed, %d unique) ===",
    "context": "=== FAILURE CONTEXT (%d window(s)) ===",
    "traces": "=== TRACEBACKS (%d unique, %d duplicates removed) ===",
    "signals": "=== OTHER FAILURE SIGNALS (%d detected) ===",
    "summary": "=== LOG SUMMARY ===",
    "blocks": "=== ERROR BLOCKS (%d of %d unique) ===",
    "tail": "=== LOG TAIL (no specific errors extracted) ===",
}
STDERR_ITEM, STDERR_REPEATS, STDERR_COMMAND, STDERR_LINES = "--- Failed command #%d on %s (exit %d)%s ---", " [repeated %dx]", "Command: ", "Stderr output:"
CONTEXT_ITEM, TRACE_ITEM, SIGNAL_ITEM, BLOCK_ITEM = "--- Context window #%d ---", "--- Traceback #%d ---", "  [%s] %s", "--- Block #%d (lines %d-%d) ---"
CLIP_MARK = "\n\n... [middle truncated to fit model context] ...\n\n"
TRUNCATED = "\n\n... [truncated for HTML report size] ...\n(showing first %s of %s chars)"
# Addresses of a job's log.
LOG_URL = "https://qa-proxy.ceph.com/teuthology/%s/%s/teuthology.log"
LOG_URL_RUN = r"https?://qa-proxy\.ceph\.com/teuthology/([^/]+)/"
LOG_NAMES = ("teuthology.log", "ansible.log")
# End of fixed values.

ACTIONS = {
    "network": "Test name resolution and reachability between the nodes of the job.",
    "crash": "Read the stack trace and find the component that went down.",
    "timeout": "Find what the job waited for; a longer limit only hides it.",
    "config": "Install the missing module or correct the setting that is named.",
    "test_bug": "Reproduce the failing test alone and file it with its owner.",
    "infra": "Look at provisioning, package sources and node health.",
    "permission": "Compare credentials, keys and capabilities with what the job needs.",
    "resource": "Look at memory and disk use of the nodes at the time of failure.",
    "unknown": "Read the raw log around its last error lines.",
}
