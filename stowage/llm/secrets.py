"""Secret scans: strong patterns on their own, weak ones only where complementary parts co-occur in a scope.

Strong spans are three patterns. The parts of a credential (access identifier, secret, endpoint) are matched more
loosely as well (by the key words of a name, whatever stands before and after them), and are interval-joined with the text's scopes: blocks of lines between blank lines or bracketed
section heads. A weak part is reported only with what completes it in the same scope: an identifier with a secret, a
secret with an identifier or an endpoint, an endpoint with both.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import slices

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run of the same characters holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")

#: A whole name before a value, with what stands around its key words, and the words of a name.
NAMED = re.compile(r"""(?<![A-Za-z0-9_.-])[_.-]*+([A-Za-z0-9_.-]++)["']?\x20*[:=]\x20*["']?""")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: The last key word of a name, its words joined by "_", says what the value is.
KEY_WORDS = re.compile(
    r"(?<![a-z])(?:db|pg|my|sql|smtp|imap|mail|ftp|ssh|aws|app|admin|root|ldap|redis|mongo)?"
    r"(?:(?P<weak_secret>(?:secret|private|signing|encryption|master)_?(?:access_?)?key(?!_?id)|pass(?:_?phrase|_?code|word|wd)?|pwd|pin|auth|credentials?|secret|token)"
    r"|(?P<weak_id>user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)"
    r"|(?P<endpoint>host(?:_?name)?|server|endpoint|base_?url)|(?P<key>key))(?![a-z])"
)
#: After a key word these name something about a part, not the part.
ABOUT = re.compile(r"(?<![a-z])(?:agent|type|count|rate|limit|size|len|length|port|file|path|dir|time|timeout|expiry|expires|ttl|format|mode|version|status|policy|required|enabled|min|max|group|role|list|label|prefix|suffix)s?(?![a-z])")
ASSIGN_END = re.compile(r"(?:password|passwd|secret|token|api_?key)$")  # ASSIGN alone decides on these
VALUES = {3: re.compile(r"[A-Za-z0-9._@-]{3,}"), 4: re.compile(r"[A-Za-z0-9+/_.=-]{4,}"), 5: re.compile(r"[A-Za-z0-9._:/-]{3,}")}
URL = re.compile(r"(?a:\b(?i:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s\"'<>]+)")
SCOPE_END = re.compile(r"\n[ \t]*(?:\n|\[[^\]\n]*\][ \t]*(?:\n|$))")

#: What a text must hold in some case for a pattern to match at all.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
WEAK_WORDS = ("user", "login", "account", "client", "key", "pass", "pwd", "pin", "auth", "credential", "secret", "token", "host", "server", "endpoint", "base")
IS_HEX = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kind by place in KINDS; per kind the leftmost non-overlapping matches, short ones dropped."""
    found, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"x" * 24 in text.encode(errors="replace").translate(IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def kind_of(name: str) -> int | None:
    """What a value of this name is, by place in KINDS."""
    if ASSIGN_END.search(name.lower()):
        return None
    words, last = "_".join(NAME_WORDS.findall(name)).lower(), None
    for last in KEY_WORDS.finditer(words):
        pass
    if last is None or ABOUT.search(words, last.end()):
        return None
    return KINDS.index("weak_secret" if last.lastgroup == "key" else last.lastgroup)


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """Parts as (start, kind, end), none beside its complement yet; those of a kind do not overlap."""
    low, parts, reach = text.lower(), [], [0] * len(KINDS)
    if any(w in low for w in WEAK_WORDS):
        for m in NAMED.finditer(text):
            kind = kind_of(m[1])
            value = kind and VALUES[kind].match(text, m.end())
            if value and m.start(1) >= reach[kind]:
                reach[kind] = value.end()
                parts.append((m.start(1), kind, value.end()))
    if "://" in text:
        hosts, at = [p for p in parts if p[1] == 5], 0
        for m in URL.finditer(text):
            while at < len(hosts) and hosts[at][2] <= m.start():
                at += 1
            if at == len(hosts) or hosts[at][0] > m.start():
                parts.append((m.start(), 5, m.end()))
    return sorted(parts)


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that their scope completes, as (start, kind, end); none overlaps a strong span."""
    if "=" not in text and ":" not in text:
        return []
    parts = weak_parts(text)
    if not parts:
        return []
    # Both lists ascend by start and strong spans of all kinds may nest, so the furthest end so far decides.
    free, at, reach = [], 0, -1
    for part in parts:
        while at < len(strong) and strong[at][0] < part[2]:
            reach = max(reach, strong[at][2])
            at += 1
        if reach <= part[0]:
            free.append(part)
    ends = [m.start() + 1 for m in SCOPE_END.finditer(text)] + [len(text) + 1]
    out, k, every = [], 0, sorted(strong + free)
    for end in ends:
        inside = []
        while k < len(every) and every[k][0] < end:
            inside.append(every[k])
            k += 1
        kinds = {p[1] for p in inside}
        has_id, has_secret, has_endpoint = bool(kinds & {1, 3}), bool(kinds & {0, 2, 4}), 5 in kinds
        reported = {3: has_secret, 4: has_id or has_endpoint, 5: has_id and has_secret}
        out += [p for p in inside if reported.get(p[1])]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): a row for each row; code points, ends exclusive.

    ``spans`` lists strong and completed weak spans by start, then kind. A null text is empty; empty texts have none.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches, 512):
            counts, digest, spans = ([], [], []), [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                strong = strong_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in strong))
                digest.append(hashlib.sha256(listed(strong).encode()).hexdigest())
                spans.append(listed(strong + weak_spans(text, strong)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
