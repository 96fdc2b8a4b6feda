"""Secret scans with multipart credential linking.

Base spans come from three patterns: keyword assignments, access key ids and long hexadecimal runs. Beside them, parts of
credentials are looked for: identifiers (named ones, and mail addresses), opaque strings and endpoints (addresses with a
scheme, named hosts and IPv4 addresses). Each such part is weak on its own and is reported only if a complementary part stands
in its scope: within SCOPE code points, in the same paragraph, and not overlapping. An identifier needs a secret (a base one
or an opaque string), an opaque string needs an identifier (an access key id counts as one), and an endpoint needs a base secret
or an opaque string that is linked. The parts of a text are joined as intervals: both sides in order, a binary search for the
neighbour before and after.

A null or empty text has no spans. Positions are code points, the end exclusive. Texts and parts are taken whole, whatever
their length, and every pattern scans in linear time. Repeated rows give repeated results; columns other than key and text are
not read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts

#: Code points between linked parts, at most.
SCOPE = 160
#: Kinds in the order in which they are listed; the method's own follow the base ones.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
_KEYWORDS = ("passw", "secret", "token", "api")
_IDENTIFIER = re.compile(r"""\b(?:user(?:_?(?:name|id))?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id|tenant(?:_?id)?)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9@._-]{3,}+)""", re.A | re.I)
_ID_WORDS = ("user", "login", "account", "client", "access", "key", "tenant")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", re.A)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_-])", re.A)
_ENDPOINT = re.compile(r"""\b(?:https?|ftp|sftp|ssh|jdbc:[a-z]{2,}+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]++|\b(?:host|endpoint|server|url)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9.-]{3,}+(?::[0-9]++)?)""", re.A | re.I)
_BREAK = re.compile(r"\n[ \t\r]*+\n")
_ADDRESS = re.compile(r"(?<![0-9.])(?:[0-9]++\.){3}[0-9]++(?::[0-9]++)?(?![0-9.])", re.A)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _opaque(s: str) -> bool:
    """Whether a string looks random: letters of both cases and digits, and enough entropy."""
    if not (re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s)):
        return False
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= 3.0


def _ipv4(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in s.partition(":")[0].split("."))


def parts_of(text: str, base: list[tuple[str, int, int]]) -> tuple[list, list, list]:
    """Weak parts of a text: identifiers, opaque strings and endpoints, without those that overlap a base span."""
    taken = sorted((a, b) for _, a, b in base)
    return tuple([(kind, *s) for s in _free(find(text), taken)] for kind, find in (("identifier", _identifiers), ("opaque", _opaques), ("endpoint", _endpoints)))


def _identifiers(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    named = [m.span(1) for m in _IDENTIFIER.finditer(text)] if any(w in low for w in _ID_WORDS) and ("=" in text or ":" in text) else []
    return _union(named, [m.span() for m in _MAIL.finditer(text)]) if "@" in text else named


def _opaques(text: str) -> list[tuple[int, int]]:
    if not any(len(w) >= 16 and not w.isalpha() for w in text.split()):
        return []
    return [m.span() for m in _OPAQUE.finditer(text) if _opaque(m[0])]


def _endpoints(text: str) -> list[tuple[int, int]]:
    return _union([m.span(1 if m[1] else 0) for m in _ENDPOINT.finditer(text)], [m.span() for m in _ADDRESS.finditer(text) if _ipv4(m[0])])


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of those taken (in order of their starts)."""
    starts = [a for a, _ in taken]
    reach, most = [], 0
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    out = []
    for a, b in spans:
        i = bisect.bisect_left(starts, b)  # those that start before the end of this one
        if not i or reach[i - 1] <= a:
            out.append((a, b))
    return out


def _union(first: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted(first + _free(more, sorted(first)))


def joined(left: list, right: list, breaks: list[int], scope: int) -> list:
    """Members of left with one of right in their scope: an interval join by the nearest end before and the nearest start after."""
    starts, ends = sorted(s[1] for s in right), sorted(s[2] for s in right)
    out = []
    for s in left:
        i, j = bisect.bisect_right(ends, s[1]), bisect.bisect_left(starts, s[2])
        # the nearest part is in the same paragraph if any is: parts hold no line breaks
        before = i and s[1] - ends[i - 1] <= scope and bisect.bisect_left(breaks, ends[i - 1]) == bisect.bisect_left(breaks, s[1])
        after = j < len(starts) and starts[j] - s[2] <= scope and bisect.bisect_left(breaks, s[2]) == bisect.bisect_left(breaks, starts[j])
        if before or after:
            out.append(s)
    return out


def linked_spans(text: str, base: list[tuple[str, int, int]], scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """Weak parts whose complementary parts stand in their scope."""
    strong = [s for s in base if s[0] in ("assign", "hex")]
    if not strong and not _opaques(text):  # nothing that could be a secret, and so nothing that goes with one
        return []
    ids, opaque, ends = parts_of(text, base)
    breaks = [m.start() for m in _BREAK.finditer(text)]
    named = ids + [s for s in base if s[0] == "access"]
    weak = joined(opaque, named, breaks, scope)
    return joined(ids, strong + opaque, breaks, scope) + weak + joined(ends, strong + weak, breaks, scope)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, and the union of overlapping ones, replaced by the first one's kind in brackets."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{k.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE, redacted: bool = False) -> DataFrame:
    """key, counts by base kind, n_linked, base_sha256 and spans (and the redacted text) of each row. One pass, no shuffle."""

    def make():
        def apply(texts: list) -> list:
            cols: list[list] = [[] for _ in range(7 if redacted else 6)]
            for t in texts:
                base = base_spans(t) if t else []
                more = linked_spans(t, base, scope) if t else []
                n = Counter(s[0] for s in base)
                row = [n["assign"], n["access"], n["hex"], len(more), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)]
                if redacted:
                    row.append(None if t is None else redact(t, base + more))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return cols

        return apply

    return map_texts(documents, [key], text, make, "n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string" + ", redacted string" * redacted)
