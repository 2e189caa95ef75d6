"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and hex runs. Candidates in base64 or hex are then decoded and
their structure is parsed before they are reported: DER keys by nested lengths and the types of their
parts, armoured keys by the DER (or OpenSSH) body within, signed tokens by their JSON header and payload.

Kinds, in order: assign, access, hex (base); pem, der, hexder, openssh, jwt (confirmed).
Defined cases: null text is the empty text, which has no spans; texts of any length are read whole;
repeated rows are scanned one by one; an empty table gives no rows. Spans that start at one place are listed in the order of
kinds. Columns of other names are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillmark.llm._ids import mapped

KINDS = ("assign", "access", "hex", "pem", "der", "hexder", "openssh", "jwt")

#: The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{48,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----")
_OPENSSH = b"openssh-key-v1\0"


def parts(der: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill ``der`` exactly, or None where lengths don't nest."""
    end = len(der) if end is None else end
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = der[at], der[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(der[at : at + k], "big"), at + k
            if n < 0x80:
                return None  # not the shortest form
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_key(der: bytes) -> bool:
    """Whether bytes are one DER sequence shaped like a private key: PKCS#8 (plain or encrypted), PKCS#1, DSA or SEC 1."""
    top = parts(der)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = parts(der, *top[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    algorithm = lambda x: (p := parts(der, x[1], x[2])) is not None and bool(p) and p[0][0] == 0x06 and p[0][2] > p[0][1]
    if tags[0] == 0x02:
        version = der[inner[0][1] : inner[0][2]]
        if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04] and algorithm(inner[1]):
            return True
        if version in (b"\0", b"\1") and len(tags) in (6, 9, 10) and all(t in (0x02, 0x30) for t in tags):
            return True
        return version == b"\1" and tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [0x30, 0x04] and algorithm(inner[0]) and inner[1][2] - inner[1][1] >= 16


def _decoded(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(s: str) -> dict | None:
    raw = _decoded(s)
    try:
        got = json.loads(raw.decode("utf-8")) if raw else None
    except (UnicodeDecodeError, ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of candidates whose decoded structure is that of a key or signed token."""
    out = []
    if "-----BEGIN " in text:
        for m in _BEGIN.finditer(text):
            stop = text.find(f"-----END {m[1]}-----", m.end())
            if stop >= 0:
                body = "".join(x.strip() for x in text[m.end() : stop].replace("\\n", "\n").split("\n") if ":" not in x)
                raw = _decoded(body)
                if raw and (is_key(raw) or raw.startswith(_OPENSSH)):
                    out.append((m.start(), 3, stop + len(m[1]) + 14))
    for m in _RUN.finditer(text):
        raw = _decoded(m[0])
        if raw and raw[0] == 0x30 and is_key(raw):
            out.append((m.start(), 4, m.end()))
        elif raw and raw.startswith(_OPENSSH):
            out.append((m.start(), 6, m.end()))
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and m[0].startswith("30") and is_key(bytes.fromhex(m[0])):
            out.append((m.start(), 5, m.end()))
    if "." in text and ("ey" in text or "ew" in text):
        for m in _TOKEN.finditer(text):
            header = _json_object(m[1])
            if header and isinstance(header.get("alg"), str) and _json_object(m[2]) is not None:
                out.append((m.start(), 7, m.end()))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed) of every row of ``docs``."""

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for t in pdf["text"]:
                t = t if isinstance(t, str) else ""
                base, more = base_spans(t), confirmed_spans(t)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])], axis=1)

    return mapped(docs.select("doc_id", "text"), each, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
