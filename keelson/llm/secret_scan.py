"""Operator 4: secret scan with structural confirmation.

Pattern spans (``assign``, ``access``, ``hex``) are the base.  On top, every base64
or hexadecimal run of a text is decoded and parsed, and is reported only when its
bytes have the structure of a secret:

* ``der``: one ASN.1 SEQUENCE whose nested lengths fill it exactly and which starts
  like a private key (a version INTEGER);
* ``ssh``: the OpenSSH private key magic followed by length-prefixed strings;
* ``sshpub``: length-prefixed fields that begin with a key type name;
* ``jwt``: three base64url parts, the first a JSON object with ``alg``, the second
  a JSON object;
* ``pem``: a BEGIN/END PRIVATE KEY block whose body decodes to ``der`` or ``ssh``, to an
  encrypted key (algorithm SEQUENCE, OCTET STRING), or to anything if its header lines say
  that it is encrypted.

All of it runs map-side on whole texts (no shuffle, no limit) in time linear in the text:
a run of coded characters is entered at its left border only.  Offsets are code points,
ends exclusive.

Defined results: a null text counts as empty (no spans); null or repeated
``doc_id``s are scanned row by row; a very long text, unbroken or not, is scanned whole;
an empty table gives an empty table; other input
columns are kept and result columns win over equal names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.shared import runs

#: The base patterns and the least length of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
# A run that is long enough is the same match with or without the shorter ones beside it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Bytes of text whose results a worker holds at a time.
RUN_BYTES = 2_000_000

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "ssh", "sshpub", "jwt", "pem")

CODED = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:={0,2})(?:\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*)?")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
BLOCK = re.compile(
    r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----((?:\s*+(?:Proc-Type|DEK-Info): ?[^\n\\]{0,200}(?:\n|\\n))*)"
    r"([A-Za-z0-9+/=\s\\]{16,}?)-----END \1PRIVATE KEY-----"
)
HEX_RUN = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")

SSH_MAGIC = b"openssh-key-v1\0"
SSH_TYPES = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp(256|384|521)|sk-ssh-ed25519@openssh\.com)$")


def unbase64(s: str) -> bytes | None:
    """The bytes of a base64 or base64url string, or None."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the ASN.1 item at ``at``, or None if it does not fit."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
    return (tag, at, at + n) if at + n <= end else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills ``data``, holds a version INTEGER first and at least two
    items in all, every one with a length that fits, constructed ones parsed too."""
    top = der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    first = der_item(data, top[1], top[2])
    if first is None or first[0] != 0x02 or first[2] - first[1] != 1 or data[first[1]] > 1:
        return False
    todo, items = [(top[1], top[2])], 0
    while todo:
        at, end = todo.pop()
        while at < end:
            item = der_item(data, at, end)
            if item is None:
                return False
            if item[0] & 0x20:
                todo.append(item[1:])
            at, items = item[2], items + 1
    return items >= 3


def is_sealed_key(data: bytes) -> bool:
    """A SEQUENCE that fills ``data`` with just an algorithm (a SEQUENCE that begins with an OID) and an OCTET STRING."""
    top = der_item(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    kind = der_item(data, top[1], top[2])
    if kind is None or kind[0] != 0x30 or data[kind[1] : kind[1] + 1] != b"\x06":
        return False
    rest = der_item(data, kind[2], top[2])
    return rest is not None and rest[0] == 0x04 and rest[2] == top[2]


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed strings that fill ``data``, or None."""
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return None
        fields.append(data[at - n : at])
    return fields


def is_ssh_key(data: bytes) -> bool:
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation and its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def structure(data: bytes | None) -> str | None:
    """The kind of secret that decoded bytes are, or None."""
    if not data or len(data) < 16:
        return None
    if data[0] == 0x30 and is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if data[:3] == b"\0\0\0":
        fields = ssh_fields(data)
        if fields and len(fields) >= 2 and SSH_TYPES.match(fields[0]):
            return "sshpub"
    return None


def is_signed_token(s: str) -> bool:
    parts = s.split(".")
    if len(parts) != 3:
        return False
    try:
        head, body = (json.loads(unbase64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the method adds: candidates whose decoded form parses."""
    spans = []
    for m in CODED.finditer(text):
        run = m[0].split(".")[0]
        kind = structure(unbase64(run))
        if kind is None and HEX_RUN.fullmatch(run):
            kind = structure(bytes.fromhex(run))
        if kind:
            spans.append((m.start(), m.start() + len(run), kind))
    if "." in text:
        spans += [(m.start(), m.end(), "jwt") for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    if "PRIVATE KEY-----" in text:
        for m in BLOCK.finditer(text):
            body = m[3].replace("\\r", "").replace("\\n", "")
            data = unbase64("".join(body.split()).replace("\\", ""))
            sealed = "Proc-Type" in m[2] and "ENCRYPTED" in m[2] and bool(data)
            if sealed or structure(data) in ("der", "ssh") or (data and is_sealed_key(data)):
                spans.append((m.start(), m.end(), "pem"))
    return spans


ORDER = {k: i for i, k in enumerate(KINDS)}


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in in_order(spans))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with every maximal run of spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


FIELDS = (
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("redacted", T.StringType()),
)


def scan(docs: DataFrame, text: str = "text", redacted: bool = True) -> DataFrame:
    """``docs`` with the counts of base spans, ``base_spans`` and ``spans`` (comma-joined
    kind:start:end) and, if asked for, ``redacted``: the text with all spans masked."""
    fields = FIELDS if redacted else FIELDS[:-1]
    own = [c for c in docs.columns if c not in {f.name for f in fields}]
    if redacted and text in own:  # the text goes to the worker once
        scanned, source = text, docs.select(*(F.col(f"`{c}`") for c in own))
    else:
        scanned, source = "__text", docs.select(*(F.col(f"`{c}`") for c in own if c != text), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, *fields])

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in runs(whole, scanned, RUN_BYTES)):
            rows = []
            for value in batch.column(scanned):
                t = value.as_py() or ""
                base = base_spans(t)
                spans = base + confirmed_spans(t)
                counts = [sum(k == kind for *_, k in base) for kind in BASE_KINDS]
                rows.append((*counts, joined(base), joined(spans), *([redact(t, spans)] if redacted else [])))
            kept = [n for n in batch.schema.names if n != "__text"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], [*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def secret_report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), redacted=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
