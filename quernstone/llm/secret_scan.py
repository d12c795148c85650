"""Secret scans with structural confirmation.

Base patterns find assignments, access key ids and long hex runs. Beside them, runs of base64 or hex characters and dotted
tokens are decoded and reported only if their inside proves them:
  jwt  a signed token: the first part decodes to a JSON object that names an algorithm other than none, the second to a
       JSON object, and there is a signature that decodes too;
  der  base64 or hex of a private key in DER: nested lengths that fit exactly, a version number where each form has it, an
       encryption by password where the key is encrypted, and inside PKCS #8 the key that its algorithm asks for;
  ssh  base64 of an OpenSSH private key: its magic, then length-prefixed cipher, key derivation and a key count.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_jwt = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Characters of base64; five dashes are the rule of a PEM header or footer, even on the line of the key itself.
_char = r"(?:[A-Za-z0-9+/_]|-(?!----))"
#: A line break, or one that is escaped as in JSON, once or more.
_newline = r"(?:\r?\n|(?:\\+r)?\\+n)"
_break, _line, _lines = re.compile(_newline), re.compile(f"{_char}+"), re.compile(rf"{_char}+(?:{_newline}[A-Za-z0-9+/]{{4,}})*(?:{_newline}[A-Za-z0-9+/]{{2,3}}(?==))?={{0,2}}")
#: A sequence's tag and length in base64, wherever it stands. 40 characters are 30 bytes, fewer than any private key has.
_sequence = re.compile(r"M(?=(?:[A-H]|I[G-T])[A-Za-z0-9+/_-]{38})")
_magic = re.compile(r"b3BlbnNzaC1rZXktdjEA(?=[A-Za-z0-9+/_-]{20})")
_hexed = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
_quick = ("passw", "secret", "token", "api")


def _base64(text: str) -> bytes | None:
    body = _break.sub("", text).replace("=", "").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at `at`, if its length fits before `end` and is in the shortest form."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements from at to end, if they fill it exactly."""
    out = []
    while at < end:
        if (e := tlv(data, at, end)) is None:
            return None
        out.append(e)
        at = e[2]
    return out


#: Object identifiers, as the bytes that DER has for them; fixed values.
RSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
INTEGER_KEYS = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))  # DSA, Diffie-Hellman
CURVE_KEYS = tuple(bytes.fromhex(x) for x in ("2b656e", "2b656f", "2b6570", "2b6571"))  # X25519, X448, Ed25519, Ed448
PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # PKCS #5 and PKCS #12 encryption, by their beginning


def _whole(data: bytes, tag: int) -> list[tuple[int, int, int]] | None:
    """The elements inside data, if it is one element of this tag."""
    top = tlv(data, 0, len(data))
    return elements(data, top[1], top[2]) if top and top[0] == tag and top[2] == len(data) else None


def _algorithm(data: bytes, at: tuple[int, int, int]) -> bytes | None:
    """The object identifier that an algorithm's sequence begins with."""
    kinds = elements(data, *at[1:])
    return data[kinds[0][1] : kinds[0][2]] if kinds and kinds[0][0] == 0x06 and len(kinds) <= 2 else None


def is_pkcs1(data: bytes) -> bool:
    """An RSA key: a version of 0 or 1 and eight integers."""
    inside = _whole(data, 0x30)
    return bool(inside) and len(inside) >= 9 and {t for t, _, _ in inside[:9]} == {0x02} and data[inside[0][1] : inside[0][2]] in (b"\0", b"\1")


def is_sec1(data: bytes) -> bool:
    """An elliptic-curve key: version 1, octets, and nothing but the curve and the public key after them."""
    inside = _whole(data, 0x30)
    return bool(inside) and len(inside) >= 2 and inside[0][0] == 0x02 and data[inside[0][1] : inside[0][2]] == b"\1" and inside[1][0] == 0x04 and all(t in (0xA0, 0xA1) for t, _, _ in inside[2:])


def is_pkcs8(data: bytes) -> bool:
    """A version of 0 or 1, an algorithm, and octets that hold that algorithm's key; of other algorithms any octets do."""
    inside = _whole(data, 0x30)
    if not inside or [t for t, _, _ in inside[:3]] != [0x02, 0x30, 0x04] or data[inside[0][1] : inside[0][2]] not in (b"\0", b"\1"):
        return False
    key = data[inside[2][1] : inside[2][2]]
    kind = _algorithm(data, inside[1])
    if kind is None:
        return False
    if kind == RSA:
        return is_pkcs1(key)
    if kind == EC:
        return is_sec1(key)
    if kind in INTEGER_KEYS or kind in CURVE_KEYS:
        inner = tlv(key, 0, len(key))
        return bool(inner) and inner[0] == (0x02 if kind in INTEGER_KEYS else 0x04) and inner[2] == len(key)
    return bool(key)


def is_encrypted(data: bytes) -> bool:
    """Encrypted PKCS #8: an encryption by password, and octets. Other algorithms in this place are a plain digest."""
    inside = _whole(data, 0x30)
    if not inside or [t for t, _, _ in inside] != [0x30, 0x04]:
        return False
    kind = _algorithm(data, inside[0])
    return kind is not None and kind.startswith(PASSWORD)


def is_private_der(data: bytes) -> bool:
    """PKCS #1, PKCS #8, SEC 1 or encrypted PKCS #8, in one sequence that is the whole of data."""
    return is_pkcs8(data) or is_pkcs1(data) or is_sec1(data) or is_encrypted(data)


def _der_end(text: str, start: int) -> int:
    """Where the base64 of a private key in DER that begins at start ends, padding included; 0 if none does, if it is cut
    short or if its last line goes on."""
    head = _base64(text[start : start + 16])
    n = head[1] & 0x7F if head and head[1] & 0x80 else 0
    if head is None or head[0] != 0x30 or n > 4:
        return 0
    # a version of 0 or 1, or an algorithm
    if not (head[2 + n : 4 + n] == b"\x02\x01" and head[4 + n] <= 1 or head[2 + n] == 0x30):
        return 0
    need = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    left, at, found = -(-need * 4 // 3), start, []
    while True:
        if not (m := _line.match(text, at, at + left + 5)):  # 5 more, to see five dashes
            return 0
        found.append(m[0][:left])
        left, at = left - len(found[-1]), at + len(found[-1])
        if not left:
            break
        if not (m := _break.match(text, at)):
            return 0
        at = m.end()
    end = at
    while end < at + 2 and text[end : end + 1] == "=":
        end += 1
    if end == at and _line.match(text, at, at + 5):
        return 0
    data = _base64("".join(found))
    return end if data is not None and is_private_der(data) else 0


def is_private_ssh(data: bytes) -> bool:
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15
    for _ in range(3):  # cipher, key derivation and its options
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at + 4 > len(data):
            return False
    return 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def _json(part: str):
    raw = _base64(part)
    try:
        return json.loads(raw) if raw is not None else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None


def is_token(text: str) -> bool:
    head, body, signature = text.split(".", 2)
    h = _json(head)
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and h["alg"].lower() != "none" and isinstance(_json(body), dict) and bool(_base64(signature))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(x in low for x in _quick):
        out += [("assign", *m.span()) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", *m.span()) for m in _access.finditer(text)]
    out += [("hex", *m.span()) for m in _hex.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _jwt.finditer(text) if is_token(m[0])]
    past = 0  # the end of the last key, as keys hold sequences too
    for m in _sequence.finditer(text):
        if m.start() >= past and (end := _der_end(text, m.start())):
            out.append(("der", m.start(), end))
            past = end
    past = 0
    for m in _magic.finditer(text):
        if m.start() < past:
            continue
        for pattern in (_lines, _line):  # what stands on the next line may be plain text
            run = pattern.match(text, m.start())
            if (data := _base64(run[0])) is not None and is_private_ssh(data):
                out.append(("ssh", *run.span()))
                past = run.end()
                break
    for m in _hexed.finditer(text):
        if m[0].startswith("30") and is_private_der(bytes.fromhex(m[0])):
            out.append(("der", *m.span()))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, spans: array of (kind, start, end) in code points, end exclusive, by start and
    kind. A null text counts as empty; repeated rows give repeated results;
    other columns are left out. Nothing is exchanged."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [ordered(base_spans(t) + confirmed_spans(t)) for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(find, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str | None) -> str | None:
    """text with each group of overlapping spans replaced by [SECRET]."""
    if not text or not (spans := ordered(base_spans(text) + confirmed_spans(text))):
        return text
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            out += [text[at if end < 0 else end : a], "[SECRET]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced by [SECRET], and n_chars, where there is one, set anew; null texts stay null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(redact)

    out = docs.withColumn("text", clean.asNondeterministic()("text"))  # else n_chars would redact once more
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
