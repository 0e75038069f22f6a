"""Secret scan with structural confirmation (operator 2).

Base patterns find assignments, access keys and hex runs.  Structural confirmation then decodes
base64 and hex candidates and reports those that parse: DER private keys (nested lengths must fill
one another exactly), OpenSSH key files (nested length-prefixed strings) and signed tokens
(JSON header that names an algorithm, JSON payload).

Defined cases: a null or empty text has no spans (its digest is that of the empty string); repeated
rows give repeated results; text is scanned whole, whatever its length; a null doc_id passes through.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelens.llm.common import utf8

KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_der_key long, n_ssh_key long, n_signed_token long")

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A header begins with a brace and a quote, a blank or a line break.
TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
TOKEN_START = re.compile(rb"e[wy][A-Za-z0-9_-]+\.")
#: Line breaks inside encoded text: real ones, escaped ones (JSON, source text) and those between joined literals.
BREAK = rb"""(?:(?:\\+r)?\\+n(?:["'][\x20\t]*\+?[\x20\t]*\r?\n[\x20\t]*["'])?|\r?\n)[\x20\t]*"""
#: Base64 text over one or more lines; an encoded key is never shorter than 40 characters in its first line.
BASE64_LINES = re.compile(rb"[A-Za-z0-9+/]{40,}(?:" + BREAK + rb"[A-Za-z0-9+/]+)*")
BASE64_PIECE = re.compile(rb"(?:" + BREAK + rb")?([A-Za-z0-9+/]+)")
#: How a DER sequence, an OpenSSH key and a PEM file start in base64, at any place of a run.
KEY_START = re.compile(rb"M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi")
HEX_ANY = re.compile(rb"[0-9a-fA-F]{64,}")
MIN_BASE64 = 40
SSH_MAGIC = b"openssh-key-v1\0"

_HEX, _B64 = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_B64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = True


def long_runs(data: np.ndarray, members: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` member bytes inside one document."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = members[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    out: list[tuple[int, int]] = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        cut = offsets[np.searchsorted(offsets, s, "right"):np.searchsorted(offsets, e, "left")].tolist()
        edge = [s, *cut, e]
        out += [(a, b) for a, b in zip(edge, edge[1:]) if b - a >= least]
    return np.array([a for a, _ in out], np.int64), np.array([b for _, b in out], np.int64)


def der_items(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill raw[at:end] exactly, else None."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end or raw[at] == 0:
                return None
            n, at = int.from_bytes(raw[at:at + width], "big"), at + width
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def der_length(raw: bytes) -> int | None:
    """Bytes of the outermost DER sequence at the start of raw, header included."""
    if len(raw) < 2 or raw[0] != 0x30:
        return None
    n = raw[1]
    if n < 0x80:
        return 2 + n
    width = n & 0x7F
    if not 1 <= width <= 4 or len(raw) < 2 + width or raw[2] == 0:
        return None
    return 2 + width + int.from_bytes(raw[2:2 + width], "big")


def is_private_key(raw: bytes) -> bool:
    """A DER private key: PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8, with consistent nested lengths."""
    outer = der_items(raw, 0, len(raw))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(raw, outer[0][1], outer[0][2])
    if not items or any(b == a and t in (0x02, 0x04, 0x06, 0x30) for t, a, b in items):
        return False
    tags = [t for t, _, _ in items]
    whole = lambda i: int.from_bytes(raw[items[i][1]:items[i][2]], "big")

    def starts_with_oid(i: int) -> bool:
        inner = der_items(raw, items[i][1], items[i][2])
        return bool(inner) and inner[0][0] == 0x06

    if tags[0] == 0x02 and whole(0) <= 1:
        if len(tags) in (9, 10) and tags[:9] == [0x02] * 9:
            return whole(1) == whole(4) * whole(5)  # modulus and its two primes
        if tags == [0x02] * 6 and whole(0) == 0:
            return whole(1).bit_length() >= 512
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and starts_with_oid(1):
            return True
        return whole(0) == 1 and tags[1:2] == [0x04] and set(tags[2:]) <= {0xA0, 0xA1} and items[1][2] - items[1][1] >= 16
    return tags == [0x30, 0x04] and starts_with_oid(0) and items[1][2] - items[1][1] >= 16


def ssh_length(raw: bytes) -> int | None:
    """Bytes of an OpenSSH private key at the start of raw: every nested string must fit."""
    if not raw.startswith(SSH_MAGIC):
        return None
    at = len(SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(raw):
            return None
        n = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n:at]

    if any(string() is None for _ in range(3)) or at + 4 > len(raw):
        return None
    keys, at = int.from_bytes(raw[at:at + 4], "big"), at + 4
    if not 1 <= keys <= 1024:
        return None
    for _ in range(keys):
        public = string()
        if public is None or len(public) < 8 or int.from_bytes(public[:4], "big") > len(public) - 4:
            return None
    return at if string() else None


def is_signed_token(token: bytes) -> bool:
    """Header and payload are JSON objects, the header names its algorithm."""
    head, body, sign = token.split(b".")
    parsed = []
    for part in (head, body):
        if len(part) % 4 == 1:
            return False
        try:
            value = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        parsed.append(value)
    alg = parsed[0].get("alg")
    return isinstance(alg, str) and bool(alg) and (bool(sign) or alg.lower() == "none")


def _decoded(body: bytes) -> bytes:
    return binascii.a2b_base64(body + b"A" * (-len(body) % 4))[:len(body) * 3 // 4]


def _der_may_start(head: bytes, room: int) -> int | None:
    """Bytes of a DER sequence that starts with ``head``, if it fits and its first value may be a key's."""
    n = der_length(head)
    if n is None or n > room:
        return None
    first = 2 if head[1] < 0x80 else 2 + (head[1] & 0x7F)
    return n if head[first:first + 1] in (b"\x02", b"\x30") else None


def _keys_in_base64(body: bytes, nested: bool) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of the keys in base64 text without breaks, wherever they start."""
    at = 0
    while m := KEY_START.search(body, at):
        p = at = m.start()
        at += 1
        if body[p] == 0x4D:
            n = _der_may_start(_decoded(body[p:p + 12]), (len(body) - p) * 3 // 4)
            if n and is_private_key(_decoded(body[p:p + -(-n * 4 // 3)])[:n]):
                at = p + -(-n * 4 // 3)
                yield p, "der_key", at
        elif body[p] == 0x62:
            if n := ssh_length(_decoded(body[p:])):
                at = p + -(-n * 4 // 3)
                yield p, "ssh_key", at
        elif not nested:  # a whole PEM file in base64
            for s, kind, e in _base64_keys(_decoded(body[p:]), True):
                at = p + -(-e * 4 // 3)
                yield p + s * 4 // 3, kind, at


def _base64_keys(doc: bytes, nested: bool = False) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) in bytes of doc."""
    for m in BASE64_LINES.finditer(doc):
        pieces = [x.span(1) for x in BASE64_PIECE.finditer(doc, m.start(), m.end())]
        sums = np.concatenate([[0], np.cumsum([b - a for a, b in pieces])]).tolist()

        def place(k: int) -> int:
            i = bisect.bisect_right(sums, k) - 1
            return pieces[i][0] + k - sums[i]

        for s, kind, e in _keys_in_base64(b"".join(doc[a:b] for a, b in pieces), nested):
            end = place(e - 1) + 1
            while doc[end:end + 1] == b"=":
                end += 1
            yield place(s), kind, end


def confirmed(doc: bytes, has_base64: bool) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in bytes of what decodes to a key or token."""
    found = []
    if TOKEN_START.search(doc):
        found += [(m.start(), 5, m.end()) for m in TOKEN.finditer(doc) if is_signed_token(m[0])]
    if not has_base64:  # hexadecimal digits of either case are base64 characters too
        return found
    found += [(s, KINDS.index(kind), e) for s, kind, e in _base64_keys(doc)]
    for m in HEX_ANY.finditer(doc):
        at = doc.find(b"30", m.start(), m.end())
        while at >= 0:
            room = (m.end() - at) // 2
            n = _der_may_start(bytes.fromhex(doc[at:at + 2 * min(room, 9)].decode()), room)
            if n and is_private_key(bytes.fromhex(doc[at:at + 2 * n].decode())):
                found.append((at, 3, at + 2 * n))
                at += 2 * n - 1
            at = doc.find(b"30", at + 1, m.end())
    return found


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        data, offsets, _ = utf8(batch.column(1))
        n = batch.num_rows
        starts, ends = long_runs(data, _HEX, offsets, MIN_HEX)
        hexes: dict[int, list[tuple[int, int]]] = {}
        for d, s, e in zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
            hexes.setdefault(d, []).append((s - int(offsets[d]), e - int(offsets[d])))
        runs, _ = long_runs(data, _B64, offsets, MIN_BASE64)
        base64_docs = set((np.searchsorted(offsets, runs, "right") - 1).tolist())
        marks = np.flatnonzero((data == 0x3A) | (data == 0x3D))
        marked = set(np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist())
        whole = data.tobytes()
        rare = {int(np.searchsorted(offsets, m.start(), "right") - 1) for m in re.finditer(rb"AKIA|e[wy][A-Za-z0-9_-]+\.", whole)}
        counts = np.zeros((6, n), np.int64)
        digest, text = [empty] * n, [""] * n
        for d in sorted(marked | rare | base64_docs | set(hexes)):
            doc = whole[offsets[d]:offsets[d + 1]]
            base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(doc) if len(m[2]) >= MIN_ASSIGN] if d in marked else []
            if d in rare:
                base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(doc) if len(m[0]) >= MIN_ACCESS]
            base += [(s, 2, e) for s, e in hexes.get(d, [])]
            spans = sorted(set(base + confirmed(doc, d in base64_docs)))
            if not spans:
                continue
            point = np.concatenate([[0], np.cumsum((np.frombuffer(doc, np.uint8) & 0xC0) != 0x80)])
            said = [(k, f"{KINDS[k]}:{point[s]}:{point[e]}") for s, k, e in spans]
            digest[d] = hashlib.sha256(",".join(x for k, x in said if k < 3).encode()).hexdigest()
            text[d] = ",".join(x for _, x in said)
            for k, _ in said:
                counts[k, d] += 1
        columns = [batch.column(0).cast(pa.int64()), *counts[:3], digest, text, *counts[3:]]
        yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans, all spans (kind:start:end, code points)."""
    return docs.select(id_col, text_col).mapInArrow(scan_batches, SCHEMA)
