"""Secret scans: pattern candidates, then structural confirmation of what base64, hex and tokens hold.

Three base kinds come from patterns alone: ``assign`` (a named value), ``access`` (an access key id)
and ``hex`` (a long run of hex digits). A candidate of an added kind is reported only if its
structure holds:

- ``jwt``: three base64url parts of which the first decodes to a JSON object with a string ``alg``
  and the second to a JSON object;
- ``pem``: an armoured private key, its line breaks escaped or not, whose body decodes to DER whose
  nested lengths fill it exactly, or to the length-prefixed fields of an ``openssh-key-v1`` block; or
  to whole cipher blocks, where a header line tells cipher and initial vector;
- ``key64`` and ``keyhex``: a bare base64 or hex run that decodes to such DER (a sequence that
  begins with a version number or an algorithm) or such a block.

Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvana.llm.batches import mapper

KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")
RANK = {k: n for n, k in enumerate(KINDS)}


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
#: The values may be shorter than 6 here: such a match still uses up its characters before it is dropped.
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs: a minimum length within the pattern gives the same matches as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A JSON object's first byte makes the first letter an e.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.(e[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Headers and body never give characters back: a value ends at the first other character, so each armour is read once.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:(?:\s|\\++[nr])*+[A-Z][A-Za-z-]++: [A-Za-z0-9,.-]++)*+)((?:[A-Za-z0-9+/=\s]|\\++[nr])++)-----END \1PRIVATE KEY-----")
ESCAPED = re.compile(r"\\+[nr]")
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})(?![0-9A-Fa-f])")
#: M begins a DER sequence of more than 47 bytes, b the magic of an openssh block.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[Mb][A-Za-z0-9+/]{39,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]|6f70656e)[0-9A-Fa-f]{36,}")
OPENSSH = b"openssh-key-v1\0"


def decoded(text: str, urlsafe: bool = False) -> bytes | None:
    """The bytes of base64 text, padded as needed; None if it isn't base64."""
    body = re.sub(r"\s+", "", text).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at a place; None unless its length is whole and minimal."""
    if at + 2 > len(data):
        return None
    n, start = data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or start + width > len(data):
            return None
        n, start = int.from_bytes(data[start : start + width], "big"), start + width
        if n < 0x80 or n >> 8 * (width - 1) == 0:
            return None
    return (data[at], start, start + n) if start + n <= len(data) else None


def der_fills(data: bytes, at: int, end: int) -> bool:
    """Whether values with nested lengths fill data[at:end] exactly. Without recursion: nesting may be deep."""
    todo = [(at, end)]
    while todo:
        at, end = todo.pop()
        while at < end:
            head = der_header(data, at)
            if head is None or head[2] > end:
                return False
            tag, start, at = head
            if tag & 0x20:
                todo.append((start, at))
    return True


def is_der_key(data: bytes) -> bool:
    """A sequence over all the bytes whose first member is an integer or a sequence, with at least two members and well-formed nesting."""
    head = der_header(data, 0)
    if head is None or head[0] != 0x30 or head[2] != len(data):
        return False
    first = der_header(data, head[1])
    return first is not None and first[0] in (0x02, 0x30) and first[2] < len(data) and der_fills(data, head[1], head[2])


def is_openssh_key(data: bytes) -> bool:
    """The magic, three length-prefixed names, a count of keys and that many length-prefixed blocks and one more, to the end."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return count >= 1 and all(field() for _ in range(count + 1)) and at == len(data)


def is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= 24 and (is_der_key(data) or is_openssh_key(data))


def json_object(part: str) -> dict | None:
    data = decoded(part, urlsafe=True)
    if not data or not data.startswith(b"{"):
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(head: str, body: str) -> bool:
    return isinstance((json_object(head) or {}).get("alg"), str) and json_object(body) is not None


def is_armoured(headers: str, body: str) -> bool:
    data = decoded(ESCAPED.sub("\n", body))
    cipher = CIPHER.search(headers)
    return is_key(data) or cipher is not None and bool(data) and len(data) % (len(cipher[1]) // 2) == 0


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens; where a candidate fails, its second part may begin another."""
    found, at = [], 0
    while m := JWT.search(text, at):
        good = is_signed_token(m[1], m[2])
        if good:
            found.append((m.start(), m.end(), "jwt"))
        at = m.end() if good else m.start(2)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose structure holds; a bare run inside an armoured key isn't reported again."""
    found = tokens(text)
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if is_armoured(m[2], m[3])]
    armoured = [(a, b) for a, b, kind in found if kind == "pem"]
    bare = [(m.start(), m.end(), "key64") for m in BASE64.finditer(text) if is_key(decoded(m[0]))]
    bare += [(m.start(), m.end(), "keyhex") for m in HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    return found + [x for x in bare if not any(a <= x[0] and x[1] <= b for a, b in armoured)]


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as in KINDS, then end."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], RANK[s[2]], s[1]))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each maximal union of overlapping spans replaced by a mark of its first kind, which no pattern takes for a secret."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"<masked-{kind}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = pa.schema([("id", pa.int64()), ("spans", pa.list_(SPAN)), ("base_sha256", pa.string()), ("redacted", pa.string())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Secrets of every whole text: (id_col, spans, base_sha256, redacted), a row for each row, without a shuffle.

    spans: array of (kind, start, end) by start, then kind. base_sha256: digest of the base kinds'
    spans. redacted: the text with its secrets masked, null unless with_text. A null text counts as
    empty and stays null when redacted; an empty text has no spans; null ids and repeated rows are
    kept. Only the two columns are read, so others don't matter.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t").to_pylist()
        found = [spans_of(t) for t in texts]
        base = [hashlib.sha256(shown([s for s in x if RANK[s[2]] < 3]).encode()).hexdigest() for x in found]
        spans = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in found], pa.list_(SPAN))
        masked = pa.array([redacted(t, x) if with_text else None for t, x in zip(texts, found, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("id"), spans, pa.array(base, pa.string()), masked], schema=SCHEMA)

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("base_sha256", T.StringType()), T.StructField("redacted", T.StringType())])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(mapper(kernel, "t"), out).withColumnRenamed("id", id_col)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the base digest and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return scanned.select(id_col, *map(count, KINDS[:3]), "base_sha256", F.array_join(line, ",").alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its texts masked and, if there is one, n_chars counted anew; the other columns, whatever their names, are kept."""
    names, schema = df.columns, df.schema

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = [redacted(t, spans_of(t)) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = df.mapInArrow(mapper(kernel, text_col), schema)
    return out.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType)) if "n_chars" in names else out
