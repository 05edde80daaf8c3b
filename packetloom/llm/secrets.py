"""Secret scanning with multipart credential linking.

Strong patterns are reported wherever they match. Weak candidates - a bare identifier, a long opaque string
or a service address, none of which means anything alone - are reported only when complementary parts
stand close together: an interval join on (document, cell of SCOPE code points) brings each secret - an opaque string or
a strong match that is no access key - together with the identifiers and addresses whose distance is at most SCOPE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import on_slices, same, text_key
from packetloom.store import Store

SCOPE = 200  # code points between two parts of one credential

# The strong patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
SECRETS, PARTNERS = ("opaque", "assign", "hex"), ("identifier", "endpoint", "access")

# Parts that need each other. An opaque string has digits, small and capital letters; an identifier is
# a user or client name given by an assignment; an endpoint is a URL with a host or a host with a port.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
AUTHORITY = re.compile(r"://[A-Za-z0-9.-]+(?::[0-9]+)?", re.ASCII)
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
HOST_PORT = re.compile(r"(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])", re.ASCII)


def strong(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the strong matches; per kind leftmost and not overlapping."""
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def weak(text: str) -> Iterator[tuple[str, int, int]]:
    for m in OPAQUE.finditer(text):
        s = m.group()
        if re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s):
            yield "opaque", m.start(), m.end()
    for m in IDENTIFIER.finditer(text):
        yield "identifier", m.start(), m.end()
    for start, end in endpoints(text):
        yield "endpoint", start, end


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost first and not overlapping. A scheme is looked for backwards from its '://', so that a long run of
    letters is gone over once and not from each of its letters."""
    found = [(m.start(), m.end()) for m in HOST_PORT.finditer(text)]
    done = 0
    for m in AUTHORITY.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in SCHEME:
            start -= 1
        while start < m.start() and not text[start].isalpha():
            start += 1
        if start < m.start():
            found.append((start, m.end()))
        done = m.end()
    last = 0
    for start, end in sorted(found):
        if start >= last:
            yield start, end
            last = end


_SPANS = "array<struct<kind: string, begin: int, stop: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("stop", pa.int32())]))


def _find(batch: pa.RecordBatch) -> pa.RecordBatch:
    found: list[list] = [[], []]
    for text in batch.column("text").to_pylist():
        for column, search in zip(found, (strong, weak)):
            column.append([{"kind": k, "begin": b, "stop": s} for k, b, s in search(text or "")])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("_key"), *(pa.array(c, _SPAN_TYPE) for c in found)],
        ["doc_id", "_key", "strong", "weak"],
    )


def linked(parts: DataFrame) -> DataFrame:
    """Of parts (doc_id, _key, kind, begin, stop): the weak ones that complete a credential.

    A secret, opaque, assigned or hex, completes one with an identifier, an endpoint or a strong access key within SCOPE; then
    both sides count. A part is filed in every cell it touches, a secret looks one cell further on either side.
    """
    first, last = F.floor(F.col("begin") / SCOPE), F.floor((F.col("stop") - 1) / SCOPE)
    filed = parts.where(F.col("kind").isin(*PARTNERS)).select(
        F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), F.col("kind").alias("kind2"),
        F.col("begin").alias("begin2"), F.col("stop").alias("stop2"), F.explode(F.sequence(first, last)).alias("_cell"),
    )
    looking = parts.where(F.col("kind").isin(*SECRETS)).select("*", F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    gap = F.greatest(F.col("begin") - F.col("stop2"), F.col("begin2") - F.col("stop"))
    pairs = looking.join(
        filed,
        same(F.col("doc_id"), F.col("_i")) & (F.col("_key") == F.col("_k")) & (F.col("cell") == F.col("_cell"))
        & (gap >= 0) & (gap <= SCOPE),
    )
    both = F.array(F.struct("kind", "begin", "stop"), F.struct(F.col("kind2").alias("kind"), F.col("begin2").alias("begin"), F.col("stop2").alias("stop")))
    return pairs.select("doc_id", "_key", F.inline(both)).where(~F.col("kind").isin(*KINDS)).distinct()


def find_secrets(docs: DataFrame, store: Store) -> DataFrame:
    """One row per row of `docs`: doc_id, strong and weak spans (kind, begin, stop).

    Offsets are code points, ends exclusive. Null texts count as empty. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("_key"), "text")
    found = store.save(
        rows.mapInArrow(on_slices("text", _find), f"doc_id long, _key long, strong {_SPANS}, weak {_SPANS}"), "secret-spans"
    )
    # only documents with a secret and a partner have anything to link
    parts = F.concat("weak", "strong")
    able = found.where(F.exists(parts, lambda s: s["kind"].isin(*SECRETS)) & F.exists(parts, lambda s: s["kind"].isin(*PARTNERS)))
    parts = able.distinct().select("doc_id", "_key", F.inline(parts))
    kept = linked(parts).groupBy("doc_id", "_key").agg(F.collect_set(F.struct("kind", "begin", "stop")).alias("kept"))
    kept = kept.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), "kept")
    none = F.array().cast(_SPANS)
    return found.join(kept, same(F.col("doc_id"), F.col("_i")) & (F.col("_key") == F.col("_k")), "left").select(
        "doc_id", "strong", F.coalesce("kept", none).alias("weak")
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the strong spans and all spans as text, from find_secrets."""
    order = ["assign", "access", "hex", "opaque", "identifier", "endpoint"]
    kinds = F.array(*map(F.lit, order))

    def listed(spans):
        ranked = F.transform(spans, lambda s: F.struct(s["begin"], F.array_position(kinds, s["kind"]).alias("k"), s["stop"]))
        return F.array_join(
            F.transform(
                F.array_sort(ranked), lambda s: F.concat_ws(":", F.element_at(kinds, s["k"].cast("int")), s["begin"], s["stop"])
            ),
            ",",
        )

    def number(kind: str):
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(number(k) for k in KINDS), F.sha2(listed(F.col("strong")), 256).alias("base_sha256"),
        listed(F.concat("strong", "weak")).alias("spans"),
    )
