"""Secret scans over whole documents (operator 2).

Each block of documents gets an inverted index from the trigrams that some rule needs to the
documents that hold them. A Boolean query over trigrams is derived from each rule's regular
expression, postings are intersected and united, and the rule runs on the candidates only. A rule
without mandatory trigrams runs on every document. The index is as large as the block, so nothing
is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from labelloom.llm.blocks import Block, LOWER, blocks, id_and_text, ids_out, with_row, without_row

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern``, kept if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII


# fixed values
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: A whole private key: from BEGIN to the END line, which has no other dashed line before it. Where END is missing, the
#: header lines and the base64 run, with the short line or the word that ends it.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|{gap}(?:[A-Za-z0-9-]+:[^\n\\]*+(?:\n|\\n){gap})*+(?:(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}{gap})++(?:[A-Za-z0-9+/]++={{0,2}})?|[A-Za-z0-9+/]++={{0,2}}\s*\Z)"
    r"|)"
).format(gap=r"""(?:[\s"'+,>#*|;]|\\[nrt])*+""")
MORE_RULES = (
    Rule("pem", PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None holds for every document, bytes for those with that trigram, ("and" | "or", parts) for combinations.
Query = None | bytes | tuple


def _all(kind: str, parts: Iterable[Query]) -> Query:
    parts = list(parts)
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _needs(strings: set[bytes]) -> Query:
    """One of the strings occurs."""
    grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    if not all(grams):
        return None
    least = {g for g in grams if not any(h < g for h in grams)}
    return _all("or", sorted((_all("and", sorted(g)) for g in least), key=repr))


def _characters(node) -> set[bytes] | None:
    """The strings a node stands for, if they are few and plain."""
    op, value = node
    if op is C.LITERAL and value < 128:
        return {chr(value).lower().encode()}
    if op is C.IN and len(value) <= 4 and all(o is C.LITERAL and v < 128 for o, v in value):
        return {chr(v).lower().encode() for _, v in value}
    return None


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What must hold of the lower-cased trigrams of a text in which ``pattern`` matches."""

    def walk(nodes) -> tuple[set[bytes] | None, Query]:
        """All strings that the nodes match, or else what a match needs."""
        run: set[bytes] = {b""}
        found: list[Query] = []
        whole = True
        for op, value in nodes:
            strings, query = _characters((op, value)), None
            if strings is None and op is C.SUBPATTERN:
                strings, query = walk(value[-1])
            elif strings is None and op is C.BRANCH:
                ways = [walk(x) for x in value[1]]
                if all(s is not None for s, _ in ways):
                    strings = set().union(*(s for s, _ in ways))
                else:
                    query = _all("or", (q if s is None else _needs(s) for s, q in ways))
            elif strings is None and op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, item = value
                inner, query = walk(item)
                if inner is not None and (low, high) == (0, 1):
                    strings = inner | {b""}
                elif inner is not None and low == high and len(inner) ** low <= MAX_STRINGS:
                    strings = {b""}
                    for _ in range(low):
                        strings = {a + b for a in strings for b in inner}
                elif low == 0:
                    query = None
                elif inner is not None:
                    query = _needs(inner)
            elif strings is None and op is C.AT:
                strings = {b""}
            if strings is not None and len(strings) * len(run) <= MAX_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            found += [_needs(run), query if strings is None else _needs(strings)]
            run, whole = {b""}, False
        if whole:
            return run, None
        return None, _all("and", [*found, _needs(run)])

    strings, query = walk(_parser.parse(pattern, flags))
    return _needs(strings) if strings is not None else query


def _grams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1]))


class Scanner:
    """Rules with their trigram queries, ready for blocks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.found = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.grams = sorted(set().union(*map(_grams, self.queries)))
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        self.slot[[int.from_bytes(g, "big") for g in self.grams]] = np.arange(len(self.grams))

    def index(self, block: Block) -> dict[bytes, np.ndarray]:
        """Postings: for each needed trigram the documents of the block that hold it, in order."""
        low = LOWER[block.data].astype(np.int32)
        slots = self.slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(slots >= 0)
        docs = np.searchsorted(block.start, at, side="right") - 1
        pairs = np.unique(slots[at].astype(np.int64) * len(block) + docs)
        cuts = np.searchsorted(pairs, np.arange(len(self.grams) + 1) * len(block))
        return {g: pairs[cuts[k] : cuts[k + 1]] - k * len(block) for k, g in enumerate(self.grams)}

    def candidates(self, query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[query]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def spans(self, block: Block) -> list[list[tuple[int, int, str]]]:
        """For each document its (start, end, kind) in code points, by start, then in the order of the rules."""
        postings = self.index(block)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
        text: dict[int, str] = {}
        for k, (rule, pattern, query) in enumerate(zip(self.rules, self.found, self.queries)):
            for d in self.candidates(query, postings, len(block)).tolist():
                if d not in text:
                    text[d] = block.texts[d].decode()
                for m in pattern.finditer(text[d]):
                    if len(m[rule.group]) >= rule.least:
                        found[d].append((m.start(), k, m.end()))
        return [[(a, z, self.rules[k].kind) for a, k, z in sorted(x)] for x in found]


def _joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per secret: doc_id, kind, start, end (code points, end exclusive), value.

    Whole texts are scanned; a null or empty text has no secrets, and null or repeated ids come back
    as they are. An empty table gives an empty one. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        scan = Scanner(rules)
        for block in blocks(batches):
            rows = [(d, s) for d, spans in enumerate(scan.spans(block)) for s in spans]
            value = [block.texts[d].decode()[a:z] for d, (a, z, _) in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids_out(block.ids[[d for d, _ in rows]]),
                    "kind": pa.array([s[2] for _, s in rows], pa.string()),
                    "start": pa.array([s[0] for _, s in rows], pa.int64()),
                    "end": pa.array([s[1] for _, s in rows], pa.int64()),
                    "value": pa.array(value, pa.string()),
                }
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, kind string, start long, end long, value string")


def secret_digest(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row per row of ``docs``: a count ``n_<kind>`` for each base rule, ``base_sha256`` and ``spans``."""
    kinds = [r.kind for r in base]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]):
        scan = Scanner(base + more)
        for block in blocks(batches):
            spans = scan.spans(block)
            own = [[s for s in x if s[2] in kinds] for x in spans]
            counts = {f"n_{k}": pa.array([sum(s[2] == k for s in x) for x in own], pa.int64()) for k in kinds}
            sums = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in own]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids_out(block.ids), **counts, "base_sha256": sums, "spans": [_joined(x) for x in spans]}
            )

    return id_and_text(docs).mapInArrow(run, schema)


def _redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, z, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, z)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``docs`` with their columns; each secret in ``text`` becomes ``<kind>``.

    Overlapping secrets become one mark. ``n_chars``, if there is such a column, follows the new
    text where it changed. A null text stays null. Columns travel in one struct, so names cannot clash.
    """
    plain, _ = with_row(docs)
    schema = StructType([StructField("text", StringType()), StructField("changed", BooleanType()), StructField("_row", plain.schema["_row"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]):
        scan = Scanner(rules)
        for batch in batches:
            new: list[str | None] = []
            for block in blocks([batch.select(["doc_id", "text"])]):
                new += [_redacted(t.decode(), s) if s else None for t, s in zip(block.texts, scan.spans(block))]
            own = batch.column("text")
            fresh = pa.array(new, own.type)
            changed = fresh.is_valid()
            yield pa.RecordBatch.from_arrays([pc.if_else(changed, fresh, own), changed, batch.column("_row")], names=["text", "changed", "_row"])

    clean = plain.mapInArrow(run, schema)
    follow = {}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        follow["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("_row").getField("n_chars"))
    return without_row(clean, docs.columns, **follow)
