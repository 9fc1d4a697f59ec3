"""Secret scan behind a trigram inverted index.

From each rule's pattern a Boolean query over byte trigrams is derived (ASCII
letters folded): a text that matches the pattern must satisfy the query. Each
block of documents gets an inverted index of the trigrams that the queries
name, postings are intersected and united as the queries say, and only the
candidates are verified by the pattern itself. A rule whose pattern has no
mandatory trigram scans every text.

The index is built block by block, where the texts are: nothing is shuffled,
a lost executor's blocks are simply read again. An index lives as long as its
block of ``BLOCK_BYTES`` (or one longer text), and is built from pieces of that
size. Whole texts are scanned; matches are leftmost and do not overlap within
a rule; matches that fail a rule's length test are dropped.

Defined cases: a null text is empty; an empty text has no span; repeated rows
each get their spans; spans are in code points, the end exclusive; an empty
table gives an empty result. A column of the input that is named ``spans``
comes back as ``spans_given``; others keep their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import short_batches, spare, table, whole_text


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further formats of credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization)\x20*[:=]\x20*(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:([^\s:/@]+)@", 1, 6),
)
RULES = BASE + MORE

#: Bytes of a block of texts, and of a piece of it that is indexed at once.
BLOCK_BYTES = 1 << 22
#: Strings that an expression may match exactly are followed up to this many.
MOST_EXACT = 64

# A trigram query is True (any text), a trigram, or ("and" | "or", frozenset of queries).


def _both(a, b):
    if a is True or a == b:
        return b
    if b is True:
        return a
    parts = [q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in (a, b)]
    return ("and", frozenset().union(*parts))


def _either(a, b):
    if a is True or b is True:
        return True
    if a == b:
        return a
    parts = [q[1] if isinstance(q, tuple) and q[0] == "or" else {q} for q in (a, b)]
    options = frozenset().union(*parts)
    # An option that asks for all that another one does adds nothing.
    needs = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q}) for q in options}
    least = frozenset(q for q in options if not any(needs[o] < needs[q] for o in options))
    return next(iter(least)) if len(least) == 1 else ("or", least)


def _of_string(s: bytes):
    q = True
    for i in range(len(s) - 2):
        q = _both(q, s[i : i + 3])
    return q


def _of_strings(strings):
    q = None
    for s in strings:
        q = _of_string(s) if q is None else _either(q, _of_string(s))
    return True if q is None else q


def _chars(items) -> set[bytes] | None:
    """The folded characters of a class, or None if there are many."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_EXACT:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return {c.encode().lower() for c in found}


def _walk(tree):
    """(exact, query): the strings matched, or None if unbounded, and a query."""
    exact: set[bytes] | None = {b""}
    query = True
    for kind, value in tree:
        if kind is op.LITERAL:
            part, more = {chr(value).encode().lower()}, True
        elif kind is op.IN:
            part, more = _chars(value), True
        elif kind is op.SUBPATTERN:
            part, more = _walk(value[3])
        elif kind is op.BRANCH:
            part, more = set(), None
            for option in value[1]:
                p, m = _walk(option)
                part = None if part is None or p is None else part | p
                m = m if p is None else _of_strings(p)
                more = m if more is None else _either(more, m)
            more = True if part is not None else more
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            p, m = _walk(inner)
            if p is not None and high <= 2 and high != op.MAXREPEAT:
                part, power = set(), {b""}
                for k in range(high + 1):
                    part |= power if k >= low else set()
                    power = {a + b for a in power for b in p}
                more = True
            else:
                part, more = None, True
                if low:
                    more = m if p is None else _of_strings(p)
        else:
            part, more = (set() if kind is op.AT else None), True
            part = {b""} if kind is op.AT else None
        if exact is not None and part is not None and len(exact) * len(part) <= MOST_EXACT:
            exact = {a + b for a in exact for b in part}
            continue
        # What was exact so far ends here; what follows starts again.
        if exact is not None:
            query = _both(query, _of_strings(exact))
        query = _both(query, more)
        if part is None or len(part) > MOST_EXACT:
            if part is not None:
                query = _both(query, _of_strings(part))
            exact = None
        else:
            exact = part
        if exact is None:
            exact, broken = {b""}, True
        else:
            broken = True
        if broken:
            tail_exact, tail_query = None, query
            rest = list(tree)[list(tree).index((kind, value)) + 1 :]
            suffix, more = _walk(rest)
            if suffix is not None:
                more = _of_strings({a + b for a in exact for b in suffix}) if len(exact) * len(suffix) <= MOST_EXACT else _both(_of_strings(exact), _of_strings(suffix))
            else:
                more = _both(_of_strings(exact), more)
            return tail_exact, _both(tail_query, more)
    return exact, query


def trigram_query(pattern: str):
    """A Boolean trigram query that each text with a match satisfies."""
    exact, query = _walk(list(parser.parse(pattern)))
    return query if exact is None else _both(query, _of_strings(exact))


def _trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(_trigrams, query[1]))


class TrigramIndex:
    """Postings, in one block of texts, of the trigrams asked for."""

    def __init__(self, wanted: list[bytes]):
        self.ids = {g: i for i, g in enumerate(wanted)}
        self.slot = np.full(1 << 24, -1, np.int16)
        for g, i in self.ids.items():
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i

    def build(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        block = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        self.postings = {i: np.zeros(0, np.int64) for i in self.ids.values()}
        parts = []
        for at in range(0, len(block) - 2, BLOCK_BYTES):
            piece = block[at : at + BLOCK_BYTES + 2]
            code = piece[:-2].astype(np.int32) << 16
            code |= piece[1:-1].astype(np.int32) << 8
            code |= piece[2:]
            slots = self.slot[code]
            hit = np.flatnonzero(slots >= 0)
            parts.append(np.unique(slots[hit].astype(np.int64) << 32 | np.searchsorted(ends, hit + at, side="right")))
        if not parts:
            return
        pairs = np.unique(np.concatenate(parts))
        which, doc = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(which)) + 1
        for w, d in zip(np.split(which, cuts), np.split(doc, cuts), strict=True):
            if len(w):
                self.postings[int(w[0])] = d

    def find(self, query) -> np.ndarray:
        """The documents of the block that satisfy ``query``, ascending."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[self.ids[query]]
        lists = sorted((self.find(q) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    """Spans of all rules in blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(sorted(set().union(*map(_trigrams, self.queries))))
        self.found = [re.compile(self._long(r), re.ASCII).finditer for r in rules]

    @staticmethod
    def _long(rule: Rule) -> str:
        """A lone repeated class matches its maximal runs, so shorter ones can be passed over in the pattern."""
        tree = list(parser.parse(rule.pattern))
        alone = len(tree) == 1 and tree[0][0] is op.MAX_REPEAT and tree[0][1][:2] == (1, op.MAXREPEAT)
        if alone and rule.pattern.endswith("]+") and rule.group == 0 and rule.least > 1:
            return f"{rule.pattern[:-1]}{{{rule.least},}}"
        return rule.pattern

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, rule number, end) of each span, sorted, for each text; texts are taken block by block."""
        spans, block, size = [], [], 0
        for t in texts:
            if block and size + len(t) > BLOCK_BYTES:
                spans += self._scan_block(block)
                block, size = [], 0
            block.append(t)
            size += len(t)
        return spans + self._scan_block(block)

    def _scan_block(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        self.index.build([t.encode("utf-8", "surrogatepass") for t in texts])
        spans: list[list] = [[] for _ in texts]
        for k, (rule, query, found) in enumerate(zip(self.rules, self.queries, self.found, strict=True)):
            for d in self.index.find(query).tolist():
                spans[d] += [
                    (m.start(), k, m.end()) for m in found(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least
                ]
        for s in spans:
            s.sort()
        return spans


def _scan_batches(rules: tuple[Rule, ...], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r.kind for r in rules]
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            spans = scanner.scan(batch.column(text_at).to_pylist())
            rows = [[{"kind": kinds[k], "start": a, "stop": b} for a, k, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, shape)], names=[*batch.schema.names, "spans"]
            )

    return run


SPANS = T.ArrayType(
    T.StructType().add("kind", "string").add("start", "long").add("stop", "long")
)


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, stop)."""
    short_batches(docs.sparkSession)
    docs = spare(docs, "spans").withColumn(text, whole_text(text))
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", SPANS)])
    return docs.mapInArrow(_scan_batches(rules, docs.columns.index(text)), schema)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by ``[kind]``; spans that overlap become one."""
    short_batches(docs.sparkSession)
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, scanner.scan([t or "" for t in texts]), strict=True):
                parts, done = [], 0
                for a, k, b in spans:
                    if a >= done:
                        parts += [t[done:a], f"[{rules[k].kind}]"]
                    done = max(done, b)
                out.append("".join([*parts, t[done:]]) if spans else t)
            arrays = list(batch.columns)
            arrays[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts and digest of the base rules, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def digest(spans: list[str]) -> str:
    """The digest that the query makes of ``kind:start:end`` strings."""
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
