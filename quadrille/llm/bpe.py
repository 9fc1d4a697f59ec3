"""Byte-pair encoding and decoding with a vocabulary file of the public kind.

A text is cut at the special tokens that stand in it, then at white space.
Each piece of text between is normalised (NFC, lower case), split by the
pre-tokenizer's pattern, spelt in the byte alphabet and merged.

Merging uses a contiguous rank array: the parts of a short word are kept as
boundaries, with the rank of each adjacent pair beside them; the array is
scanned for its minimum, that boundary is deleted, and the ranks of the two
neighbours are looked up again, until no pair can merge. Scanning takes the
square of a word's length, so a word of over ``SHORT`` bytes keeps its ranks in
a heap and its boundaries in a linked list; the order of merges is the same.

No alternative of the pattern crosses white space, so a text's tokens are its
white-space chunks' tokens in a row; chunks and pieces seen before are looked
up in a memo of fixed size. The work is row by row: no shuffle, and a lost
executor's rows are read again.

Defined cases: a null text is empty and has no tokens; repeated rows each get
their tokens; a very long text is handled chunk by chunk, and a chunk may be as
long as the text; an empty table gives an empty result. A column of the input
that is named ``ids`` (or ``decoded``, in :func:`decode_documents`) comes back
as ``ids_given``; others keep their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quadrille.llm.common import short_batches, spare, table, tidy, whole_text

#: Chunks and pieces that a task remembers: two generations of so many, of
#: this length at most.
MEMO, LONGEST = 350_000, 40
#: Bytes of a word up to which its ranks are scanned.
SHORT = 256
#: White space as the vocabulary file's pattern has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it prints, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        self.written = {i: str(i) for i in self.tokens}
        alphabet = byte_alphabet()
        self.inner = [ids[c] for c in alphabet]
        self.last = [ids[c + end] for c in alphabet]
        #: Rank of a pair of ids, and what the pair of that rank becomes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[ids[a] << 20 | ids[b]] = i
            self.made.append(ids[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.pieces = regex.compile(pattern).findall
        self.chunks = re.compile(f"[^{SPACE}]+").findall
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None
        self.old: dict[str, tuple] = {}
        self.new: dict[str, tuple] = {}

    def forget(self) -> None:
        """Empties the memo, which would else fill the worker's memory during other stages."""
        self.old, self.new = {}, {}

    def merge(self, word: str) -> list[int]:
        """The ids of a word of one character or more."""
        data = word.encode("utf-8", "surrogatepass")
        inner, rank, never = self.inner, self.rank.get, 1 << 30
        parts = [inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        ranks = [rank(a << 20 | b, never) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            part = self.made[least]
            parts[i] = part
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | part, never)
            if i < len(ranks):
                ranks[i] = rank(part << 20 | parts[i + 1], never)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """As :meth:`merge`: the least rank first, the leftmost of equal ones."""
        rank, end = self.rank.get, len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(end - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            # A part that was merged away, or has changed since, has -1 or another id.
            if parts[i] != a or j >= end or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (q := rank(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (q, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (q := rank(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (q, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower case character by character: no rule for the last sigma of a word.
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _spelt(self, piece: str) -> tuple[int, str, str]:
        ids = self.merge(piece)
        written, tokens = self.written, self.tokens
        return len(ids), " ".join([written[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def _keep(self, key: str, got: tuple) -> tuple:
        if len(key) <= LONGEST:
            if len(self.new) >= MEMO:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number of tokens, ids joined by a space, tokens joined by a space)."""
        got = self.old.get(chunk)
        if got is None:
            text = self.normal(chunk)
            pieces = [text] if text.isascii() and text.isalpha() else self.pieces(text)
            each = [
                self.new.get(p) or self._keep(p, self.old.get(p) or self._spelt(p)) for p in pieces
            ]
            if len(each) == 1:
                got = each[0]
            else:
                got = (
                    sum([x[0] for x in each]),
                    " ".join([x[1] for x in each]),
                    " ".join([x[2] for x in each]),
                )
        return self._keep(chunk, got)

    def _encoded(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        for i, part in enumerate(self.cut(text) if self.cut and "<|" in text else [text]):
            if i % 2:
                out.append((1, self.written[self.special[part]], part))
                continue
            # str.split() would also split at four separators that the pattern takes as symbols.
            odd = "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part
            chunks = self.chunks(part) if odd else part.split()
            miss = self.chunk
            out += [self.new.get(c) or miss(c) for c in chunks]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self._encoded(text) for i in x[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, digest of the ids, digest of the decoded text)."""
        got = self._encoded(text)
        return (
            sum([x[0] for x in got]),
            hashlib.sha256(" ".join([x[1] for x in got]).encode()).hexdigest(),
            hashlib.sha256(" ".join([x[2] for x in got]).encode("utf-8", "surrogatepass")).hexdigest(),
        )


@lru_cache(maxsize=1)
def loaded(path: str) -> WordBpe:
    """The encoder of this process: tasks of one worker share it, with an empty memo each (see :func:`for_task`)."""
    return WordBpe(path)


@contextmanager
def for_task(path: str) -> Iterator[WordBpe]:
    """The encoder of this process, whose memo goes with the task: idle workers live on for other stages."""
    bpe = loaded(path)
    try:
        yield bpe
    finally:
        bpe.forget()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the text, in place of the text."""
    short_batches(docs.sparkSession)
    docs = spare(docs, "ids").withColumn(text, whole_text(text))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.drop(text).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_task(path) as bpe:
            for batch in batches:
                ids = pa.array([bpe.encode(t) for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
                rest = [c for i, c in enumerate(batch.columns) if i != at]
                names = [c for i, c in enumerate(batch.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, ids], names=[*names, "ids"])

    return docs.mapInArrow(tidy(run), schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` in place of ``ids``."""
    short_batches(docs.sparkSession)
    docs = spare(docs, "decoded")
    at = docs.columns.index(ids)
    schema = T.StructType([*docs.drop(ids).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_task(path) as bpe:
            for batch in batches:
                texts = pa.array([bpe.decode(i or []) for i in batch.column(at).to_pylist()], pa.string())
                rest = [c for i, c in enumerate(batch.columns) if i != at]
                names = [c for i, c in enumerate(batch.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, texts], names=[*names, "decoded"])

    return docs.mapInArrow(tidy(run), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded, as digests.

    The ids and the decoded text of a document are digested where they are
    made; they would be several times the input if they were rows.
    """
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    path = tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with for_task(path) as bpe:
            for batch in batches:
                n, ids, text = zip(*[bpe.digest(t) for t in batch.column(1).to_pylist()], strict=True) if batch.num_rows else ((),) * 3
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
