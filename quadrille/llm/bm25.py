"""Exact top-k search by BM25 over sharded inverted indexes with block-max pruning.

Documents are dealt to shards of some ``SHARD_CHARS`` characters. A shard has
an inverted index (postings by term), the largest weight of each term, and of
its ``COMMON`` commonest terms the largest weight in each block of ``BLOCK``
documents. A query's terms are put in order of their lists' lengths. With a
threshold known, the pivot is the first term from which on the sum of the
remaining terms' bounds stays below it: a document without a term before the
pivot cannot enter, so only the lists before it are read. A document found
there stays a candidate if what it has so far and its block's maxima of the
terms from the pivot on reach the threshold; only candidates are completed,
and the few that still reach it are scored anew, exactly, in one order of
terms, so equal texts have equal scores in every shard. This is WAND's test
with block maxima, taken for all documents of a shard at once.

Only queries of under ``SHORT`` terms are searched one by one in that way. The
others are searched ``TOGETHER``, over groups of documents of like terms and
lengths: a group's commonest terms are held whole, so what they add to all
scores is a product of two matrices, and the others are added from their
postings. The test with block maxima is made for each query and each tile of
``TILE`` documents, before the product; the sums of floats are taken with the
error that they may have, and what still reaches the threshold is scored anew.

The threshold is the k-th best score known: first that of the documents best
by their rarest terms, and from the second round on that of all shards before.
Shards are searched in rounds of doubling numbers, from one for each core on, and a shard sends on only
rows that reach the threshold, so a query's rows grow with the number of
rounds, not of shards.

Document frequencies, the number of documents and their mean length are those
of the whole corpus, so the shards' results merge exactly. Terms are named by
64-bit hashes; a text is parted into terms once, and what is stored and dealt
to the shards are its hashes and counts. The queries' terms get dense numbers, the commonest first, so a
query travels in some two bytes a term, and a shard's dictionary has the
queries' terms only. A query's distinct terms count once each:
score = sum of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1)
/ (tf + K1 * (1 - B + B * length / mean length)), to nine decimals.

Every query meets every shard, so with queries in proportion to documents the
work grows as their product; see the README for figures.

Defined cases: a null text is empty; a query without terms, or whose terms no
document holds, has no results; equal scores are ordered by document id, a
null id first; repeated rows are rows of their own (a shard holds rows equal
in id, terms and counts once, with their number); a document of any length is one
entry; empty tables give an empty result; only the id and the text are read,
so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import give_back, short_batches, stored, table, tidy, whole_text

K1, B = 1.2, 0.75
#: Characters of a shard's texts, documents of a block, and terms of a shard that have block maxima.
SHARD_CHARS, BLOCK, COMMON = 40_000_000, 32, 512
#: The share of a query's postings read before there is a threshold.
HEAD = 0.08
#: Documents of a group and of its tiles, kinds that a shard's documents are dealt to by their terms, and rounds of that dealing.
GROUP, TILE, KINDS, DEALINGS = 4096, 512, 8, 4
#: A group's terms with postings for one in DENSITY of its documents are held whole, FULL terms at most.
DENSITY, FULL = 30, 1024
#: Queries searched together and terms that they have at once, but for the last query, and cells of a matrix held at once.
TOGETHER, ASKED, CELLS = 1024, 500_000, 24_000_000
#: Postings added to the scores of queries searched together at once, some few more or less.
POSTS = 32_768
#: Queries of fewer terms are searched one by one.
SHORT = 8
#: Every ROW-th document id is a query; results of a query.
QUERY_EVERY, TOP = 20, 10
#: Terms counted before a task sends them on, hashes gathered before they are counted, and terms of a row of the dictionary.
COUNTED, GATHERED, PAGE = 500_000, 1_000_000, 8192
#: Terms after the pivot that are read between two tests of the candidates.
PART = 16
#: What sums of doubles and of floats may be off by, as a share.
SLACK = 1e-5
#: What one addition of floats may be off by, as a share.
ROUNDING = 6e-8

_terms = re.compile(r"[^\W_]+").findall


def terms(text: str) -> list[str]:
    return _terms(text.lower())


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def _hashes(words: Collection[str]) -> np.ndarray:
    """:func:`_hash` of each."""
    try:
        found = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    except UnicodeEncodeError:
        return np.fromiter(map(_hash, words), "<i8", len(words))
    return (found ^ np.uint64(1 << 63)).view("<i8")


def _counts(text: str) -> tuple[int, bytes, bytes]:
    """A text's number of words, the hashes of its terms, ascending, and how often it has each, in one or four bytes."""
    words = terms(text)
    counts = Counter(words)
    hashes, tf = _hashes(counts), np.fromiter(counts.values(), np.uint32, len(counts))
    order = hashes.argsort()
    tf = tf[order].astype("u1" if tf.max(initial=0) < 256 else "<u4")
    return len(words), hashes[order].tobytes(), tf.tobytes()


class Shard:
    """The inverted index of one shard; ``read`` counts postings read, ``all`` those of the queries' terms."""

    def __init__(self, mean: float, n: int):
        self.mean, self.n = mean, n
        self.pages: list[tuple[int, bytes, bytes]] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.rows: dict[tuple, int] = {}
        self.many: list[int] = []
        self.hashes: np.ndarray | None = None
        self.read = self.all = 0

    def page(self, first: int, hashes: bytes, df: bytes) -> None:
        """A part of the dictionary: the hashes and document frequencies of terms from ``first`` on."""
        self.pages.append((first, hashes, df))

    def _open(self) -> None:
        self.pages.sort()
        ends = [(np.frombuffer(h, "<i8"), np.frombuffer(zlib.decompress(d), "<i8")) for _, h, d in self.pages]
        hashes = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, np.int64)
        df = np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, np.int64)
        self.pages = []
        self.by_hash = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.by_hash]
        self.idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def add(self, doc_id: int | None, text: str) -> None:
        self.put(doc_id, *_counts(text))

    def put(self, doc_id: int | None, size: int, hashes: bytes, tf: bytes) -> None:
        """A document as :func:`_counts` gives it."""
        if self.hashes is None:
            self._open()
        at = self.rows.setdefault((doc_id, hashlib.blake2b(hashes + tf, digest_size=16).digest()), len(self.rows))
        if at < len(self.many):
            self.many[at] += 1
            return
        own, counts = np.frombuffer(hashes, "<i8"), np.frombuffer(tf, "u1" if len(tf) * 8 == len(hashes) else "<u4")
        has = np.zeros(0, np.int64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            has = np.flatnonzero(self.hashes[place] == own)
        codes = self.by_hash[place[has]] if len(has) else np.zeros(0, np.int32)
        order = codes.argsort()
        self.codes.append(codes[order])
        self.counts.append(counts[has[order]].astype(np.int32))
        self.sizes.append(size)
        self.many.append(1)

    def close(self) -> None:
        if self.hashes is None:
            self._open()
        self.hashes, self.by_hash = None, None
        # Documents of like terms and lengths stand together, so blocks and groups differ more in their maxima.
        kinds = self._kinds()
        turned = np.lexsort((np.array(self.sizes, np.int64), kinds)).tolist()
        ids = [k[0] for k in self.rows]
        self.ids = [ids[i] for i in turned]
        self.many = [self.many[i] for i in turned]
        size = np.array([self.sizes[i] for i in turned], np.float64)
        self.norm = K1 * (1 - B + B * size / self.mean)
        # By document: local terms, ascending, and how often it has them.
        self.at = np.concatenate([[0], np.cumsum([len(self.codes[i]) for i in turned])]).astype(np.int64)
        code = np.concatenate([self.codes[i] for i in turned]) if len(turned) else np.zeros(0, np.int32)
        self.tf = np.concatenate([self.counts[i] for i in turned]) if len(turned) else np.zeros(0, np.int32)
        self.codes, self.counts, self.rows = [], [], {}
        has = np.zeros(len(self.idf), bool)
        has[code] = True
        known = np.flatnonzero(has)
        self.local = np.full(len(self.idf), -1, np.int32)
        self.local[known] = np.arange(len(known), dtype=np.int32)
        self.term, self.idf = self.local[code], self.idf[known]
        del code, has
        self._group(kinds[turned])
        df = np.bincount(self.term, minlength=len(known))
        self.first = np.concatenate([[0], np.cumsum(df)])
        self.most = self.top.max(axis=0) if len(self.top) else np.zeros(len(known), np.float32)
        common = np.argsort(-df, kind="stable")[:COMMON]
        self.common = np.full(len(df), -1, np.int32)
        self.common[common] = np.arange(len(common))
        self.block_most = np.zeros((len(common), -(-max(1, len(turned)) // BLOCK)), np.float32)
        for g in range(len(self.whole)):
            doc, impact, n = self._posts(g, common)
            np.maximum.at(self.block_most, (np.repeat(np.arange(len(common)), n), (doc + self.starts[g]) // BLOCK), impact)
        self.asked = np.zeros(len(df), bool)

    def _weight(self, rows: np.ndarray | slice, docs: np.ndarray) -> np.ndarray:
        """What the postings ``rows`` of ``docs`` add to their scores."""
        tf = self.tf[rows].astype(np.float64)
        return self.idf[self.term[rows]] * (tf * (K1 + 1) / (tf + self.norm[docs]))

    def _kinds(self) -> np.ndarray:
        """A number for each document, equal for documents that share many common terms."""
        n, docs = np.array([len(c) for c in self.codes], np.int64), len(self.codes)
        code = np.concatenate(self.codes) if docs else np.zeros(0, np.int32)
        df = np.bincount(code, minlength=1)
        common = np.argsort(-df, kind="stable")[: min(256, max(16, CELLS // max(1, docs)))]
        if docs <= GROUP:
            return np.zeros(docs, np.int64)
        column = np.full(len(df), -1, np.int32)
        column[common] = np.arange(len(common))
        has = np.zeros((docs, len(common)), np.float32)
        at = column[code]
        has[np.repeat(np.arange(docs), n)[at >= 0], at[at >= 0]] = 1
        has /= np.sqrt(np.maximum(has.sum(axis=1, keepdims=True), 1))
        centre = has[:: max(1, docs // KINDS)][:KINDS]
        for _ in range(DEALINGS):
            kind = (has @ centre.T).argmax(axis=1)
            centre = np.stack([has[kind == i].sum(axis=0) for i in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        return kind

    def _group(self, kinds: np.ndarray) -> None:
        """Groups of documents: where their postings of a term are, its largest weight there, and the common terms whole."""
        edges = np.flatnonzero(np.diff(kinds, prepend=-1, append=-1))
        starts = [a for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for a in range(lo, hi, max(1, GROUP))]
        self.starts = [*starts, len(kinds)]
        self.terms, groups = len(self.idf), len(starts)
        # By group and term: the documents, counted from the group's first, beside what the term adds, in eight bytes.
        # Groups are made one by one, as what sorting needs is several times the postings.
        self.pairs = np.empty(len(self.term), np.int64)
        self.cut = np.zeros(groups * self.terms + 1, np.int32)
        self.top = np.zeros((groups, self.terms), np.float32)
        self.part = np.zeros(0, np.float32)
        self.column, self.whole = np.full((groups, self.terms), -1, np.int16), []
        full = min(FULL, max(16, CELLS // max(1, len(kinds))))
        for g in range(groups):
            a, b = self.starts[g], self.starts[g + 1]
            lo, hi = int(self.at[a]), int(self.at[b])
            doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(self.at[a : b + 1]))
            order = np.argsort(self.term[lo:hi], kind="stable")
            pairs = self.pairs[lo:hi].view(np.int32)
            pairs[::2] = doc[order]
            pairs[1::2] = self._weight(slice(lo, hi), doc + a).astype(np.float32).view(np.int32)[order]
            del doc, order
            df = np.bincount(self.term[lo:hi], minlength=self.terms)
            ends = lo + np.cumsum(df)
            self.cut[g * self.terms + 1 : (g + 1) * self.terms + 1] = ends
            has = np.flatnonzero(df)
            if len(has):
                self.top[g, has] = np.maximum.reduceat(pairs.view(np.float32)[1::2], (ends - df)[has] - lo)
            common = np.flatnonzero(df * DENSITY >= b - a)
            common = common[np.argsort(-df[common], kind="stable")[:full]]
            self.column[g, common] = np.arange(len(common))
            whole = np.zeros((len(common), b - a), np.float32)
            doc, impact, n = self._posts(g, common)
            whole[np.repeat(np.arange(len(common)), n), doc] = impact
            tiles = np.arange(0, b - a, TILE)
            self.whole.append((whole, tiles, np.maximum.reduceat(whole, tiles, axis=1)))

    def _posts(self, g: int, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings of the terms ``local`` in a group: documents, what they get, and the number for each term."""
        lo = self.cut[local + g * self.terms]
        hi = self.cut[local + (g * self.terms + 1)]
        pairs = self.pairs.take(_ranges(lo, hi))
        return pairs.view(np.int32)[::2], pairs.view(np.float32)[1::2], hi - lo

    def _partial(self, local: np.ndarray) -> np.ndarray:
        """What the terms ``local`` add to each document's score."""
        at = (np.arange(len(self.whole))[:, None] * self.terms + local).ravel()
        lo, hi = self.cut[at], self.cut[at + 1]
        pairs = self.pairs.take(_ranges(lo, hi))
        self.read += len(pairs)
        first = np.repeat(np.array(self.starts[:-1], np.int64), len(local))
        return np.bincount(pairs.view(np.int32)[::2] + np.repeat(first, hi - lo), pairs.view(np.float32)[1::2], len(self.ids))

    def _added(self, local: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What the terms ``local`` add to the scores of ``docs``, ascending."""
        out = np.zeros(len(docs))
        ends = np.searchsorted(docs, self.starts).tolist()
        for g, a in enumerate(self.starts[:-1]):
            if ends[g] < ends[g + 1]:
                doc, impact, _ = self._posts(g, local)
                out[ends[g] : ends[g + 1]] = np.bincount(doc, impact, self.starts[g + 1] - a)[docs[ends[g] : ends[g + 1]] - a]
        return out

    def _exact(self, docs: np.ndarray, local: np.ndarray) -> np.ndarray:
        """The scores of ``docs``, summed in one order of terms."""
        self.asked[local] = True
        lo, hi = self.at[docs], self.at[docs + 1]
        rows = _ranges(lo, hi)
        has = self.asked[self.term[rows]]
        of = np.repeat(np.arange(len(docs)), hi - lo)[has]
        self.asked[local] = False
        return np.round(np.bincount(of, self._weight(rows[has], docs[of]), len(docs)), 9)

    def search(self, query: np.ndarray, k: int, least: float = 0.0) -> list[tuple[float, int | None]]:
        """The k best (score, document id) that reach ``least``; ``query`` has term numbers, ascending."""
        local = self.local[query]
        local = local[local >= 0]
        if not len(local):
            return []
        n = self.first[local + 1] - self.first[local]
        # The rarest first.
        turn = np.argsort(n, kind="stable")
        rare, n = local[turn], n[turn]
        rest = np.append(np.cumsum(self.most[rare][::-1], dtype=np.float64)[::-1], 0.0) * (1 + SLACK)
        read = np.cumsum(n)
        self.all += int(read[-1])
        # Terms without block maxima are read whatever the pivot.
        sparse = np.flatnonzero(self.common[rare] < 0)
        always, done, got = int(sparse[-1]) + 1 if len(sparse) else 0, 0, np.zeros(len(self.ids))
        if not least:
            done = max(int(np.searchsorted(read, read[-1] * HEAD)) + 1, always)
            got = self._partial(rare[:done])
            some = min(len(got), 2 * k)
            head = np.argpartition(-got, some - 1)[:some] if some < len(got) else np.arange(len(got))
            scores = self._exact(head, local)
            copies = np.repeat(scores, np.minimum([self.many[i] for i in head.tolist()], k))
            if len(copies) >= k:
                least = max(least, float(np.partition(copies, len(copies) - k)[len(copies) - k]))
        floor = least * (1 - SLACK) - 1e-9
        pivot = max(always, min(int(np.searchsorted(-rest, -floor, side="right")), len(rare)))
        if pivot > done:
            got = got + self._partial(rare[done:pivot]) if done else self._partial(rare[:pivot])
            done = pivot
        docs = np.flatnonzero(got > 0)
        total = got[docs]
        while done < len(rare):
            # What the terms from the pivot on can add at most, by block; then some of them are read.
            later = self.common[rare[done:]]
            bound = self.block_most[later].sum(axis=0)
            kept = total + bound[docs // BLOCK] * (1 + SLACK) >= floor
            docs, total = docs[kept], total[kept]
            part = rare[done : done + PART]
            total = total + self._added(part, docs)
            self.read += len(part) * len(docs)
            done += PART
        if len(total) > k:
            # Counting documents never overstates the rows that they stand for.
            floor = max(floor, np.partition(total, len(total) - k)[len(total) - k] * (1 - 2 * SLACK))
        docs = docs[total >= floor * (1 - SLACK)]
        if not len(docs):
            return []
        return self._best(docs, self._exact(docs, local), k, least)

    def _best(self, docs: np.ndarray, scores: np.ndarray, k: int, least: float) -> list[tuple[float, int | None]]:
        best = []
        ids = [self.ids[d] for d in docs.tolist()]
        for i in np.lexsort(([-1 if d is None else d for d in ids], [d is not None for d in ids], -scores)).tolist():
            if scores[i] <= 0 or scores[i] < least or len(best) >= k:
                break
            best += [(float(scores[i]), ids[i])] * min(self.many[int(docs[i])], k - len(best))
        return best

    def search_many(self, queries: list[np.ndarray], k: int, least: list[float]) -> list[list[tuple[float, int | None]]]:
        """What :meth:`search` finds for each query; all are scored together, group by group.

        A group is left out for a query if the sum of its largest weights
        there stays below the query's threshold.
        """
        row = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        local = self.local[np.concatenate(queries)]
        row, local = row[local >= 0], local[local >= 0]
        self.all += int((self.first[local + 1] - self.first[local]).sum())
        # Each term is looked up in a group once, whatever number of queries has it.
        self.asked[local] = True
        known = np.flatnonzero(self.asked)
        self.asked[known] = False
        number = np.zeros(self.terms, np.int64)
        number[known] = np.arange(len(known))
        number = number[local]
        # A sum of floats has as many additions as a query's terms, or a group's common terms, at most.
        loose = 1 + ROUNDING * (np.array([len(q) for q in queries]) + FULL + 16)
        floor = np.maximum(np.array(least) / loose - 1e-9, 1e-30)
        best = np.zeros((len(queries), k), np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for g, (whole, tiles, most) in enumerate(self.whole):
            a, docs = self.starts[g], whole.shape[1]
            lo, column = self.cut[known + g * self.terms].astype(np.int64), self.column[g][known]
            n = self.cut[known + (g * self.terms + 1)] - lo
            has = np.flatnonzero((n > 0)[number])
            at, term = row[has], number[has]
            live = np.flatnonzero(np.bincount(at, self.top[g][known][term], len(queries)) * loose >= floor)
            if not len(live):
                continue
            if len(live) < len(queries):
                place = np.full(len(queries), -1)
                place[live] = np.arange(len(live))
                at = place[at]
                has = np.flatnonzero(at >= 0)
                at, term = at[has], term[has]
            whole_at = column[term]
            common = np.flatnonzero(whole_at >= 0)
            asked = np.zeros((len(live), len(whole)), np.float32)
            asked[at[common], whole_at[common]] = 1
            rare = np.flatnonzero(whole_at < 0)
            at, rare = at[rare] * docs, term[rare]
            if len(self.part) < len(live) * docs:
                self.part = np.zeros(len(live) * docs, np.float32)
            part = self.part[: len(live) * docs]
            part.fill(0)
            n = n[rare]
            ends = np.cumsum(n)
            # The postings of all, counted on, less this are where they are.
            lo = lo[rare] - ends + n
            cuts = np.searchsorted(ends, np.arange(POSTS, ends[-1], POSTS)).tolist() if len(ends) else []
            read = 0
            for first, last in zip([0, *cuts], [*cuts, len(rare)], strict=True):
                where = np.repeat(lo[first:last], n[first:last])
                where += np.arange(read, read + len(where))
                pairs = self.pairs.take(where)
                where = np.repeat(at[first:last], n[first:last])
                where += pairs.view(np.int32)[::2]
                np.add.at(part, where, np.ascontiguousarray(pairs.view(np.float32)[1::2]))
                read += len(where)
            self.read += read
            part = part.reshape(-1, docs)
            bound = (asked @ most + np.maximum.reduceat(part, tiles, axis=1)) * loose[live, None]
            for i, first in enumerate(tiles.tolist()):
                near = np.flatnonzero(bound[:, i] >= floor[live])
                if not len(near):
                    continue
                total = asked[near] @ whole[:, first : first + TILE]
                total += part[near, first : first + TILE]
                self.read += len(near) * total.shape[1] * len(whole)
                own = live[near]
                reach = total >= floor[own, None]
                if not reach.any():
                    continue
                many = np.flatnonzero(np.count_nonzero(reach, axis=1) > k)
                if len(many):
                    # Counting documents never overstates the rows that they stand for.
                    top = np.hstack([best[own[many]], np.partition(total[many], total.shape[1] - k, axis=1)[:, -k:]])
                    best[own[many]] = top = np.partition(top, k, axis=1)[:, k:]
                    floor[own[many]] = np.maximum(floor[own[many]], top.min(axis=1) / loose[own[many]] ** 3)
                    reach[many] = total[many] >= floor[own[many], None]
                r, d = np.divmod(np.flatnonzero(reach), total.shape[1])
                found.append((own[r], d + (a + first), total[r, d]))
        out: list[list[tuple[float, int | None]]] = [[] for _ in queries]
        if not found:
            return out
        rows, docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.flatnonzero(scores >= floor[rows])
        keep = keep[np.argsort(rows[keep], kind="stable")]
        rows, docs = rows[keep], docs[keep]
        ends, of = np.searchsorted(rows, np.arange(len(queries) + 1)).tolist(), np.searchsorted(row, np.arange(len(queries) + 1)).tolist()
        for i in range(len(queries)):
            if ends[i] < ends[i + 1]:
                own = docs[ends[i] : ends[i + 1]]
                out[i] = self._best(own, self._exact(own, local[of[i] : of[i + 1]]), k, least[i])
        return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    n = hi - lo
    out = np.repeat(lo - np.cumsum(n) + n, n)
    out += np.arange(len(out))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words, chars, hashes, tf) of (id, text)."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        size, hashes, tf = zip(*map(_counts, texts), strict=True) if texts else ((), (), ())
        cols = [pa.array(size, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(hashes, pa.binary()), pa.array(tf, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "words", "chars", "hashes", "tf"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's documents (words, chars, hashes), in parts; under the null term its documents, words and characters."""
    docs = words = chars = waiting = 0
    terms_, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[np.ndarray] = []

    def merge() -> None:
        nonlocal terms_, df, waiting
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
        both, n = np.concatenate([terms_, new]), np.concatenate([df, n])
        order = both.argsort(kind="stable")
        both, n = both[order], n[order]
        first = np.flatnonzero(np.diff(both, prepend=both[:1] - 1)) if len(both) else np.zeros(0, np.int64)
        terms_, df, waiting = both[first], np.add.reduceat(n, first) if len(first) else n, 0
        parts.clear()

    def out(size: tuple[int, int, int] | None) -> pa.RecordBatch:
        zero = np.zeros(len(terms_), np.int64)
        cols = [pa.array(c) for c in (terms_, df, zero, zero)]
        if size:
            cols = [pa.concat_arrays([c, pa.array([x], pa.int64())]) for c, x in zip(cols, (None, *size), strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=["term", "df", "words", "chars"])

    for batch in batches:
        docs, words, chars = docs + len(batch), words + sum(batch.column(0).to_pylist()), chars + sum(batch.column(1).to_pylist())
        for hashes in batch.column(2).to_pylist():
            parts.append(np.frombuffer(hashes, "<i8"))
            waiting += len(parts[-1])
        if waiting >= GATHERED:
            merge()
            if len(terms_) >= COUNTED:
                yield out(None)
                terms_, df = terms_[:0], df[:0]
    merge()
    yield out((docs, words, chars))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.sort(_hashes(set(terms(t)))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["query_id", "terms"]
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, blob): a query's ascending term numbers as compressed differences."""
    for batch in batches:
        blobs = [zlib.compress(np.diff(np.array(t, np.int64), prepend=0).astype("<u4").tobytes(), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["query_id", "blob"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, hashes, df) of (page, terms): a part of the dictionary as bytes."""
    for batch in batches:
        hashes, df = [], []
        for rows in batch.column(1).to_pylist():
            hashes.append(np.array([r["term"] for r in rows], "<i8").tobytes())
            df.append(zlib.compress(np.array([r["df"] for r in rows], "<i8").tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hashes, pa.binary()), pa.array(df, pa.binary())], names=["first", "hashes", "dfs"]
        )


def _search_shards(k: int, mean: float, n: int):
    """Input sorted by shard: the dictionary, then documents, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, open_ = None, None, False
        rows: list[tuple] = []
        waiting: list[tuple[int, np.ndarray, float]] = []
        asked = 0

        def search() -> None:
            """The waiting queries, together."""
            nonlocal asked
            keys, queries, least = zip(*waiting, strict=True)
            for key, best in zip(keys, index.search_many(list(queries), k, list(least)), strict=True):
                rows.extend((key, d, s) for s, d in best)
            waiting.clear()
            asked = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "doc_id", "score"])

        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "kind", "id", "size", "blob", "more", "least")]
            for shard, kind, key, size, blob, more, least in zip(*(c.to_pylist() for c in cols), strict=True):
                if shard != now:
                    if waiting:
                        search()
                    now, index, open_ = shard, Shard(mean, n), True
                if kind == 0:
                    index.page(key, blob, more)
                elif kind == 1:
                    index.put(key, size, blob, more)
                else:
                    if open_:
                        index.close()
                        give_back()
                        open_ = False
                    query = np.cumsum(np.frombuffer(zlib.decompress(blob), "<u4"), dtype=np.int64)
                    if len(query) < SHORT:
                        rows.extend((key, d, s) for s, d in index.search(query, k, least))
                        continue
                    waiting.append((key, query, least))
                    asked += len(query)
                    if len(waiting) >= TOGETHER or asked >= ASKED:
                        search()
            yield out()
        if waiting:
            search()
        yield out()

    return run


def _numbered(dictionary: DataFrame) -> DataFrame:
    """(term, df, code): dense numbers, the commonest first."""
    spark = dictionary.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(dictionary.repartitionByRange(parts, F.desc("df"), "term").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    # One row for each partition.
    start = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))
    w = Window.partitionBy("part").orderBy(F.desc("df"), "term")
    code = F.col("start") + F.row_number().over(w) - 1
    return stored(dealt.join(start, "part").select("term", "df", code.alias("code")))


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each query.

    ``docs``: doc_id, text; ``queries``: query_id (not null, unique), text.
    """
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), whole_text().alias("text"))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), whole_text().alias("text"))
    parted = docs.mapInArrow(tidy(_counted), "id bigint, words bigint, chars bigint, hashes binary, tf binary")
    parted = stored(parted.withColumn("dealt", F.xxhash64("id", "hashes", "tf")))
    counted = parted.select("words", "chars", "hashes").mapInArrow(tidy(_count_terms), "term bigint, df bigint, words bigint, chars bigint")
    sums = stored(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "words", "chars")]))
    size = sums.where("term is null").first()
    n, words, chars = (size["df"] or 0, size["words"] or 0, size["chars"] or 0) if size else (0, 0, 0)
    mean = words / n if words else 1.0
    own = stored(
        asked.mapInArrow(_query_terms, "query_id bigint, terms array<bigint>").select("query_id", F.explode("terms").alias("term"))
    )
    dictionary = _numbered(sums.select("term", "df").join(own.select("term").distinct(), "term"))
    numbers = own.join(dictionary.select("term", F.col("code").cast("int").alias("code")), "term")
    numbers = numbers.groupBy("query_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    packed = stored(numbers.mapInArrow(_packed, "query_id bigint, blob binary"))
    page = F.floor(F.col("code") / PAGE) * PAGE
    pages = dictionary.groupBy(page.cast("bigint").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("code", "term", "df"))).alias("terms")
    )
    pages = stored(pages.mapInArrow(_pages, "first bigint, hashes binary, dfs binary"))

    shards, tasks = max(1, -(-chars // shard_chars)), max(1, spark.sparkContext.defaultParallelism)
    if shards > 1:
        # As many as keep all cores busy in each round; the results are the same for any number.
        shards = -(-shards // tasks) * tasks
    shard = F.pmod("dealt", F.lit(shards)).cast("int")
    empty = {"size": "bigint", "blob": "binary", "more": "binary", "least": "double"}

    def row(kind: int, key: str, **given: str) -> list:
        return [F.lit(kind).alias("kind"), F.col(key).alias("id")] + [
            (F.col(given[c]) if c in given else F.lit(None).cast(t)).alias(c) for c, t in empty.items()
        ]

    def searched(first: int, last: int, least: DataFrame) -> DataFrame:
        """The rows of the shards from ``first`` to before ``last``."""
        each = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("shard")
        dealt = parted.select(shard.alias("shard"), *row(1, "id", size="words", blob="hashes", more="tf")).where(F.col("shard").between(first, last - 1))
        both = (
            dealt.unionByName(pages.select(each, *row(0, "first", blob="hashes", more="dfs")))
            .unionByName(least.select(each, *row(2, "query_id", blob="blob", least="least")))
            .repartitionById(last - first, (F.col("shard") - first).cast("int"))
            .sortWithinPartitions("shard", "kind")
        )
        return both.mapInArrow(tidy(_search_shards(k, mean, n)), "query_id bigint, doc_id bigint, score double")

    found, first, many = None, 0, tasks
    while first < shards:
        last = min(shards, first + many)
        least = packed.withColumn("least", F.lit(0.0))
        if found is not None:
            kth = found.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("kth"))
            least = packed.join(kth, "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(0.0)))
        more = stored(searched(first, last, least))
        found = more if found is None else found.unionByName(more)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
        first, many = last, last
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, itself among them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % QUERY_EVERY == 0).withColumnRenamed("doc_id", "query_id")
    return top_k(docs, queries).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


OP5_SQL = r"""
with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from w group by all),
len as (select doc_id, count(*) as dl from w group by doc_id),
n as (select (select count(*) from documents) as n, (select sum(dl) from len) / (select count(*) from documents) as mean),
df as (select term, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, n group by term),
s as (select q.doc_id as query_id, d.doc_id, sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / n.mean))) as score
      from tf q join tf d using (term) join df using (term) join len on len.doc_id = d.doc_id cross join n
      where q.doc_id % 20 = 0 group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s)
select query_id, cast(rank as integer) as rank, doc_id, round(score, 4) as score from r where rank <= 10
"""
