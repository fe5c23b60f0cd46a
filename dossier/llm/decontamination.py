"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its question and answer shingles it must hold.
THRESHOLD = 0.5
OVERLAP = 0.8
BLOCK = 16
#: Items of one index. More items are dealt to several indexes, each with its own pass over the documents.
ITEMS = 5000


_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(width):
        out = C.mix(out + h[k : k + n])
    return out


def _words(data: np.ndarray, offs: np.ndarray):
    """Words between white space or ASCII punctuation, so that marks stuck to a word change nothing."""
    return C.words(_SPACED[data], offs)


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the question and of the answer: the last sentence, or the last quarter of a single one."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _, h = _words(data, np.array([0, len(data)]))
    raw = data.tobytes()
    ends = [i for i in range(len(h) - 1) if raw[end[i] : end[i] + 1] in (b".", b"?", b"!")]
    cut = ends[-1] + 1 if ends else len(h) - max(1, len(h) // 4)
    return h[:cut], h[cut:]


class Index:
    """Inverted index with impact-scored postings in blocks; scores are shares of each item's own score."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        words = [np.concatenate(p) for p in self.parts]
        self.longest = max(map(len, words), default=1)
        mean = max(1.0, sum(map(len, words)) / max(1, len(words)))
        counts = [np.unique(w, return_counts=True) for w in words]
        self.vocabulary, df = np.unique(np.concatenate([c[0] for c in counts] or [np.zeros(0, U)]), return_counts=True)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for n, (kinds, tf) in enumerate(counts):
            at = np.searchsorted(self.vocabulary, kinds)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[n]) / mean))
            own = weight.sum()
            for t, w in zip(at.tolist(), (weight / own if own else weight).tolist()):
                postings[t].append((n, w))
        # what the overlap check will ask for: some shingle of a question, or a whole short item
        self.marks = {}
        for question, answer in self.parts:
            part = question if len(question) else answer
            w = min(C.WORDS, len(part))
            self.marks.setdefault(w, []).append(_windows(part, w))
        self.marks = {w: np.unique(np.concatenate(x)) for w, x in self.marks.items() if w}
        self.seen = {w: np.zeros(1 << 20, bool) for w in self.marks}
        for w, x in self.marks.items():
            self.seen[w][x >> U(44)] = True
        self.docs = [[n for n, _ in p] for p in postings]
        self.weights = [[w for _, w in p] for p in postings]
        self.most = np.array([max(w) for w in self.weights], float)
        self.blocks = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items with a score of ``threshold`` or more, by block-max WAND."""
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # best score within the blocks that hold the pivot item
            bound, until = 0.0, 1 << 60
            for c in cursors[: pivot + 1]:
                docs, at = self.docs[c[2]], c[1]
                block = at // BLOCK
                while docs[min(len(docs), (block + 1) * BLOCK) - 1] < item and (block + 1) * BLOCK < len(docs):
                    block += 1
                last = docs[min(len(docs), (block + 1) * BLOCK) - 1]
                if last >= item:
                    bound += self.blocks[c[2]][block]
                    until = min(until, last)
            if bound < threshold - 1e-9:
                # only items whose block maxima were summed may be passed over
                stop = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
                self._advance(cursors, pivot, max(item + 1, min(until + 1, stop)))
            elif cursors[0][0] == item:
                score = sum(self.weights[t][at] for d, at, t in cursors if d == item)
                if score >= threshold - 1e-9:
                    found.append((item, score))
                self._advance(cursors, pivot, item + 1)
            else:
                self._advance(cursors, pivot - 1 if cursors[pivot][0] > item else pivot, item)
        return found

    def _advance(self, cursors: list, upto: int, target: int) -> None:
        for c in cursors[: upto + 1]:
            docs, at = self.docs[c[2]], c[1]
            while at < len(docs) and docs[at] < target:
                at += 1
            c[0], c[1] = (docs[at], at) if at < len(docs) else (-1, at)
        cursors[:] = [c for c in cursors if c[0] >= 0]

    def marked(self, h: np.ndarray) -> np.ndarray:
        """Places in a run of words (of any number of texts) where a shingle of some question starts."""
        spots = []
        for w, x in self.marks.items():
            own = _windows(h, w)
            # the first bits rule nearly all places out, the rest is looked up
            maybe = np.flatnonzero(self.seen[w][own >> U(44)])
            spots.append(maybe[np.isin(own[maybe], x)])
        return np.concatenate(spots) if spots else np.zeros(0, np.int64)

    def matches(self, h: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """Item, best score, question and answer overlap of the items that a text's passages leak.

        A passage is two longest items long and starts one after the other, so that every item
        lies inside one. Passages whose best possible score is too low, or that hold no shingle of any
        question (at ``overlap`` above 0), are left out at once.
        """
        spots = self.marked(h)
        if not len(spots):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        known = np.flatnonzero(self.vocabulary[at] == h) if len(self.vocabulary) else np.zeros(0, np.int64)
        if not len(known):
            return []
        span, term = self.longest, at[known]
        first = known // span
        passage = np.concatenate([first, first[first > 0] - 1])
        code = np.unique(passage * len(self.vocabulary) + np.concatenate([term, term[first > 0]]))
        passage, term = code // len(self.vocabulary), code % len(self.vocabulary)
        bound = np.bincount(passage, self.most[term])
        best: dict[int, tuple[float, float, float]] = {}
        # a passage without a question shingle cannot pass the overlap check, whatever it scores
        marked = np.zeros(len(h) // span + 2, bool)
        marked[spots // span] = True
        marked[np.maximum(spots // span - 1, 0)] = True
        for p in np.flatnonzero((bound >= threshold - 1e-9) & marked[: len(bound)]).tolist():
            a, b = np.searchsorted(passage, [p, p + 1])
            words = h[p * span : (p + 2) * span]
            for item, score in self.search(term[a:b].tolist(), threshold):
                shares = []
                for part in self.parts[item]:
                    width = min(C.WORDS, len(part))
                    own = np.unique(_windows(part, width)) if width else np.zeros(0, U)
                    shares.append(float(np.isin(own, _windows(words, width)).mean()) if len(own) else 1.0)
                if min(shares) >= overlap:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, *shares))
        return [(item, *x) for item, x in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Documents that hold a test item: doc_id, item_id, score, question_overlap, answer_overlap.

    In: doc_id, text; item_id, text. Every passage of every whole text is a query; the items that
    score ``threshold`` of their own score or more are verified on the five-word shingles of
    question and answer (a shorter part as one). Words are runs of letters and digits. NULL texts and texts or items without words match nothing;
    repeated documents give repeated rows, equal items one row each; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    count = tests.count()
    shards = max(1, math.ceil(count / ITEMS))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for n in range(shards):
        own = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == n).orderBy("item_id", "text").collect()
        own = [(r.item_id, r.text) for r in own]

        def run(batches, own=own):
            index = Index(own)
            for batch in batches:
                data, offs = C.buffers(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                for a, b in C.pieces(offs):
                    _, _, row, h = _words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    at = np.searchsorted(row, np.arange(b - a + 1))
                    # texts without any question shingle give no rows; a shingle across two texts only adds a candidate
                    rows = [
                        (ids[a + r], index.ids[item], *rest)
                        for r in np.unique(row[index.marked(h)]).tolist()
                        for item, *rest in index.matches(h[at[r] : at[r + 1]], threshold, overlap)
                    ]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                        )

        found = base.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline stage: documents that hold a test item go, whether their doc_id is NULL, repeated or neither."""
    row = "_row" + "_" * max(map(len, docs.columns))
    named = docs.withColumn(row, C.row_key())
    found = contaminated(named.select(F.col(row).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(row)).distinct()
    return named.join(found, row, "left_anti").select(docs.columns)
