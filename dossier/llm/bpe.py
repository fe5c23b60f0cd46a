"""BPE encoding and decoding of a word-end vocabulary: speculate, verify, merge what fails."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# fixed values of the vocabulary's format
WORD_END = "</w>"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Bytes of stretches, and of words, that a task remembers before it empties that memory.
REMEMBERED = 160 << 20
#: Bytes an entry takes besides its letters, and the pairs of tokens remembered at most.
ENTRY = 350
PAIRS = 2_000_000
#: Letters from which on a word is merged with a heap, as looking for the least rank gets dear.
LONG = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file; words met before are remembered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.rank: dict[tuple[str, str], int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            self.rank[tuple(pair if isinstance(pair, list) else pair.split(" "))] = n
        # longest token that begins with these one, two or three letters: no longer one is tried there
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            size = len(t) - len(WORD_END) if t.endswith(WORD_END) and len(t) > len(WORD_END) else len(t)
            for k in range(1, min(size, 3) + 1):
                self.reach[t[:k]] = max(self.reach.get(t[:k], 0), size)
        self.letters = byte_letters()
        self.pretoken = regex.compile(PRETOKEN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.space = regex.compile(r"\p{White_Space}+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.pairs = np.zeros(0, np.int64)  # pairs of tokens tested so far, in order
        self.stands = np.zeros(0, bool)  # whether the two stay apart when merged together
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.held = self.held_words = 0
        self.failed = self.proposed = 0

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging: again and again the leftmost pair of the lowest rank."""
        if len(symbols) > LONG:
            return self.merged_long(symbols)
        symbols, rank, none = list(symbols), self.rank.get, 1 << 30
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), none)
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), none)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """The same for any length: pairs in a heap by rank and place, symbols linked to their neighbours."""
        symbols, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # an entry of a pair that has changed since is passed over
            if symbols[i] is None or j >= n or self.rank.get((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := self.rank.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [s for s in symbols if s is not None]

    @staticmethod
    def split(token: str) -> list[str]:
        """Base symbols of a token or word; the word end belongs to the last letter."""
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(token)

    def greedy(self, word: str) -> list[int] | None:
        """Longest matching token at every position; None where no token fits."""
        out, at, n = [], 0, len(word)
        vocab, reach = self.vocab.get, self.reach.get
        while at < n:
            # without a token of three (two) letters as here, only shorter ones can fit
            size = reach(word[at : at + 3]) or reach(word[at : at + 2]) or reach(word[at], 0)
            if at + size >= n:
                size = n - at
                got = vocab(word[at:] + WORD_END)
                if got is not None:
                    out.append(got)
                    return out
                size -= 1
            while size > 0:
                got = vocab(word[at : at + size])
                if got is not None:
                    out.append(got)
                    at += size
                    break
                size -= 1
            else:
                return None
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For every pair code whether its two tokens stay as they are when their letters are merged."""
        asked = np.unique(codes)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
            fresh = asked[self.pairs[at] != asked]
        else:
            fresh = asked
        if len(fresh):
            verdict = []
            for code in fresh.tolist():
                pair = [self.token[x] for x in (code >> 20, code & 0xFFFFF) if x != 0xFFFFF]
                verdict.append(self.merged([s for t in pair for s in self.split(t)]) == pair)
            pairs, stands = np.r_[self.pairs, fresh], np.r_[self.stands, np.array(verdict, bool)]
            order = np.argsort(pairs)
            self.pairs, self.stands = pairs[order], stands[order]
        return self.stands[np.searchsorted(self.pairs, codes)]

    def encoded(self, words: list[str]) -> dict[str, list[int]]:
        """Tokens of distinct words: proposals for all, one vectorised test, merging for the rest."""
        letters = self.letters
        spelled = ["".join([letters[b] for b in w.encode("utf-8")]) for w in words]
        proposals = [self.greedy(s) for s in spelled]
        sizes = np.array([len(p) if p else 0 for p in proposals], np.int64)
        flat = np.array([t for p in proposals if p for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        good = sizes > 0
        if len(flat):
            inner = owner[1:] == owner[:-1]
            lone = np.repeat(sizes == 1, sizes)
            codes = np.r_[(flat[:-1] << 20 | flat[1:])[inner], flat[lone] << 20 | 0xFFFFF]
            who = np.r_[owner[1:][inner], owner[lone]]
            good[who[~self.compatible(codes)]] = False
        self.proposed += len(words)
        self.failed += int((~good).sum())
        return {
            w: p if ok else [self.vocab[t] for t in self.merged(self.split(s + WORD_END))]
            for w, s, p, ok in zip(words, spelled, proposals, good.tolist())
        }

    def learn(self, chunks: set[str]) -> None:
        """Ids and decoded form of chunks (stretches without white space) not met before."""
        split = {c: self.pretoken.findall(c) for c in chunks}
        if self.held_words > REMEMBERED:
            self.words.clear()
            self.held_words = 0
        if len(self.pairs) > PAIRS:
            self.pairs, self.stands = self.pairs[:0], self.stands[:0]
        words, token = self.words, self.token
        fresh = sorted({w for ws in split.values() for w in ws if w not in words})
        for w, own in self.encoded(fresh).items():
            words[w] = np.array(own, "<u4").tobytes(), " ".join([token[t] for t in own])
            self.held_words += ENTRY + 8 * len(w)
        for chunk, ws in split.items():
            if len(ws) == 1:
                self.ids[chunk], self.shown[chunk] = words[ws[0]]
            else:
                known = [words[w] for w in ws]
                self.ids[chunk] = b"".join([x for x, _ in known])
                self.shown[chunk] = " ".join([x for _, x in known])
            self.held += ENTRY + 8 * len(chunk)

    def chunks(self, text: str) -> list[str]:
        """Stretches without white space, normalised; pre-tokens never cross them."""
        if not text.isascii():
            # lower-casing letter by letter knows no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split also cuts at U+001C to U+001F, which are no white space here
        return self.space.split(text) if self.odd.search(text) else text.split()

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """A text cut at the strings of special tokens."""
        return [(p, p in self.special) for p in self.cut.split(text) if p]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian 32-bit numbers, and the decoded text, of every text."""
        if self.held > REMEMBERED:
            self.ids.clear()
            self.shown.clear()
            self.held = 0
        ids, shown = self.ids, self.shown
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        marked = {n: self.parts(t) for n, t in enumerate(texts) if any(s in t for s in special)}
        split = [[] if n in marked else self.chunks(t) for n, t in enumerate(texts)]
        cut = {n: [(p, None if is_special else self.chunks(p)) for p, is_special in own] for n, own in marked.items()}
        fresh = {c for cs in split for c in cs if c not in ids}
        fresh |= {c for own in cut.values() for _, cs in own for c in cs or () if c not in ids}
        self.learn(fresh)
        out_ids = [b"".join([ids[c] for c in cs]) for cs in split]
        out_shown = [" ".join([shown[c] for c in cs if ids[c]]) if "" in cs else " ".join([shown[c] for c in cs]) for cs in split]
        for n, own in cut.items():
            out_ids[n] = b"".join([special[p] if cs is None else b"".join([ids[c] for c in cs]) for p, cs in own])
            out_shown[n] = " ".join([x for p, cs in own for x in ([p] if cs is None else [shown[c] for c in cs if ids[c]])])
        return out_ids, out_shown


def encode_documents(docs: DataFrame, path: str | None = None, whole: bool = False) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    In: ``doc_id`` and ``text`` (NULL: empty); other columns are ignored, repeated rows each give a
    row. Out: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers),
    decoded_sha256; with ``whole`` also ids (binary) and decoded. An empty text has no tokens and
    decodes to the empty text. ``path``: vocabulary file, the same on every executor.
    """
    path = path or default_vocabulary()
    extra = ", ids binary, decoded string" if whole else ""

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            _, offs = C.buffers(batch.column("text"))
            for a, b in C.pieces(offs):
                ids, shown = codec.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                columns = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if whole:
                    columns += [pa.array(ids, pa.binary()), pa.array(shown)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
