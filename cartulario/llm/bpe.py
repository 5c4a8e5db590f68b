"""Encoding texts with a public byte-level BPE vocabulary by speculation and verification."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulario.session import spread

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's authors cut a text into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words that a worker remembers; beyond that it begins anew. Results do not depend on it.
REMEMBERED = 400_000


class Speculator:
    """Encodes words: greedy longest matches, a check of every adjacent pair, exact merging where one fails.

    A sequence of tokens is the BPE encoding of its bytes if each token encodes to
    itself and each adjacent pair encodes to that pair. Both facts are found once per
    token and pair by exact merging and kept.
    """

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.longest = max(map(len, self.ranks))
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.base = max(self.tokens) + 1
        self.own: dict[int, bool] = {}
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.words: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.words.clear()
        self.flat = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: always merge the adjacent pair of lowest rank, leftmost first."""
        if len(word) > 512:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list, for runs of any length."""
        import heapq

        ranks, n = self.ranks, len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(parts[i] + parts[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[p] for p in parts if p is not None]

    def greedy(self, word: bytes) -> list[int]:
        """Longest token at each place; single bytes are all tokens, so it always ends."""
        ranks, out, at, n = self.ranks, [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                rank = ranks.get(word[at:end])
                if rank is not None:
                    out.append(rank)
                    at = end
                    break
        return out

    def _stands(self, token: int) -> bool:
        found = self.own.get(token)
        if found is None:
            found = self.own[token] = self.merge(self.tokens[token]) == [token]
        return found

    def _check(self, keys: np.ndarray) -> np.ndarray:
        """Which of the pairs (left * base + right) stay as they are when their bytes are encoded."""
        fresh = np.setdiff1d(keys, self.pairs)
        if len(fresh):
            fits = np.fromiter(
                (self.merge(self.tokens[k // self.base] + self.tokens[k % self.base]) == [k // self.base, k % self.base] for k in fresh.tolist()),
                bool,
                len(fresh),
            )
            pairs = np.concatenate([self.pairs, fresh])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits])[order]
        return self.fits[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> None:
        """Encode words not seen yet and append them to the flat store."""
        if len(self.words) + len(words) > REMEMBERED:
            self._reset()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.ranks.get(b) for b in raw]
        guesses = [[t] if t is not None and self._stands(t) else self.greedy(b) for t, b in zip(whole, raw)]
        counts = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        bad = np.zeros(len(words), bool)
        unsound = ~np.fromiter(map(self._stands, flat.tolist()), bool, len(flat))
        bad[owner[unsound]] = True
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            keys = (flat[:-1] * self.base + flat[1:])[inside]
            if len(keys):
                unique, back = np.unique(keys, return_inverse=True)
                bad[owner[1:][inside][~self._check(unique)[back]]] = True
        for i in np.flatnonzero(bad).tolist():
            guesses[i] = self.merge(raw[i])
        first = len(self.words)
        for i, w in enumerate(words):
            self.words[w] = first + i
        counts = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int32, int(counts.sum()))
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; null and empty texts have none."""
        split = _splitter()
        lists = [split(t) if t else [] for t in texts]
        known = self.words
        fresh = {w for ws in lists for w in ws} - known.keys()
        if fresh:
            if len(known) + len(fresh) > REMEMBERED:
                self._reset()
                fresh = {w for ws in lists for w in ws}
            self.learn(sorted(fresh))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter((known[w] for ws in lists for w in ws), np.int64, int(sizes.sum()))
        begin, lengths = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(lengths)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - lengths), lengths)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        reach = np.concatenate([[0], ends])
        return self.flat[take], np.diff(reach[bounds])


def _splitter():
    return regex.compile(WORDS).findall


@lru_cache(maxsize=2)
def speculator(path: str) -> Speculator:
    """One per worker process and vocabulary."""
    return Speculator(path)


def _pieces(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, so that long texts do not fill the memory."""
    at, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if size + n > most and i > at:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def encode_texts(df: DataFrame, record: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids (``doc_id``, ``ids``) of every text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts
    both give an empty list. Repeated rows come out as often as they come in; other
    columns are not read. Narrow: no shuffle; a worker keeps the words it has seen.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        model = speculator(path)
        for batch in batches:
            for part in _pieces(batch, 1):
                flat, sizes = model.encode(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    kind = df.schema[record].dataType.simpleString()
    slim = df.select(F.col(record).alias("doc_id"), F.col(text).alias("__text"))
    return spread(slim).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of each text; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}"
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        model = speculator(path)
        for batch in batches:
            for part in _pieces(batch, width):
                _, sizes = model.encode(part.column(width).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(sizes, pa.int64())], [*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, f"{kinds}, tokens long")
