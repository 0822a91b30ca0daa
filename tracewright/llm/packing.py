"""Cost-balanced packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import functools
import heapq
import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.textops import run_gather, slices, words

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Sequences that one packing group fills; a group is what a task holds at once.
GROUP_SEQUENCES = 512
#: Attention's quadratic share: cost of a piece of L tokens is L + L^2 / (6 * MODEL_WIDTH).
MODEL_WIDTH = 2048
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 1_000_000

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, tokens binary"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """ids of texts by a tokenizer that never joins across white space: each distinct word is encoded once.

    A full stop or comma after a letter or digit is a token run of its own, so it is looked up apart from its word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.fresh: list[list[int]] = []
        self._add("", [END_ID])  # entry 0 ends a document

    def _add(self, word: str, ids: list[int]) -> int:
        self.known[word] = k = len(self.known)
        self.fresh.append(ids)
        return k

    def _settle(self) -> None:
        """Moves what was encoded since the last call into the arrays."""
        if self.fresh:
            lengths = np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(self.fresh), np.uint32, int(lengths.sum()))])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.fresh = []

    def _of(self, k: int) -> list[int]:
        settled = len(self.lengths)
        return self.fresh[k - settled] if k >= settled else self.flat[self.starts[k] : self.starts[k] + self.lengths[k]].tolist()

    def _ids(self, word: str) -> list[int]:
        if word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word):  # normalising changes nothing: one run of letters
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            return [t.id for t in self.tokenizer.model.tokenize(word)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def entry(self, word: str) -> int:
        k = self.known.get(word)
        if k is not None:
            return k
        if len(word) > 1 and word[-1] in ".," and word[-2].isalnum():
            return self._add(word, self._of(self.entry(word[:-1])) + self._of(self.entry(word[-1])))
        return self._add(word, self._ids(word))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids, each document ended by END_ID, and int64 offsets of the documents."""
        w = words(texts)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        vocabulary = w.dictionary.to_numpy(zero_copy_only=False).tolist()
        get, entry = self.known.get, self.entry
        index = np.fromiter((k if (k := get(x)) is not None else entry(x) for x in vocabulary), np.int64, len(vocabulary))
        self._settle()
        entries = np.insert(index[w.codes], w.offsets[1:], 0)
        lengths = self.lengths[entries]
        ids = self.flat[run_gather(self.starts[entries], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[w.offsets + np.arange(len(w.offsets))]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker: later tasks find their words encoded."""
    return WordTokenizer(path)


def piece_cost(length):
    return length + np.square(length, dtype=np.float64) / (6 * MODEL_WIDTH)


def assign(lengths: list[int], capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Places documents, longest first, in the sequence of lowest cost that has room; where none has room, the
    document is cut to fill the cheapest one. Full sequences, then powers of two for the rest, so nothing is padded.
    Returns (document, start, length, sequence, offset)."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        b = int(fits.argmin())
        if fits[b] == np.inf:
            b = int(np.where(room > 0, cost, np.inf).argmin())
            taken = int(room[b])
            heapq.heappush(queue, (taken - n, i, start + taken))
            n = taken
        out.append((i, start, n, b, sizes[b] - int(room[b])))
        room[b] -= n
        cost[b] += piece_cost(n)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, cost, tokens (little-endian uint32).

    Each task tokenises its documents, gives every whole run of `capacity` tokens a sequence of its own, and packs the
    rest in groups of group_sequences sequences; no shuffle, and memory is one group. A group's last tokens go to
    sequences whose lengths are powers of two, so no sequence needs padding. sequence_id holds the partition in its
    upper bits. Null text is the empty text and yields the end token alone; a null id stays null; repeated rows are
    packed each for itself; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_tokenizer(tokenizer_path)
        serial = TaskContext.get().partitionId() << 40
        pool: list[tuple[object, int, int, np.ndarray]] = []
        held = 0

        def table(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "tokens"])

        def flush() -> pa.RecordBatch:
            nonlocal serial, held, pool
            placed = assign([len(x[3]) for x in pool], capacity)
            found = []
            for i, start, n, b, offset in placed:
                doc, base, all_tokens, ids = pool[i]
                found.append((doc, base + start, n, all_tokens, serial + b, offset, float(piece_cost(n)), ids[start : start + n].tobytes()))
            serial += max(x[3] for x in placed) + 1
            pool, held = [], 0
            return table(found)

        for part in slices(batches, "text"):
            ids, offsets = encode(part.column("text"))
            ids = ids.astype("<u4")
            whole = []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a
                rest = n % capacity
                for start in range(0, n - rest, capacity):
                    whole.append((doc, start, capacity, n, serial, 0, float(piece_cost(capacity)), ids[a + start : a + start + capacity].tobytes()))
                    serial += 1
                    if len(whole) >= 1024:
                        yield table(whole)
                        whole = []
                if rest:
                    pool.append((doc, n - rest, n, ids[b - rest : b].copy()))
                    held += rest
                    if held >= capacity * group_sequences:
                        yield flush()
            if whole:
                yield table(whole)
        if pool:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)
