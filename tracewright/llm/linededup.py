"""Removal of passages that repeat: overlapping windows of three consecutive pieces of lines, found globally by their hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import discard, materialise
from tracewright.llm.textops import slices

#: Pieces of a window; words that a removed run or each window needs; most words of a line, and word gaps of which one at least ends a line.
WINDOW, LEAST_WORDS, WRAP = 3, 10, 10
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_STOP = np.isin(np.arange(256), list(b".!?"))
#: Masks of a number's first bytes; bytes from which on a word is hashed whole.
_BYTES, _LONG = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 64
_M, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _local(key: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Places whose key is the least of some WRAP places in a row, none of them fixed. Each depends on the keys less than
    WRAP places away and on nothing else; of equal keys close together one is taken in WRAP."""
    n = len(key)
    if n < WRAP:
        return np.zeros(n, bool)
    fixed_before = np.zeros(n + 1, np.int32)
    np.cumsum(fixed, out=fixed_before[1:])
    least = np.where(fixed_before[WRAP:] == fixed_before[:-WRAP], _spread(np.minimum, key), 0)
    # a place's key is no less than the least of any WRAP places that hold it: it is one of them if it is their greatest
    padded = np.zeros(n + WRAP - 1, np.uint64)
    padded[WRAP - 1 : n] = least
    greatest = _spread(np.maximum, padded)
    picked = (greatest == key) & (greatest > 0)
    at = np.flatnonzero(picked)
    if len(at):
        head = np.ones(len(at), bool)
        head[1:] = (key[at[1:]] != key[at[:-1]]) | (np.diff(at) >= WRAP)
        turn = (at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]) // WRAP
        picked[at[1:][~head[1:] & (turn[1:] == turn[:-1])]] = False
    return picked


def _spread(of: np.ufunc, x: np.ndarray) -> np.ndarray:
    """The least or greatest of each WRAP places in a row."""
    n, size = len(x) - WRAP + 1, 1
    while 2 * size <= WRAP:
        x, size = of(x[:-size], x[size:]), 2 * size
    return of(x[:n], x[WRAP - size :][:n])


def _wrap(begins: np.ndarray) -> np.ndarray:
    """Where lines begin if each also ends after WRAP words."""
    first = np.flatnonzero(begins)
    more = (np.diff(np.append(first, len(begins))) - 1) // WRAP
    if not more.any():
        return first
    total = more.sum()
    inner = np.repeat(first - WRAP * (np.cumsum(more) - more), more) + WRAP * np.arange(1, total + 1)
    wrapped = begins.copy()
    wrapped[inner] = True
    return np.flatnonzero(wrapped)


def _again(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places whose code came before in the same document. Both are small numbers: three of them fit in one, which is sorted."""
    n = max(1, len(doc))
    key = (doc * (1 + code.max(initial=0)) + code) * n + np.arange(len(doc))
    key.sort()
    at, key = key % n, key // n
    out = np.zeros(len(doc), bool)
    out[at[1:][key[1:] == key[:-1]]] = True
    return out


class Words:
    """The words of a column of texts, null ones empty, by their bytes. Words are maximal runs of anything but ASCII white
    space, whose bytes are never part of a longer character.

    data: the bytes of all texts; offsets: of each text in them; starts, ends: of each word in them; counts: words of each text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        word = np.ones(n + 2, bool)
        word[0] = word[-1] = False
        np.logical_not((self.data == 0x20) | (self.data - np.uint8(0x09) < 5), out=word[1:-1])
        begin, end = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
        begin[self.offsets], end[self.offsets] = word[1 + self.offsets], word[self.offsets]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end)
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))

    def hashes(self) -> np.ndarray:
        """A hash of each word: up to eight bytes differ in it with their length, longer words take eight more at a time."""
        aligned = np.zeros(len(self.data) // 8 + 2, "<u8")
        aligned.view(np.uint8)[: len(self.data)] = self.data

        def eight(at: np.ndarray, size: np.ndarray) -> np.ndarray:
            """The bytes from at on, eight at most, as a number."""
            k, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
            whole = (aligned[k] >> bits) | (aligned[k + 1] << (np.uint64(63) - bits) << np.uint64(1))
            return whole & _BYTES[np.minimum(size, 8)]

        size = self.ends - self.starts
        out = _mix(eight(self.starts, size) * _M + size.astype(np.uint64))
        rest, at = np.flatnonzero(size > 8), 8
        while len(rest) and at < _LONG:
            out[rest] = _mix(out[rest] * _M2 + eight(self.starts[rest] + at, size[rest] - at))
            at += 8
            rest = rest[size[rest] > at]
        for k in rest.tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[self.starts[k] : self.ends[k]], digest_size=8).digest(), "little")
        return out


class Lines:
    """The lines and windows of a column of texts. White space between words doesn't matter.

    What is counted: a line ends at a line feed, after a word that ends in . ! or ?, and after WRAP words; lines without a
    word don't count. What is searched, the pieces: where such a line is wrapped, pieces end between two words by the hash
    of both, so that equal passages are cut alike wherever they begin, but for less than WRAP words at their ends.

    words: see Words; doc: of each word; begins: whether a word begins a line that isn't wrapped; piece_doc, piece_word,
    n_words: of each piece. window_piece: the piece that each window begins with; window_hash: uint64;
    window_check: uint32, other bits of a hash of the same pieces."""

    def __init__(self, texts: pa.Array, per_run: bool = False):
        self.words = w = Words(texts)
        n = len(w.starts)
        self.doc = doc = np.repeat(np.arange(len(texts), dtype=np.int32), w.counts)
        # a word begins a line if its document, a line feed or a stop lies right before it
        self.begins = np.zeros(n + 1, bool)
        self.begins[np.cumsum(w.counts) - w.counts] = True
        self.begins[np.searchsorted(w.starts, np.flatnonzero(w.data == 0x0A))] = True
        self.begins = self.begins[:n]
        self.begins[1:] |= _STOP[w.data[w.ends[:-1] - 1]]
        of_word = w.hashes()
        pair = np.zeros(n, np.uint64)
        pair[1:] = _mix(of_word[:-1] * _M + of_word[1:])
        self.piece_word = first = _wrap(self.begins | _local(pair, self.begins))
        self.n_words = np.diff(np.append(first, n))
        self.piece_doc = doc[first].astype(np.int64)
        self.window_piece, self.window_hash, self.window_check = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        if len(first) >= WINDOW:
            powers = np.cumprod(np.full(WRAP, _M, np.uint64), dtype=np.uint64)
            piece = _mix(np.add.reduceat(of_word * powers[np.arange(n) - np.repeat(first, self.n_words)], first) + self.n_words.astype(np.uint64))
            m = len(first) - WINDOW + 1
            good = self.piece_doc[:m] == self.piece_doc[WINDOW - 1 :]
            if not per_run:
                good &= sum(self.n_words[k : k + m] for k in range(WINDOW)) >= LEAST_WORDS
            h, check = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            for k in range(WINDOW):
                h = _mix(h * _M + piece[k : k + m])
                check = _mix(check * _M2 + piece[WINDOW - 1 - k : WINDOW - 1 - k + m])
            self.window_piece, self.window_hash, self.window_check = np.flatnonzero(good), h[good], (check[good] >> np.uint64(32)).astype(np.uint32)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Which pieces lie in these windows (a mask over the windows), in runs of LEAST_WORDS words or more."""
        out = np.zeros(len(self.piece_doc) + WINDOW, bool)
        for k in range(WINDOW):
            out[self.window_piece[windows] + k] = True
        out = out[: len(self.piece_doc)]
        if out.any():
            head = np.ones(len(out), bool)
            head[1:] = (out[1:] != out[:-1]) | (self.piece_doc[1:] != self.piece_doc[:-1])
            out &= np.add.reduceat(self.n_words, np.flatnonzero(head))[np.cumsum(head) - 1] >= LEAST_WORDS
        return out


def windows(docs: DataFrame, id_col: str, text_col: str, per_run: bool = False) -> DataFrame:
    """h, check, doc_id, k: the distinct windows of each document; k is doc_id, or for a null id a hash of the text."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.when(docs[id_col].isNull(), F.xxhash64(text)).alias("k"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = Lines(part.column("text"), per_run)
            if len(x.window_piece):
                doc = x.piece_doc[x.window_piece]
                fresh = ~_again(doc, np.unique(x.window_hash, return_inverse=True)[1])
                at = pa.array(doc[fresh])
                yield pa.RecordBatch.from_arrays([pa.array(x.window_hash[fresh].view(np.int64)), pa.array(x.window_check[fresh].view(np.int32)), part.column("doc_id").take(at), part.column("k").take(at)], names=["h", "check", "doc_id", "k"])

    return rows.mapInArrow(run, "h long, check int, doc_id long, k long")


def cut(text: str | None, starts: np.ndarray, lengths: np.ndarray) -> str:
    """text without runs of its words; what is kept between two runs is stripped and set on a line of its own."""
    data = (text or "").encode()
    # white space bytes are never part of a longer character
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return _without(data, edges[::2][starts].tolist(), edges[1::2][starts + lengths - 1].tolist())


def _without(data: bytes, froms: list[int], tos: list[int]) -> str:
    kept = [data[a:b].decode().strip() for a, b in zip([0, *tos], [*froms, len(data)], strict=True)]
    return "\n".join(x for x in kept if x)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = (), per_run: bool = False) -> DataFrame:
    """doc_id, text (what is left), n_lines, removed_lines (all of whose words go), removed_words, spans (first word and
    number of words of each removed run), and the columns of keep.

    A window of three pieces (see Lines) repeats if a document with a smaller id has it or if it came before in the same document; all
    but its first occurrence are removed, overlapping ones as one run. Rows with the same id count as one document. Rows
    with a null id come last, and among themselves repeat nothing. Null texts stay null with no lines; texts of under
    three pieces are left, and with per_run the runs, without it all windows of under LEAST_WORDS words; an empty table gives no rows; other columns are ignored.
    Windows of different documents are the same if 96 bits of hashes of their pieces agree.

    A window goes to the shuffle as hash and id; a frequent one is summed by the tasks first, and the join that brings
    its first owner back is left to adaptive execution to split. Only windows with several owners are held in that join's
    tables; the others pass them unsorted."""
    found = materialise(windows(docs, id_col, text_col, per_run), "line-windows")
    first = found.groupBy("h", "check").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL").select("h", "check", "first_id")
    later = found.join(first.hint("shuffle_hash"), ["h", "check"]).where("doc_id IS NULL OR doc_id > first_id")
    gone = materialise(later.groupBy("doc_id", "k").agg(F.collect_set("h").alias("_gone")).withColumnsRenamed({"doc_id": "_doc", "k": "_k"}), "line-repeats", tidy=True)
    discard(found)
    text = docs[text_col].cast("string")
    null_key = F.when(docs[id_col].isNull(), F.xxhash64(text))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), *keep, null_key.alias("_null_key"))
    kept = rows.columns[2:-1]
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_doc"]) & rows["_null_key"].eqNullSafe(gone["_k"]), "left").select("doc_id", "text", "_gone", *kept)
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[3:]]
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = Lines(part.column("text"), per_run)
            n = part.num_rows
            lists = part.column("_gone")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(n), sizes)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            window_doc = x.piece_doc[x.window_piece]
            # repeats of the same document, and pairs of document and hash that came back from others
            distinct, code = np.unique(np.concatenate([hashes, x.window_hash]), return_inverse=True)
            known, code = code[: len(owner)], code[len(owner) :]
            again = _again(window_doc, code)
            if len(owner):
                again |= np.isin(window_doc * len(distinct) + code, owner * len(distinct) + known)
            covered = x.covered(again)
            texts = part.column("text").to_pylist() if covered.any() else None
            out, spans = part.column("text"), [[] for _ in range(n)]
            if texts is not None:
                first_word = np.cumsum(x.words.counts) - x.words.counts
                at = np.flatnonzero(covered)
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (np.diff(x.piece_doc[at]) != 0)
                head = np.flatnonzero(new)
                run_doc, run_word = x.piece_doc[at[head]], x.piece_word[at[head]]
                run_words = np.add.reduceat(x.n_words[at], head)
                base = x.words.offsets[run_doc]
                froms, tos = (x.words.starts[run_word] - base).tolist(), (x.words.ends[run_word + run_words - 1] - base).tolist()
                run_first, sizes = (run_word - first_word[run_doc]).tolist(), run_words.tolist()
                bounds = [*np.flatnonzero(np.diff(run_doc, prepend=-1)).tolist(), len(run_doc)]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    doc = int(run_doc[a])
                    texts[doc] = _without(x.words.data[x.words.offsets[doc] : x.words.offsets[doc + 1]].tobytes(), froms[a:b], tos[a:b])
                    spans[doc] = [{"first_word": f, "n_words": k} for f, k in zip(run_first[a:b], sizes[a:b], strict=True)]
                out = pa.array(texts, pa.string())
            line = _wrap(x.begins)
            line_doc, line_gone = x.doc[line], np.zeros(0, bool)
            gone_word = np.repeat(covered, x.n_words)
            if len(line):
                line_gone = np.logical_and.reduceat(gone_word, line)
            columns = [part.column("doc_id"), out, pa.array(np.bincount(line_doc, minlength=n)), pa.array(np.bincount(line_doc[line_gone], minlength=n)), pa.array(np.bincount(x.doc[gone_word], minlength=n)), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*columns, *part.columns[3:]], names=["doc_id", "text", "n_lines", "removed_lines", "removed_words", "spans", *part.schema.names[3:]])

    return joined.mapInArrow(run, ", ".join(["doc_id long, text string, n_lines long, removed_lines long, removed_words long, spans array<struct<first_word:int,n_words:int>>", *extra]))
