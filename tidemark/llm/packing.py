"""Packing tokenised documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
MOST_OPEN = 256
CACHED_WORDS = 500_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# How the tokenizer splits words of ASCII and Latin-1 letters, which need no
# normalisation but lower case, and what its byte-level vocabulary writes for those of their
# bytes that it does not write as the characters of the same number.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_PLAIN = re.compile(f"[!-~\xa1\xab\xbb\xbf{_LETTERS}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_WRITTEN = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))
_WORD_END = "</w>"


def _parts(word: bytes) -> list[bytes] | None:
    """A plain word's parts, each of which the tokenizer's model takes alone; None for others."""
    word = word.lower()
    if word.isalpha():
        return [word]
    if word[-1:] in (b".", b",") and word[:-1].isalpha():
        return [word[:-1], word[-1:]]
    text = word.decode("utf-8", "replace").lower()
    if "<|" in text or not _PLAIN.fullmatch(text):
        return None
    return [part.encode() for part in _PARTS.findall(text)]


class Encoder:
    """Token ids of texts, word by word: words are what stands between ASCII white space, where
    the tokenizer's own splitting never reaches across, so a text's ids are those of its words.

    Words are looked up in lower case (but for texts that may hold the tokenizer's special
    tokens, which it looks for in the raw text). The parts of plain words go to the tokenizer's
    model without its normaliser and pattern, and come back as one list, where the ids that end a
    word tell them apart; every other word goes through the whole tokenizer. Ids of words are
    remembered in two generations: when the younger holds CACHED_WORDS, the older is forgotten.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for text, k in vocabulary.items() if text.endswith(_WORD_END)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _unseen(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, plain, after, flat, rest = {}, [], [], [], []
        for word in words:
            if parts := _parts(word):
                flat += parts
                plain.append(word)
                after.append(len(flat))
            else:
                rest.append(word)
        if plain:
            joined = b" ".join(flat).decode("latin-1")
            for byte, written in _WRITTEN:
                joined = joined.replace(byte, written)
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids])[np.array(after) - 1] + 1)).tolist()
            raw = ids.tobytes()
            found = {w: raw[i:j] for w, i, j in zip(plain, [0, *stops], stops, strict=False)}
        if rest:
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
            found |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(rest, got, strict=True)}
        return found

    def encode(self, words: list[bytes], end_id: int) -> np.ndarray:
        """The ids of a text, given as its words, and end_id, as little-endian 32-bit numbers."""
        ids = list(map(self.young.get, words))
        missing = [k for k, got in enumerate(ids) if got is None]
        if missing:
            found, new = {}, []
            for w in {words[k] for k in missing}:
                got = self.old.get(w)
                if got is None:
                    new.append(w)
                else:
                    found[w] = got
            found |= self._unseen(new)
            for k in missing:
                ids[k] = found[words[k]]
            if len(self.young) + len(found) > CACHED_WORDS:
                self.old, self.young = self.young, {}
            self.young |= found
        ids.append(end_id.to_bytes(4, "little"))
        return np.frombuffer(b"".join(ids), dtype="<u4")


def _words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.split() if b"<|" in text else text.lower().split()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Online sum-of-squares packing (Csirik et al., "On the Sum-of-Squares Algorithm for Bin
    Packing"): an item goes to the fill level where the sum over levels of the squared number of
    windows at that level comes out least. The level array holds those numbers.

    At most `most_open` windows are partially filled at a time, to bound memory: an item that the
    rule would begin one more for is cut, its beginning fills the fullest window and the rule places
    the rest. In the end the emptier windows are cut to fill the fuller ones.

    A piece is (doc_id, start, ids, doc_tokens); closed windows come out of add() and close().
    `placed` counts tokens by what placed them: full (windows cut from one document), rule and cut
    (beginnings that filled a window); moved is those that close() takes to another window, counted
    before too.
    """

    def __init__(self, length: int = LENGTH, most_open: int = MOST_OPEN) -> None:
        self.length, self.most_open = length, most_open
        self.count = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0
        self.placed = {"full": 0, "rule": 0, "cut": 0, "moved": 0}

    def level(self, size: int) -> int:
        """The fill level to put an item of this size on; 0: a new window. Ties: the fullest."""
        count, top = self.count, self.length - size
        leave = 1 - 2 * count[: top + 1]
        leave[0] = 0
        arrive = 2 * count[size : self.length + 1] + 1
        arrive[top] = 0  # a full window is no level
        change = leave + arrive
        change[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        n, total = self.length, len(ids)
        at = total - total % n
        for start in range(0, at, n):
            yield [(doc_id, start, ids[start : start + n], total)]
        self.placed["full"] += at
        while at < total:
            size = total - at
            h = self.level(size)
            if not h and self.n_open >= self.most_open:
                h = int(np.flatnonzero(self.count)[-1])
                size = min(size, n - h)
                self.placed["cut"] += size
            else:
                self.placed["rule"] += size
            window = self._take(h) if h else []
            window.append((doc_id, at, ids[at : at + size], total))
            at += size
            if h + size == n:
                yield window
            else:
                self.open[h + size].append(window)
                self.count[h + size] += 1
                self.n_open += 1

    def close(self) -> Iterator[list]:
        """The windows still open: the fullest stay as they are and take what they lack from the
        emptiest, whose pieces are cut. The last one's tokens make sequences whose lengths are
        powers of two, which need no padding."""
        held = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0
        spare: list = []  # pieces of the windows that are being emptied

        def fill(window: list, room: int) -> list:
            while room and (spare or held):
                if not spare:
                    spare.extend(held.pop())
                doc_id, start, ids, total = spare.pop()
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc_id, start, ids, total))
                self.placed["moved"] += len(ids)
                room -= len(ids)
            return window

        while held:
            window = held.pop(0)
            size = sum(len(p[2]) for p in window)
            lack = self.length - size
            if lack > sum(len(p[2]) for w in [*held, spare] for p in w):
                spare += window
                spare += [p for w in held for p in w]
                held.clear()
                break
            yield fill(window, lack)
        tokens = sum(len(p[2]) for p in spare)
        while tokens:
            room = min(self.length, 1 << (tokens.bit_length() - 1))
            tokens -= room
            yield fill([], room)


def pack(docs: DataFrame, tokenizer: str, text_col: str = "text", length: int = LENGTH, end_id: int = 1, most_open: int = MOST_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every task packs the rows of its own partition in one pass, so nothing is shuffled and no
    text leaves its task; at its end it cuts the emptier of the windows still open to fill the others
    and powers of two, so there is no padding at all. Memory: one Arrow batch, all ids of its longest
    text, the words remembered and most_open windows. sequence_id is the partition's number shifted by 40
    bits plus a running number.

    A document's ids are its text's, then end_id; null, empty and blank texts have end_id alone.
    A text of any length is cut into full windows first. Rows that repeat, under one doc_id or
    several, are packed each. A null doc_id stays null. Other columns are not read. Empty
    table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, packer = encoder(tokenizer), Packer(length, most_open)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset))
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids, texts, strict=True):
                for window in packer.add(doc_id, codes.encode(_words(text.as_py()), end_id)):
                    emit(window)
            if len(rows) >= 4096:
                yield flush()
        for window in packer.close():
            emit(window)
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
