"""Packing documents into fixed windows by the sum-of-squares rule.

Every task packs the documents of its partition as they come.  A document longer than
a window first fills whole windows; the rest is one item.  The level array counts the
partially filled windows of each fill level; an item goes to the level whose choice
makes the sum of the squared counts smallest (a window that becomes full leaves the
array; ties go to the fullest window).

At the end of a partition the windows that are still open are completed: items of the
emptiest are cut to fill the fullest, and what remains is cut into sequences whose
lengths are powers of two, which need no padding.  Nothing is shuffled, and a task
holds its open windows only (at most the level array allows, ids included).

``sequence_id`` is the task's partition number times ``2**40`` plus a running number, so
a retried task, which reads the same rows, gives the same ids.

Token ids come from a public tokenizer file (``tokenizer_path``).  Its pre-tokenizer
never joins characters across a space or a line feed, so a text's ids are those of its
space-separated chunks; a worker keeps the ids of chunks it has seen, from task to task, in a
table of at most ``CACHE_CHUNKS`` entries of at most ``LONG_CHUNK`` characters.

Defined cases: a NULL or empty text is its end id alone; repeated rows are packed as
documents of their own; an empty table gives an empty result; only the id and text
columns are read; a NULL id stays NULL.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import table, text_of

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_CHUNKS = 1_000_000
LONG_CHUNK = 64
GROUP_CHARS = 1_000_000  # texts encoded together
WORD_END = "</w>"
#: Plain letters, then ASCII marks other than the apostrophe: two pre-tokens.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Normaliser and pre-tokenizer that leave words of a-z as they are.
PLAIN_FORM = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]


# -------------------------------------------------------------------- encoding

class Chunks(dict):
    """Ids by chunk; a look-up of a new chunk gives an empty buffer that :meth:`Encoder.encode` fills."""

    def __init__(self):
        self.new: dict[str, bytearray] = {}

    def __missing__(self, chunk: str) -> bytearray:
        x = self[chunk] = self.new[chunk] = bytearray()
        return x


class Encoder:
    """Ids of texts by a tokenizers file, remembered by chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Chunks()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.plain = self._plain(path)

    @staticmethod
    def _plain(path: str):
        """The same model behind a cut at white space only: all that a tokenizer of this form does to words of a-z."""
        import json

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        if [parts.get("normalizer"), parts.get("pre_tokenizer")] != PLAIN_FORM or parts["model"].get("type") != "BPE":
            return None
        return Tokenizer.from_str(json.dumps({**parts, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))

    def _encode_each(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_words(self, words: list[str], tokenizer=None) -> list[bytes]:
        """Words of plain letters are one pre-token each, so they may be encoded as one text and cut at word ends."""
        ids = np.array((tokenizer or self.tokenizer).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self._encode_each(words)
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        return [raw[i:j] for i, j in zip([0, *stops], stops)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        known, new, plain, other, marks, rest, marked = self.known, self.known.new, set(), set(), set(), [], []
        for c in chunks:
            w = c.rstrip(MARKS)
            if w.isascii() and w.isalpha() and w.islower():
                if w in new or w not in known:
                    plain.add(w)
            elif LETTERS.fullmatch(w):
                if w in new or w not in known:
                    other.add(w)
            else:
                rest.append(c)
                continue
            if len(w) < len(c):
                m = c[len(w):]
                marked.append((c, w, m))
                marks.add(m)
        out = {}
        for words, tokenizer in ((list(plain), self.plain), (list(other), None)):
            for i in range(0, len(words), 20_000):
                out.update(zip(words[i:i + 20_000], self._encode_words(words[i:i + 20_000], tokenizer)))
        rest += [m for m in marks if m in new or m not in known]
        out.update(zip(rest, self._encode_each(rest)))
        for c, w, m in marked:
            out[c] = (out.get(w) or known[w]) + (out.get(m) or known[m])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        parts = [list(map(known.__getitem__, _folded(t).replace("\n", " ").split(" "))) for t in texts]
        if known.new:
            try:
                learned = self._learn(list(known.new))
            except BaseException:
                self.known = Chunks()  # no empty buffer may stay for a later task
                raise
            for c, x in known.new.items():
                x += learned[c]
            known.update(learned)
            known.new = {}
            for c in learned:
                if len(c) > LONG_CHUNK:
                    del known[c]
        out = [np.frombuffer(b"".join(p), dtype="<u4") for p in parts]
        if len(known) > CACHE_CHUNKS:
            self.known = Chunks()
        return out


def _folded(text: str) -> str:
    """A text in lower case where that is surely what the tokenizer's normaliser does."""
    if "<|" in text:  # special tokens are matched before case is folded
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder of a tokenizer file (by default the public 49k word BPE)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --------------------------------------------------------------------- packing

class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n], self.total),
                Piece(self.doc, self.start + n, self.ids[n:], self.total))


class SumOfSquares:
    """Online packing into windows of ``size`` by the sum-of-squares rule."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)  # the level array
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, n: int) -> int:
        """Level to add an item of ``n`` to (0: a new window)."""
        room = self.size - n
        levels = np.flatnonzero(self.count[1:room + 1]) + 1
        best, cost = 0, 2 * int(self.count[n]) + 1
        if len(levels):
            after = self.count[levels + n]
            delta = 2 * (after - self.count[levels]) + 2
            delta[levels + n == self.size] -= 1  # a full window is not counted
            i = len(delta) - 1 - int(np.argmin(delta[::-1]))
            if delta[i] <= cost:
                best = int(levels[i])
        return best

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place a document; yields the windows that it fills."""
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            yield [Piece(doc, at, ids[at:at + self.size], len(ids))]
        n = len(ids) - whole
        if not n:
            return
        level = self.level_for(n)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = []
        window.append(Piece(doc, whole, ids[whole:], len(ids)))
        if level + n == self.size:
            yield window
        else:
            self.open.setdefault(level + n, []).append(window)
            self.count[level + n] += 1

    def close(self) -> Iterator[list[Piece]]:
        """Complete the open windows without padding; the rest in power-of-two lengths."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        fills = [level for level in sorted(self.open, reverse=True) for _ in self.open[level]]
        self.open, self.count[:] = {}, 0
        i, j = 0, len(left) - 1
        while i < j:
            need = self.size - fills[i]
            if not need:
                yield left[i]
                i += 1
                continue
            last = left[j].pop()
            if len(last.ids) > need:
                rest, last = last.cut(len(last.ids) - need)
                left[j].append(rest)
            left[i].append(last)
            fills[i] += len(last.ids)
            fills[j] -= len(last.ids)
            if not fills[j]:
                j -= 1
        if i == j and fills[i]:
            pieces, n = left[i], fills[i]
            for bit in range(n.bit_length() - 1, -1, -1):
                if not n >> bit & 1:
                    continue
                need, window = 1 << bit, []
                while need:
                    p = pieces.pop()
                    if len(p.ids) > need:
                        rest, p = p.cut(len(p.ids) - need)
                        pieces.append(rest)
                    window.append(p)
                    need -= len(p.ids)
                yield window


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                   tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it begins in its document, its sequence and its place there."""
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 40
        packer, number, id_type = SumOfSquares(size), 0, None
        enc = encoder(tokenizer_path)

        def table_of(windows) -> Iterator[pa.RecordBatch]:
            nonlocal number
            docs_of, rows, ids = [], [], []
            for w in windows:
                at = 0
                for p in w:
                    n = len(p.ids)
                    docs_of.append(p.doc)
                    rows.append((p.start, n, zlib.crc32(p.ids.tobytes()), p.total, first + number, at))
                    if with_ids:
                        ids.append(p.ids.astype(np.int32))
                    at += n
                number += 1
            if rows:
                columns = [pa.array(docs_of, id_type), *[pa.array(c, pa.int64()) for c in zip(*rows)]]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            id_type = batch.schema.field(0).type
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) < GROUP_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                encoded = enc.encode(texts[at:stop])
                yield from table_of(w for doc, ids in zip(ids_of[at:stop], encoded)
                                    for w in packer.add(doc, np.append(ids, np.uint32(END_ID))))
                at = stop
        yield from table_of(packer.close())
    names = ["doc_id", *numbers] + (["ids"] if with_ids else [])
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in numbers]] + (["ids array<int>"] if with_ids else []))
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
