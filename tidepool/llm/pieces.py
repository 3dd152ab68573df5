"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text is the path over character boundaries with the largest sum of
piece scores.  The stream is read one character at a time: a boundary's best score looks back
at most ``longest`` characters (the longest piece), so scores are kept for that window only.
Back-pointers are kept since the last commit; whenever the paths of all boundaries in the
window run through one common boundary, the pieces before it can no longer change and are
committed.  Ties go to the longer last piece.

Texts are read the way the model file says: a space is the mark U+2581, and one mark is put
in front of a text that is not empty.  A character without a piece of its own may be taken as
unknown at the model's lowest score less ``UNKNOWN_PENALTY``, and becomes its UTF-8 byte pieces.

No piece of such a model has a mark behind another character (checked when the file is
loaded), so the boundary before a mark that follows another character is always common to all
paths.  So is every boundary between two characters that stand next to each other in no piece, such as
those between a word and a full stop.  Runs between such boundaries are therefore streamed by
themselves, and a worker keeps the ids of runs of at most ``LONG_RUN`` characters it has seen, from task to task, in a table of at
most ``CACHE_RUNS`` entries.

Defined cases: NULL and empty texts have no ids and decode to an empty text; a U+2581 in a
text is read as a space (so decoding gives a space); repeated rows are encoded row by
row; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import table, text_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_RUNS = 1_000_000
LONG_RUN = 64


class PieceModel:
    """Pieces and scores of a SentencePiece file."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], texts: list[bytes]):
        self.pieces, self.byte_ids, self.texts = pieces, byte_ids, texts
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        #: Trie of the pieces read backwards: character -> [(score, (id,)) of the piece that begins here, next characters].
        self.backwards: dict[str, list] = {}
        for p, found in pieces.items():
            level, node = self.backwards, [None, {}]
            for c in reversed(p):
                node = level.setdefault(c, [None, {}])
                level = node[1]
            node[0] = (found[1], (found[0],))
        #: Pairs of characters that some piece holds next to each other.
        self.joins = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.cuts_at_marks = not any(MARK in p.lstrip(MARK) for p in pieces)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, texts = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                texts.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                pieces[p] = (i, sp.get_score(i))
                texts.append(p.replace(MARK, " ").encode())
        return cls(pieces, byte_ids, texts)


class StreamingViterbi:
    """Best segmentation of a stream of characters, committed as soon as it is certain."""

    def __init__(self, model: PieceModel, check_every: int = 16):
        self.model, self.check_every = model, check_every
        self.window = ""             # the last ``longest`` characters
        self.scores = [0.0]          # best scores of the boundaries in the window
        self.back: list[tuple[int, tuple[int, ...]]] = []  # of every boundary since the last commit
        self.held = 0                # greatest number of back-pointers held

    def push(self, chars: Iterable[str]) -> Iterator[int]:
        """Read characters; yields the ids that become certain."""
        if not isinstance(chars, str):
            chars = "".join(chars)
        m, keep = self.model, self.model.longest - 1
        for at in range(0, len(chars), self.check_every):
            block = chars[at:at + self.check_every]
            scores, back, text = self.scores, self.back, self.window + block
            for i in range(len(self.window), len(text)):
                best, step, ids = None, 0, ()
                level, k = m.backwards, i
                for c in text[i::-1]:
                    node = level.get(c)
                    if node is None:  # no piece ends like this
                        break
                    found, level = node
                    if found:
                        s = scores[k] + found[0]
                        if best is None or s >= best:
                            best, step, ids = s, i - k + 1, found[1]
                    k -= 1
                c = text[i]
                if c not in m.pieces:
                    s = scores[i] + m.unknown
                    if best is None or s > best:
                        best, step, ids = s, 1, tuple(m.byte_ids[b] for b in c.encode("utf-8", "replace"))
                scores.append(best)
                back.append((step, ids))
            # a piece that ends in the next character begins at most ``keep`` characters before it
            self.window = text[len(text) - keep:] if 0 < keep < len(text) else text if keep else ""
            self.scores = scores[-len(self.window) - 1:]
            self.held = max(self.held, len(back))
            if len(block) == self.check_every:
                yield from self._commit(self._common())

    def _common(self) -> int:
        """Latest boundary (counted from the last commit) on the paths of all boundaries in the window."""
        end = len(self.back)
        low = high = end
        frontier = set(range(max(0, end - len(self.scores) + 1), end + 1))
        while len(frontier) > 1:
            high = max(frontier)
            if high == 0:
                return 0
            frontier.discard(high)
            frontier.add(high - self.back[high - 1][0])
        low = frontier.pop()
        return low

    def _commit(self, boundary: int) -> list[int]:
        path, at = [], boundary
        while at > 0:
            step, ids = self.back[at - 1]
            path.append(ids)
            at -= step
        del self.back[:boundary]
        return [i for ids in reversed(path) for i in ids]

    def finish(self) -> Iterator[int]:
        """The ids not committed yet; the stream begins anew."""
        yield from self._commit(len(self.back))
        self.window, self.scores = "", [0.0]


class PieceEncoder:
    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def runs(self, text: str) -> list[str]:
        """Parts of the marked text that are segmented independently."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.model.cuts_at_marks:
            return [marked]
        out, held = [], ""
        for part in marked.split(MARK)[1:]:
            held += MARK
            if part:
                out.append(held + part)
                held = ""
        return out + [held] if held else out

    def _parts(self, run: str) -> list[str]:
        """The run cut between characters that no piece joins."""
        joins, out, start = self.model.joins, [], 0
        for i in range(1, len(run)):
            if run[i - 1:i + 1] not in joins:
                out.append(run[start:i])
                start = i
        return [*out, run[start:]]

    def _stream(self, run: str) -> bytes:
        v = StreamingViterbi(self.model)
        return array("I", [*v.push(run), *v.finish()]).tobytes()

    def _remembered(self, run: str) -> bytes:
        """Ids of a run without sure boundaries, streamed unless the table has them."""
        ids = self.known.get(run)
        if ids is None:
            ids = self._stream(run)
            self._remember(run, ids)
        return ids

    def _remember(self, run: str, ids: bytes) -> None:
        if len(run) <= LONG_RUN:
            if len(self.known) >= CACHE_RUNS:
                self.known.clear()
            self.known[run] = ids

    def encode(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for run in self.runs(text):
            ids = known.get(run)
            if ids is None:
                parts = self._parts(run)
                ids = b"".join(map(self._remembered, parts))
                if len(parts) > 1:
                    self._remember(run, ids)
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str | None) -> PieceEncoder:
    """The worker's encoder of a model file (by default the public 32k pieces)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(PieceModel.load(path))
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
                  with_ids: bool = True) -> DataFrame:
    """(id, n_ids, ids_crc32, round_trip[, ids]): ``round_trip`` tells whether decoding gives the text back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            n, crc, same, ids = [], [], [], []
            for t in b.column(1).to_pylist():
                x = enc.encode(t)
                n.append(len(x))
                crc.append(zlib.crc32(x.tobytes()))
                same.append(enc.decode(x.tolist()) == t)
                if with_ids:
                    ids.append(x.astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)
    names = ["id", "n_ids", "ids_crc32", "round_trip"] + ["ids"] * with_ids
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """(id, text) of rows of ids; NULL ids decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for b in batches:
            texts = [enc.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])
    kind = encoded.select(F.col(id_col)).schema[0].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op4_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encode_pieces(table(spark, sf_dir, "documents"), with_ids=False)
    return e.withColumnRenamed("id", "doc_id")
