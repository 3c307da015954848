"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi."""

from __future__ import annotations

import math
import re
import uuid
from array import array
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import _vec

#: Bytes of segments and their ids (with what Python adds to each) that a worker keeps; at the bound the store is emptied.
MEMO = 48 << 20
_ENTRY = 200
#: Bytes of texts, or of ids, looked at at once.
_RUN = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """(id, piece, score) of ordinary pieces with spaces for the space mark, and the ids of the 256 bytes."""

    pieces: tuple[tuple[int, str, float], ...]
    byte_ids: tuple[int, ...]
    byte_score: float


def load(model_file: str | None = None) -> Vocabulary:
    """Read a model once, on the driver; tasks get the vocabulary, whose size is the model's.

    A unigram model's scores are log probabilities and are used as they are. A BPE model's only rank its merges, so
    each piece gets the log probability that Zipf's law gives its rank. A byte costs more than any piece.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=Path(model_file or default_model()).read_bytes())
    ids = range(sp.get_piece_size())
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no pieces for bytes; texts could not be restored")
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in plain}
    if all(s == round(s) for s in scores.values()):
        total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        order = sorted(plain, key=lambda i: (-scores[i], i))
        scores = {i: -math.log(r + 1) - total for r, i in enumerate(order)}
    pieces = tuple((i, sp.id_to_piece(i).replace("▁", " "), scores[i]) for i in plain)
    return Vocabulary(pieces, tuple(byte_ids[b] for b in range(256)), min(scores.values()) - 10)


def _segments(alphabet: set[str], follows: dict[str, set[str]], breaks: str) -> str:
    """A pattern whose matches cover a text and end only where no piece goes on: at spaces, line breaks and marks.

    A mark (in ASCII, no letter, digit or space) is one that pieces have only after spaces and other marks, but for some
    characters, after which it doesn't begin a match.
    """
    marks = {c for c in alphabet if c.isascii() and not (c.isalnum() or c.isspace())}
    few: dict[str, set[str]] = {}
    while True:
        few = {c: follows.get(c, set()) - marks - {" "} for c in marks}
        lost = {c for c, x in few.items() if len(x) > 100 or any(b.isascii() for b in x)}
        if not lost:
            break
        marks -= lost
    of = lambda chars: "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"
    cut = f"{of(breaks)}|" if breaks else ""
    outside = "".join(re.escape(c) for c in sorted(marks | set(breaks)))
    run = f"[^ {outside}]"
    on = "|".join(f"(?<={of(x)}){re.escape(c)}{of(marks)}*{run}*" for c, x in sorted(few.items()) if x)
    on = f"(?:{on})*" if on else ""
    marked = f"{of(marks)}+{run}*{on}|" if marks else ""
    return f"{cut} *(?:{marked}{run}+{on})| +"


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.restore: dict[int, bytes] = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        alphabet: set[str] = set()
        self.singles = {piece for _, piece, _ in vocabulary.pieces if len(piece) == 1}
        inner = False
        follows: dict[str, set[str]] = {}  # what stands before a character in pieces
        for i, piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
            self.restore[i] = piece.encode()
            alphabet |= set(piece)
            inner |= " " in piece.lstrip(" ")
            for before, c in zip(piece, piece[1:], strict=False):
                follows.setdefault(c, set()).add(before)
        self.automaton.make_automaton()
        self.byte_ids, self.byte_score = vocabulary.byte_ids, vocabulary.byte_score
        # where two neighbours stand together in no piece, the best path passes between them; what lies between such
        # places can be solved once for all texts
        breaks = "".join(c for c in "\n\r\t" if c not in alphabet)
        self.segment = re.compile(r"(?s).+") if inner else re.compile(_segments(alphabet, follows, breaks))
        self.memo: dict[str, bytes] = {}
        self.kept = 0
        # bytes by id, and after the last id those of what is no piece
        self.bytes_of = pa.array([self.restore.get(i, b"") for i in range(max(self.restore) + 2)], pa.binary())

    def best(self, text: str) -> array:
        """Ids of the best path: at each end the automaton's outputs, longest first, relax the score; the first best stays."""
        n = len(text)
        score = [0.0] + [-math.inf] * n
        if self.singles.issuperset(text):  # every position can be reached by a piece
            way = score[:]
            for end, step in self.automaton.iter(text):
                end += 1
                s = score[end - step[0]] + step[2]
                if s > score[end]:
                    score[end] = s
                    way[end] = step
            ids = []
            while n:
                size, i, _ = way[n]
                ids.append(i)
                n -= size
            ids.reverse()
            return array("i", ids)
        back: list = [None] * (n + 1)
        done = 0  # all positions up to here are final

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                done += 1
                if not single[done]:
                    raw = text[done - 1].encode("utf-8", "surrogatepass")
                    s = score[done - 1] + self.byte_score * len(raw)
                    if s > score[done]:
                        score[done], back[done] = s, (1, tuple(self.byte_ids[b] for b in raw))

        single = [False] * (n + 1)
        for end, (size, i, gain) in self.automaton.iter(text):
            end += 1
            if end > done + 1:
                settle(end - 1)
            s = score[end - size] + gain
            if size == 1:
                single[end] = True
            if s > score[end]:
                score[end], back[end] = s, (size, (i,))
        settle(n)
        out: list[int] = []
        at = n
        while at:
            size, ids = back[at]
            out.extend(reversed(ids))
            at -= size
        return array("i", reversed(out))

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers, one after the other."""
        if not text:
            return b""
        memo = self.memo
        parts = self.segment.findall(" " + text)
        own = set(parts)
        new = [p for p in own if p not in memo]
        if self.kept > MEMO:
            memo.clear()
            self.kept = 0
            new = list(own)
        for p in new:
            memo[p] = self.best(p).tobytes()
        out = b"".join([memo[p] for p in parts])
        for p in new:
            if len(p) > 64 or self.kept > MEMO:
                del memo[p]
            else:
                self.kept += len(p) + len(memo[p]) + _ENTRY
        return out

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Lists of ids, run by run, so that few Python objects are there at once."""
        ids, sizes = [], []
        for a, b, _, _ in _vec.pieces(texts, _RUN):
            rows = [self.encode(t.decode("utf-8", "replace")) for t in _vec.binary(texts.slice(a, b - a)).to_pylist()]
            sizes += [len(r) // 4 for r in rows]
            ids.append(b"".join(rows))
        ends = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))

    def decode(self, ids) -> str:
        return b"".join([self.restore.get(i, b"") for i in ids]).decode("utf-8", "replace")[1:]

    def decode_all(self, rows: pa.Array) -> pa.Array:
        """Texts of lists of ids, run by run: the bytes of all ids in a row, cut where a list ends."""
        off = rows.offsets.to_numpy()
        out = []
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(off, off[at] + _RUN // 4, "right")) - 1)
            out.append(self._decoded(rows.slice(at, end - at), off[at : end + 1] - off[at], rows.values.slice(off[at], off[end] - off[at])))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def _decoded(self, rows: pa.Array, off: np.ndarray, ids: pa.Array) -> pa.Array:
        last = len(self.bytes_of) - 1
        x = ids.fill_null(last).to_numpy()
        flat = self.bytes_of.take(pa.array(np.where((x < 0) | (x > last), last, x)))
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: ends[-1]]
        cut = ends[off]
        size = np.diff(cut)
        begin = cut[:-1][size > 0]
        if (data[begin] == 32).all():  # each text begins with the space that encoding puts before it
            keep = np.ones(len(data), bool)
            keep[begin] = False
            ends = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size - (size > 0), out=ends[1:])
            text = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data[keep])])
            try:
                text = text.cast(pa.string())
                return pc.if_else(rows.is_valid(), text, pa.nulls(len(text), text.type)) if rows.null_count else text
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                pass
        return pa.array([None if r is None else self.decode(r) for r in rows.to_pylist()], pa.string())


_coders: dict[str, Coder] = {}


def _coder(shared: _Shared) -> Coder:
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.broadcast.value)
    return _coders[shared.id]


class Pieces:
    """Column functions over one model."""

    def __init__(self, spark, model_file: str | None = None):
        self.shared = _Shared(spark.sparkContext.broadcast(load(model_file)))

    def encode(self, text: Column) -> Column:
        """array<int> of a text's ids; a null text gives null, an empty one none.

        Encoding is exact over the whole text, and decode() restores every text. A character in no piece becomes its
        UTF-8 bytes; so does the space mark itself, which other coders read back as a space.
        """
        shared = self.shared

        def batch(texts: pa.Array) -> pa.Array:
            out = _coder(shared).encode_all(texts)
            if texts.null_count:
                out = pc.if_else(texts.is_valid(), out, pa.nulls(len(out), out.type))
            return out

        return F.arrow_udf(batch, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """The text of an array<int>; ids of no piece are skipped, null stays null."""
        shared = self.shared

        def batch(rows: pa.Array) -> pa.Array:
            out = _coder(shared).decode_all(rows)
            pa.default_memory_pool().release_unused()
            return out

        return F.arrow_udf(batch, "string")(ids)


class _Shared:
    """A broadcast vocabulary that workers know again by its number."""

    def __init__(self, broadcast):
        self.broadcast = broadcast
        self.id = uuid.uuid4().hex
