"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton of the pieces, and exact decoding.

The vocabulary and its scores come from a SentencePiece model file (a parameter; nothing is trained).
The automaton reads a text once; at each position its output links give all pieces that end there, and
each relaxes the best score of that position. Characters that no piece covers, line breaks, control
characters and the literal marker U+2581 are written as byte pieces, so that decoding is exact for
every text.

No piece of these vocabularies has a space marker after another character. A best segmentation of a
text is therefore the best segmentations of its units (spaces and what follows them up to the next
space or line break) one after the other, and each task encodes a distinct unit once.

Of equal scores the segmentation with the longer last piece stands. Ids are those of the best total
score; for a model trained by merges this can differ from replaying the merges. Null and empty texts
have no ids and decode to the empty text. Equal rows get equal results; columns other than doc_id and
text are not read. Without rows the result is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textarrays import SECOND, SEED, chunks, span_hashes

MARK = "▁"
#: Units that a task remembers; beyond, it forgets all and begins anew.
MEMORY = 400_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Codec:
    """Pieces, their scores and the automaton of one model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.IsControl(i) or sp.IsUnknown(i) or sp.IsByte(i) or sp.IsUnused(i))]
        self.byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.IsByte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.bytes_of: list[bytes] = [b""] * n
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.machine = ahocorasick.Automaton()
        lowest = 0.0
        for i in plain:
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {i} crosses units")
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
            self.machine.add_word(piece, (len(piece), score, i))
            lowest = min(lowest, score)
        self.machine.make_automaton()
        self.byte_score = lowest - 10
        self.known = {sp.id_to_piece(i) for i in plain if len(sp.id_to_piece(i)) == 1}

    def encode_unit(self, unit: str) -> list[int]:
        """Best ids of one unit; its spaces are spaces here."""
        if MARK in unit:  # the literal marker: as bytes, between the units around it
            parts = unit.split(MARK)
            ids = self.encode_unit(parts[0]) if parts[0] else []
            for part in parts[1:]:
                ids += [self.byte_ids[b] for b in MARK.encode()]
                ids += self.encode_unit(part) if part else []
            return ids
        text = unit.replace(" ", MARK)
        if self.known.issuperset(text):
            return self._covered(text)
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at = 0
        for end, (length, score, i) in self.machine.iter(text):
            stop = end + 1
            while at < stop - 1:  # the places before are settled: give those that no piece reached their bytes
                at += 1
                self._bytes_at(text, at, best, came)
            total = best[stop - length] + score
            if best[stop] is None or total > best[stop]:
                best[stop], came[stop] = total, (stop - length, i)
        while at < n:
            at += 1
            self._bytes_at(text, at, best, came)
        ids: list[int] = []
        while n:
            start, i = came[n]
            ids += [self.byte_ids[b] for b in reversed(text[start:n].encode())] if i < 0 else [i]
            n = start
        return ids[::-1]

    def _covered(self, text: str) -> list[int]:
        """Best ids where every character is a piece, so that every position is reached."""
        n = len(text)
        best = [0.0] + [-math.inf] * n
        came = [None] * (n + 1)
        for end, piece in self.machine.iter(text):
            end += 1
            total = best[end - piece[0]] + piece[1]
            if total > best[end]:
                best[end], came[end] = total, piece
        ids = []
        while n:
            length, _, i = came[n]
            ids.append(i)
            n -= length
        return ids[::-1]

    def _bytes_at(self, text: str, at: int, best: list, came: list) -> None:
        if best[at] is None:
            best[at], came[at] = best[at - 1] + self.byte_score * len(text[at - 1].encode()), (at - 1, -1)

    def decode(self, ids: list[int]) -> bytes:
        """The text of these ids; the leading space that encoding adds is taken off."""
        return b"".join([self.bytes_of[i] for i in ids])[1:]


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the units of all texts: each run of spaces begins one, a line break is one of its own."""
    if not len(data):
        return np.zeros(0, np.int64)
    space, line = data == 32, data == 10
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[0] = True
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes chunks of texts; a unit is encoded once as long as it is remembered."""

    def __init__(self, codec: Codec):
        self.codec, self.memory = codec, {}

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        start = units(data, offsets)
        end = np.append(start[1:], len(data))
        opens = np.zeros(len(start), bool)  # the first unit of a text has a space put before it
        opens[np.searchsorted(start, offsets[:-1][np.diff(offsets) > 0])] = True
        hashes, second = (span_hashes(data, start, end, seed) ^ opens.astype(np.uint64) for seed in (SEED, SECOND))
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (second[one][which] != second).any():  # two units of one hash: none is taken for another
            one = which = np.arange(len(start))
        if len(self.memory) > MEMORY:
            self.memory.clear()
        raw, memory, encode = data.tobytes(), self.memory, self.codec.encode_unit
        pieces = []
        for a, b, first in zip(start[one].tolist(), end[one].tolist(), opens[one].tolist()):
            unit = b" " + raw[a:b] if first else raw[a:b]
            ids = memory.get(unit)
            if ids is None:
                ids = memory[unit] = np.array(encode(unit.decode()), np.int32)
            pieces.append(ids)
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        flat, size = np.concatenate(pieces), np.array([len(p) for p in pieces])
        at = np.concatenate([[0], np.cumsum(size)])
        sizes = size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(at[:-1][which] - total[:-1], sizes) + np.arange(total[-1])]
        return out, total[np.searchsorted(start, offsets)]


ENCODED = "doc_id long, n_tokens long, ids array<int>"
CHECKED = "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, text_sha256 string, exact boolean"


def _encoder(model, checked: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        encoder = Encoder(codec)
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                ids, at = encoder.ids(data, offsets)
                doc, n = rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(at))
                if not checked:
                    yield pa.RecordBatch.from_arrays([doc, n, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["doc_id", "n_tokens", "ids"])
                    continue
                raw, bounds, places = data.tobytes(), offsets.tolist(), at.tolist()
                row = []
                for k in range(rows.num_rows):
                    own, text = ids[places[k] : places[k + 1]], raw[bounds[k] : bounds[k + 1]]
                    decoded = codec.decode(own.tolist())
                    row.append((hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == text))
                digests = [pa.array(list(c), t) for c, t in zip(zip(*row), (pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(offsets)), n, *digests], names=[f.split()[0] for f in CHECKED.split(", ")])

    return encode


def _model(docs: DataFrame, model: str):
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and ids: one row for each row of ``docs``."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(_model(docs, model), False), ENCODED)


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Digests of the ids and of the text decoded from them, and whether that is the document's text."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(_model(docs, model), True), CHECKED)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to the empty text."""
    shared = _model(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [codec.decode(ids or []).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
