"""SentencePiece encoding and decoding: batched numpy Viterbi over a fixed public vocabulary.

Text gets a leading space and falls into units that start at a space or a
line break; no piece crosses a unit. Units of one length advance together
through the lattice; the best last piece of every prefix is kept, and ids are
read back from the end. The vocabulary's own scores are merge ranks, which
cannot be summed; a piece of rank r has log probability -log(r + 2) up to a
constant (Zipf), ties go to the shorter last piece. A character that is no
piece becomes its UTF-8 bytes' pieces, so decoding gives every text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import blocks, release_memory
from newsloom.llm.pieces import MODEL_PATH, Pieces, by_length, pieces

UNKNOWN_PENALTY = 10.0  # below the least likely piece, for each character that is no piece
CACHE_UNITS = 100_000  # encoded units a worker remembers


def log_probabilities(vocabulary: Pieces) -> np.ndarray:
    ranks = np.argsort(np.argsort(vocabulary.ids))
    return -np.log(ranks + 2.0) - np.log(np.sum(1.0 / (np.arange(len(ranks)) + 2.0)))


def viterbi(vocabulary: Pieces, scores: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, number of ids of each row); codes has a row of code points per unit."""
    n, length = codes.shape
    found = vocabulary.lattice(codes)
    m = found.shape[2]
    gain = np.append(scores, -np.inf)[found]
    first = gain[:, 1:, 0]
    first[np.isneginf(first)] = scores.min() - UNKNOWN_PENALTY
    best = np.zeros((n, length + 1))
    back = np.zeros((n, length + 1), np.int16)
    rows = np.arange(n)
    for end in range(1, length + 1):
        k = min(m, end)
        reach = best[:, end - k:end][:, ::-1] + gain[:, end, :k]
        back[:, end] = choice = reach.argmax(axis=1)
        best[:, end] = reach[rows, choice]
    # read back all rows at once: at every step each unfinished row gives its last piece
    at, steps = np.full(n, length), []
    while (at > 0).any():
        last = back[rows, at]
        piece = found[rows, at, last].astype(np.int64)
        unknown = piece == -1
        piece[unknown] = -3 - codes[unknown, at[unknown] - 1].astype(np.int64)
        steps.append(np.where(at > 0, piece, -2))
        at = np.where(at > 0, at - last - 1, 0)
    table = np.stack(steps[::-1], axis=1)
    used = table != -2
    return to_ids(vocabulary, table[used], used.sum(axis=1))


def to_ids(vocabulary: Pieces, chosen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece indexes to ids; -3 - code point, a character that is no piece, to the ids of its UTF-8 bytes."""
    unknown = np.flatnonzero(chosen < 0)
    if not len(unknown):
        return vocabulary.ids[chosen], counts
    spelled = [vocabulary.bytes_first[list(chr(-3 - int(c)).encode())] for c in chosen[unknown]]
    width = np.ones(len(chosen), np.int64)
    width[unknown] = [len(s) for s in spelled]
    starts = np.cumsum(width) - width
    ids = np.zeros(int(width.sum()), np.int32)
    known = chosen >= 0
    ids[starts[known]] = vocabulary.ids[chosen[known]]
    ids[np.repeat(starts[unknown], width[unknown]) + np.concatenate([np.arange(len(s)) for s in spelled])] = np.concatenate(spelled)
    row = np.repeat(np.arange(len(counts)), counts)
    return ids, np.bincount(row, width, len(counts)).astype(np.int64)


class Encoder:
    """Encodes lists of texts; remembers a bounded number of units."""

    def __init__(self, path: str = MODEL_PATH):
        self.vocabulary = pieces(path)
        self.scores = log_probabilities(self.vocabulary)
        cuts = "".join(re.escape(c) for c in "\n" if not any(c in s for s in self.vocabulary.strings if len(s) > 1))
        self.units = re.compile(f" +[^ {cuts}]*|[^ {cuts}]+|[{cuts}]" if cuts else " +[^ ]*|[^ ]+").findall
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, units: list[str]) -> None:
        starts, counts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        flat, size = [self.flat], len(self.flat)
        for where, codes in by_length(units, self.vocabulary.max_length):
            ids, each = viterbi(self.vocabulary, self.scores, codes)
            counts[where] = each
            starts[where] = size + np.cumsum(each) - each
            flat.append(ids)
            size += len(ids)
        known = len(self.place)
        self.place.update(zip(units, range(known, known + len(units))))
        self.starts, self.counts = np.append(self.starts, starts), np.append(self.counts, counts)
        self.flat = np.concatenate(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        all_units: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.units(" " + text)
                per_text[i] = len(found)
                all_units += found
        if len(self.place) > CACHE_UNITS:
            self.forget()
        if new := list(set(all_units).difference(self.place)):
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, all_units), np.int64, len(all_units))
        counts, starts = self.counts[at], self.starts[at]
        total = int(counts.sum())
        before = np.cumsum(counts) - counts
        ids = self.flat[np.repeat(starts - before, counts) + np.arange(total)]
        edges = np.concatenate([[0], np.cumsum(per_text)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[edges[1:]] - ends[edges[:-1]]


def encode_array(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    ids, counts = encoder.encode(texts.to_pylist())
    missing = np.append(texts.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32(), mask=missing), pa.array(ids, pa.int32()))


class Decoder:
    """Puts together the bytes of ids; an id's bytes come from one table."""

    def __init__(self, path: str = MODEL_PATH):
        strings = pieces(path).text_bytes
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        counts = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
        size = self.lengths[flat]
        before = np.cumsum(size) - size
        joined = self.data[np.repeat(self.starts[flat] - before, size) + np.arange(int(size.sum()))].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        # every text was encoded with one leading space
        return pa.array([joined[a + (joined[a:a + 1] == b" "):b].decode("utf-8", "replace") if there else None
                         for a, b, there in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist())], pa.string())


def encode_column(text: Column, path: str = MODEL_PATH) -> Column:
    """Ids of each text; null of a null text, none of an empty one."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for batch in batches:
            for block in blocks(batch):
                yield encode_array(encoder, block)
        del encoder
        release_memory()

    return encode(text)


def decode_column(ids: Column, path: str = MODEL_PATH) -> Column:
    """Text of each id array; null of null. Bytes that are no UTF-8 give U+FFFD."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(path)
        for batch in batches:
            for start in range(0, len(batch), 64):
                yield decoder.decode(batch.slice(start, 64))

    return decode(ids)


def code_and_decode_column(text: Column, path: str = MODEL_PATH) -> Column:
    """struct(ids, decoded): encoding and decoding in one worker, so half the Python processes."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(path), Decoder(path)
        for batch in batches:
            for block in blocks(batch):
                ids = encode_array(encoder, block)
                yield pa.StructArray.from_arrays([ids, decoder.decode(ids)], names=["ids", "decoded"])
        del encoder, decoder
        release_memory()

    return both(text)


def encode_documents(df: DataFrame, text_column: str = "text", ids_column: str = "ids", path: str = MODEL_PATH) -> DataFrame:
    """All columns of ``df`` and the ids; an input column called like ``ids_column`` is replaced."""
    return df.withColumn(ids_column, encode_column(F.col(text_column).cast("string"), path))


def decode_documents(df: DataFrame, ids_column: str = "ids", decoded_column: str = "decoded", path: str = MODEL_PATH) -> DataFrame:
    """All columns of ``df`` and the text that the ids stand for."""
    return df.withColumn(decoded_column, decode_column(F.col(ids_column), path))


def round_trip(df: DataFrame, text_column: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """All columns of ``df``, ids and decoded, which replace input columns of these names."""
    out = df.withColumn("_coded", code_and_decode_column(F.col(text_column).cast("string"), path))
    return out.withColumns({"ids": F.col("_coded.ids"), "decoded": F.col("_coded.decoded")}).drop("_coded")
