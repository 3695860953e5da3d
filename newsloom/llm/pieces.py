"""A fixed public piece vocabulary and the numpy lattice over equal-length strings.

Strings of one length form a matrix of code points. The hashes of all its
substrings of one length come from those one shorter in a single step, and
probe the sorted hashes of the pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
FILTER_BITS = 21
#: lattice cells (strings x ends x piece lengths) in memory at once
CELLS = 500_000


class Pieces:
    """Ids, strings and hashed keys of a SentencePiece vocabulary; the word mark is a space here."""

    def __init__(self, path: str = MODEL_PATH):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_first = np.full(256, -1, np.int32)  # id of each byte piece
        self.text_bytes: list[bytes] = []  # what an id decodes to
        strings, ids = [], []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_first[value] = i
                self.text_bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text_bytes.append(b"")
            else:
                strings.append(piece.replace("▁", " "))
                ids.append(i)
                self.text_bytes.append(strings[-1].encode())
        self.strings, self.ids = strings, np.array(ids, np.int32)
        self.max_length = max(map(len, strings))
        keys = np.array([hash_of(s) for s in strings], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_piece = keys[order], np.arange(len(strings), dtype=np.int32)[order]
        assert (np.diff(self.keys.astype(object)) > 0).all(), "two pieces have one hash"
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        # characters that no longer piece contains: units can be cut there without losing a segmentation
        self.alone = {s for s in strings if len(s) == 1} - {c for s in strings if len(s) > 1 for c in s}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index into ``strings`` of each key, -1 where no piece has it."""
        found = np.full(keys.shape, -1, np.int32)
        near = np.nonzero(self.filter[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        probe = keys[near]
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        found[near] = np.where(self.keys[at] == probe, self.key_piece[at], -1)
        return found

    def lattice(self, codes: np.ndarray) -> np.ndarray:
        """(strings, ends 0..L, lengths 1..m): index of the piece of that length which ends there, or -1."""
        n, length = codes.shape
        m = min(self.max_length, length)
        out = np.full((n, length + 1, m), -1, np.int32)
        codes = codes.astype(np.uint64) + np.uint64(1)
        running = codes
        for k in range(1, m + 1):
            if k > 1:
                running = running[:, :-1] * BASE + codes[:, k - 1:]
            out[:, k:, k - 1] = self.find(mixed(running))
        return out


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * MIX
    return keys ^ (keys >> np.uint64(29))


def hash_of(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    running = codes[:1].copy()
    for c in codes[1:]:
        running = running * BASE + c
    return int(mixed(running)[0])


def by_length(strings: list[str], cells_per_char: int):
    """Blocks of (positions, code points) of strings of one length, small enough to hold in memory."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        length = int(lengths[order[a]])
        step = max(1, CELLS // (max(length, 1) * cells_per_char))
        for s in range(a, b, step):
            where = order[s:min(s + step, b)]
            if length:
                joined = "".join([strings[i] for i in where])
                yield where, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(where), length)


@lru_cache(maxsize=2)
def pieces(path: str = MODEL_PATH) -> Pieces:
    """One vocabulary per worker process."""
    return Pieces(path)
