"""Byte-level BPE encoding and decoding of whole texts by given merge ranks.

A text is cut into pieces by the tokenizer's pattern, and each piece is merged on its own. A segment
tree over the piece's byte positions holds, for every live pair of neighbours, its rank; the root
names the leftmost pair of least rank, and each merge updates three leaves. Short pieces go through
the same steps many at a time, as rows of numpy arrays; long ones alone. Pieces repeat a lot, so a task
keeps the ids of short pieces it has met, up to a bound; that changes no result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm._stage import long_rows
from tidelog.llm._text import chunks, named

#: Pieces of at most MEMO_BYTES are merged in rows and remembered, MEMO_PIECES of them at most in each Python worker.
MEMO_BYTES, MEMO_PIECES = 64, 300_000
#: Leaves of all trees that are worked on at a time.
_LEAVES = 1 << 18
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a file of `base64 rank` lines; the vocabulary bounds its size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << max(1, (n - 1).bit_length())
    none = _NONE
    tree = [none] * (2 * leaves)  # rank * leaves + position, so that the least is also the leftmost
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for at in range(n - 1):
        rank = ranks.get(piece[at : at + 2])
        if rank is not None:
            tree[leaves + at] = rank * leaves + at
    for at in range(leaves - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b

    def put(at: int, value: int) -> None:
        at += leaves
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a < b else b
            if tree[at] == low:
                break
            tree[at] = low

    while tree[1] < none:
        at = tree[1] % leaves
        gone = after[at]
        end = after[gone]
        after[at] = end
        if end < n:
            before[end] = at
            rank = ranks.get(piece[at : after[end]])
            put(at, none if rank is None else rank * leaves + at)
        else:
            put(at, none)
        put(gone, none)
        if (left := before[at]) >= 0:
            rank = ranks.get(piece[left:end])
            put(left, none if rank is None else rank * leaves + left)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Pairs:
    """Rank of two neighbouring tokens by their ids: that of the token whose bytes are theirs together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = [(left << 32 | right, rank) for token, rank in ranks.items() for cut in range(1, len(token)) if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.ranks = np.r_[table[:, 0], _NONE], np.r_[table[:, 1], _NONE]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)


def merge_rows(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Packed ids of pieces of two bytes or more that have as many leaves: one segment tree a row."""
    leaves = 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
    sizes = np.array([len(p) for p in pieces])
    m = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(m, leaves)
    tokens = pairs.of_byte[raw]
    after = np.tile(np.arange(1, leaves + 1), (m, 1))
    before = after - 2
    tree = np.full((m, 2 * leaves), _NONE)
    place = np.arange(leaves - 1)
    rank = pairs.rank(tokens[:, :-1], tokens[:, 1:])
    tree[:, leaves:-1] = np.where((rank < _NONE) & (place < sizes[:, None] - 1), rank * leaves + place, _NONE)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    live = np.zeros((m, leaves), bool)
    live[:, :] = np.arange(leaves) < sizes[:, None]

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        at = at + leaves
        tree[rows, at] = value
        while leaves > 1 and at[0] > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = pairs.rank(left, right)
        return np.where(found < _NONE, found * leaves + at, _NONE)

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        least = tree[rows, 1]
        at, token = least % leaves, least // leaves
        gone = after[rows, at]
        end = after[rows, gone]
        tokens[rows, at] = token
        after[rows, at] = end
        live[rows, gone] = False
        put(rows, gone, _NONE)
        inner = end < sizes[rows]
        put(rows, at, _NONE)
        r, e = rows[inner], end[inner]
        if len(r):
            before[r, e] = at[inner]
            put(r, at[inner], ranked(token[inner], tokens[r, e], at[inner]))
        left = before[rows, at]
        inner = left >= 0
        r, e = rows[inner], left[inner]
        if len(r):
            put(r, e, ranked(tokens[r, e], token[inner], e))
        rows = rows[tree[rows, 1] < _NONE]
    ids = tokens[live].astype("<u4").tobytes()
    bounds = np.r_[0, np.cumsum(live.sum(axis=1))] * 4
    return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts inside one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of new pieces; short ones are remembered."""
        out, rows = {}, {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > MEMO_BYTES:
                out[piece] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                rows.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, some in rows.items():
            step = max(1, _LEAVES >> bits)
            for begin in range(0, len(some), step):
                part = some[begin : begin + step]
                out.update(zip([p for p, _ in part], merge_rows([raw for _, raw in part], self.pairs), strict=True))
        if len(self.memo) + len(out) > MEMO_PIECES:
            self.memo.clear()
        if len(out) <= MEMO_PIECES:
            self.memo.update((p, ids) for p, ids in out.items() if len(p) <= MEMO_BYTES)
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.find(x) if x else [] for x in texts]
        known = self.memo
        missing = {p for pieces in cut for p in pieces if p not in known}
        if not missing:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        held = {p: known[p] for pieces in cut for p in pieces if p in known} if len(known) + len(missing) > MEMO_PIECES else known
        new = self.learn(missing)
        return [b"".join([new[p] if p in new else held[p] for p in pieces]) for pieces in cut]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Adds n_tokens and `ids` (binary, little-endian unsigned 32-bit) of column `text`; columns of these names are replaced.

    No special tokens: their strings are ordinary text. Null and empty texts have no ids. All bytes
    must have a rank, as in any byte-level vocabulary. An empty table gives an empty table.
    """
    df = long_rows(df.drop("n_tokens", "ids"))
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    names = df.columns
    made: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Encoder(*shared.value))
        for batch in batches:
            for part in chunks(batch):
                ids = made[0].encode_all(named(part, "text").to_pylist())
                yield pa.record_batch([*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*names, "n_tokens", "ids"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def decode(df: DataFrame, ranks: dict[bytes, int], column: str = "ids") -> DataFrame:
    """Adds `decoded` (binary), the bytes that the ids in `column` stand for (a column of this name is replaced; null ids: null).

    An id that the vocabulary lacks fails the task.
    """
    df = long_rows(df.drop("decoded"))
    shared = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            for part in chunks(batch, column):
                decoded = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in named(part, column).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(decoded, pa.binary())], [*names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))
