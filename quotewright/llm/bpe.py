"""Byte-level BPE encoding and decoding with a segment tree for each pre-token.

A text is cut by the vocabulary's pattern; each piece is merged on its own. A segment tree over a piece's byte
positions holds (rank of the pair that starts there, position), so that its root is the leftmost pair of the least
rank. A merge takes the root, joins the live neighbours and updates three leaves, each along one path to the root.
Short pieces of a batch are merged in lockstep, one matrix row for each; long pieces one by one.

Defined results: a null text counts as empty and has no ids; text that UTF-8 cannot carry (lone surrogates) is encoded
with the replacement character, as the JVM never delivers it. Special tokens' strings are ordinary text. Decoding an id
outside the vocabulary raises ValueError; a null id list decodes to empty bytes. Rows are independent, so ties, repeated
rows and empty tables need no rule. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_CHUNK_CHARS, CACHE_ENTRIES

#: Pieces of up to this many bytes are merged in lockstep.
LOCKSTEP_BYTES = 64
NONE = (1 << 62) - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a rank file: base64 and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merger:
    """Ranks of id pairs, and the merging of pieces by segment trees."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.vocab = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a, b):
        """Ranks for arrays of neighbouring ids; ``NONE`` where a side is missing (negative) or the pair is no token."""
        import numpy as np

        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.values[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece, by one segment tree in a list."""
        n, pairs = len(piece), self.pairs
        ids = self.byte_ids[list(piece)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        leaves = 1 << max(0, n - 1).bit_length()
        none = NONE * leaves
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                value = left if left < right else right
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            rank, i = divmod(tree[1], leaves)
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = rank, -1, k
            put(j, none)
            if k >= 0:
                before[k] = i
                rank = pairs.get(ids[i] << 32 | ids[k])
                put(i, none if rank is None else rank * leaves + i)
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                rank = pairs.get(ids[h] << 32 | ids[i])
                put(h, none if rank is None else rank * leaves + h)
        return [x for x in ids if x >= 0]

    def merge_short(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Packed ids of pieces of ``leaves`` bytes or fewer, all trees in lockstep."""
        import numpy as np

        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(leaves + 2)
        inside = column[None, 1:-1] <= sizes[:, None]
        # Columns 0 and leaves + 1 stand for "no neighbour": their ids stay negative.
        ids = np.full((n, leaves + 2), -1, np.int64)
        ids[:, 1:-1][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.minimum(column + 1, leaves + 1), ids.shape).copy()
        before = np.broadcast_to(np.maximum(column - 1, 0), ids.shape).copy()
        width = leaves + 2
        none = NONE // width * width
        tree = np.full((n, 2 * leaves), none, np.int64)
        first = self.pair_ranks(ids[:, 1:-1], ids[:, 2:])
        tree[:, leaves:] = np.where(first < NONE, first * width + column[None, 1:-1], none)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j = after[live, i]
            k, h = after[live, j], before[live, i]
            ids[live, i], ids[live, j] = rank, -1
            after[live, i], before[live, k] = k, i
            new = self.pair_ranks(rank, ids[live, k])
            old = self.pair_ranks(ids[live, h], rank)
            some = h > 0
            tree[live, leaves + j - 1] = none
            tree[live, leaves + i - 1] = np.where(new < NONE, new * width + i, none)
            tree[live[some], leaves + h[some] - 1] = np.where(old < NONE, old * width + h, none)[some]
            paths = [leaves + j - 1, leaves + i - 1, np.where(some, leaves + h - 1, leaves + i - 1)]
            for _ in range(leaves.bit_length() - 1):
                paths = [p >> 1 for p in paths]
                for p in paths:
                    tree[live, p] = np.minimum(tree[live, 2 * p], tree[live, 2 * p + 1])
            live = live[tree[live, 1] < none]
        kept = ids[:, 1:-1] >= 0
        flat, ends = ids[:, 1:-1][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            if len(piece) == 1:
                out[at] = struct.pack("<I", self.byte_ids[piece[0]])
            elif len(piece) > LOCKSTEP_BYTES:
                ids = self.merge_long(piece)
                out[at] = struct.pack(f"<{len(ids)}I", *ids)
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
        for leaves, places in by_width.items():
            for at, ids in zip(places, self.merge_short([pieces[p] for p in places], leaves), strict=True):
                out[at] = ids
        return out


class ByteBpe:
    """Encoder and decoder of one vocabulary; what it remembers of chunks and pieces is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merger, self.find = Merger(ranks), regex.compile(pattern).findall
        self.vocab = self.merger.vocab
        #: Text after a single space -> packed ids, the space included, or None if that space is not safe; piece -> packed ids.
        self.chunks: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The text up to the first safe space, and what follows each safe space.

        The pattern treats these independently: it never matches across a single space with other text on
        both sides, except to take the space as the head of what follows.
        """
        parts = text.split(" ")
        out, held = [parts[0]], not _safe(parts[0])
        for p in parts[1:]:
            held = held or not p or p[0].isspace()
            if held:
                out[-1] += " " + p
            else:
                out.append(p)
            held = not p or p[-1].isspace()
        return out

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that are pre-tokenised each on its own."""
        cuts = list(map(self.find, texts))
        wanted = set(chain.from_iterable(cuts))
        ids = {p: self.pieces[p] for p in wanted if p in self.pieces}
        fresh = list(wanted.difference(ids))
        ids.update(zip(fresh, self.merger.merge([p.encode("utf-8", "replace") for p in fresh]), strict=True))
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        self.pieces.update((p, ids[p]) for p in fresh if len(p) <= CACHE_CHUNK_CHARS)
        return [b"".join(map(ids.__getitem__, ps)) for ps in cuts]

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cuts, known = [(t or "").split(" ") for t in texts], self.chunks
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = self._learn(cuts)
        heads, out, odd = self._packed([c[0] for c in cuts]), [], []
        for at, (head, c) in enumerate(zip(heads, cuts, strict=True)):
            try:
                out.append(head + b"".join(map(known.__getitem__, c[1:])) if len(c) < 2 or _safe(c[0]) else None)
            except TypeError:
                out.append(None)
            if out[-1] is None:
                odd.append(at)
        if odd:
            cuts = [self.cut(texts[at]) for at in odd]
            new += self._learn(cuts, safe=True)
            for at, head, c in zip(odd, self._packed([c[0] for c in cuts]), cuts, strict=True):
                out[at] = head + b"".join(map(known.__getitem__, c[1:]))
        for c in new:
            if len(c) > CACHE_CHUNK_CHARS or known.get(c) is not None and not _safe(c):
                known.pop(c, None)
        return out

    def _learn(self, cuts: list[list[str]], safe: bool = False) -> list[str]:
        """Fill in the chunks that are not known; ``safe`` says that even odd ones stand alone."""
        known = self.chunks
        new = [c for c in set().union(*(c[1:] for c in cuts)) if known.get(c) is None]
        plain = [c for c in new if safe or _safe(c)]
        if len(plain) < len(new):
            known.update(dict.fromkeys(new))
        known.update(zip(plain, self._packed([" " + c for c in plain]), strict=True))
        return new

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        import numpy as np

        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: list[int] | None) -> bytes:
        try:
            return b"".join(map(self.vocab.__getitem__, ids or ()))
        except KeyError as e:
            raise ValueError(f"id {e} is not in the vocabulary") from None


def _safe(chunk: str) -> bool:
    """Whether the chunk neither is empty nor begins or ends with white space."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


_codecs: dict[tuple, ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec to a Python worker and vocabulary."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            _codecs[path, pattern] = ByteBpe(read_ranks(f.read()), pattern)
    return _codecs[path, pattern]


#: Texts that are encoded together: enough to fill the lockstep, few enough to bound memory.
TEXTS_AT_ONCE = 256


def _groups(texts: list[str | None]) -> Iterator[slice]:
    yield from (slice(a, a + TEXTS_AT_ONCE) for a in range(0, len(texts), TEXTS_AT_ONCE))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _groups(texts):
                ids = codec(path, pattern).encode(texts[part])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of each row's ids."""

    def run(batches):
        for batch in batches:
            data = [codec(path, pattern).decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)).mapInArrow(run, "id long, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids need not travel."""

    def run(batches):
        bpe = codec(path, pattern)
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        decimal = {i: str(i) for i in bpe.vocab}.__getitem__
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _groups(texts):
                rows = [(len(x), hashlib.sha256(" ".join(map(decimal, x)).encode()).hexdigest(), hashlib.sha256(bpe.decode(x)).hexdigest()) for x in bpe.encode(texts[part])]
                n, a, b = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
