"""Whole-text encoding with the tokenizers library, where each distinct chunk of text is encoded once."""

from __future__ import annotations

import os
import re
import struct

from .common import CACHE_CHUNK_CHARS, CACHE_ENTRIES

#: New chunks that the library gets as one text.
CHUNKS_AT_ONCE = 4_096
#: Texts that are cut together.
TEXTS_AT_ONCE = 256
#: Marks a chunk that follows the one before without a space.
GLUE = "\0"

# A stop that does not follow a letter or digit; for the kind that normalises texts also one after a letter that may come apart.
_odd_stop = re.compile(r"[\W_][.,]").search
_odd_stop_normalised = re.compile("[\\W_\u0130\u0250-\U0010ffff][.,]").search


def safe_chunk(chunk: str) -> bool:
    """Whether the chunk is not empty and, but for the mark and a line feed after it, has no white space at its ends."""
    if chunk[:1] == GLUE:
        chunk = chunk[2:] if chunk[1] == "\n" else chunk[1:]
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


class ChunkTokenizer:
    """Ids of whole texts, as the library gives them, packed as little-endian unsigned 32-bit integers.

    Texts are cut where the pre-tokenizer always cuts: before a single space or line feed with other text on both sides
    (the byte-level kind takes the space as the head of what follows, the word kind drops it), and before a comma or full
    stop that follows a letter or digit. The library encodes each distinct chunk, and results are joined; a text
    with other white space around its spaces goes to the library whole. New chunks are encoded together, as one text, and
    told apart by tokens of which each of them has exactly one. What is remembered is bounded: two generations, of
    which the older goes when the younger is full, so that frequent chunks stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.vocab_size = self.library.get_vocab_size()
        #: Whether spaces count: the byte-level kind keeps them, the word kind drops them.
        self.keeps_space = self._encode(["a b"])[0] != b"".join(self._encode(["a", "b"]))
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.marks = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.marks[i] = token.startswith("Ġ") if self.keeps_space else token.endswith("</w>")
        feed = self._encode(["\n"])[0]
        self.feed = int.from_bytes(feed, "little") if len(feed) == 4 else None
        self.chunks: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if not (_odd_stop if self.keeps_space else _odd_stop_normalised)(text):
            text = text.replace(",", " \0,").replace(".", " \0.")
        return text.replace("\n", " \0\n" if self.keeps_space else " ").split(" ")

    def _together(self, chunks: list[str], joined: str, mark, first: bool) -> list[bytes]:
        """Ids of chunks from their joined text, where ``mark(ids)`` is true once for each, at its first or last token."""
        import numpy as np

        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(mark(ids))
        if len(at) != len(chunks) or (at[0] != 0 if first else at[-1] != len(ids) - 1):
            return self._encode([self._plain(c) for c in chunks])
        ends = (4 * (np.append(at[1:], len(ids)) if first else at + 1)).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _plain(self, chunk: str) -> str:
        """What the library is given for a chunk alone."""
        return chunk[1:] if chunk[:1] == GLUE else " " + chunk if self.keeps_space else chunk

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        spaced, lines, others = [], [], []
        for c in chunks:
            if c[:1] != GLUE:
                (spaced if self.keeps_space or c.isalpha() else others).append(c)
            else:
                (lines if c[1:2] == "\n" and self.feed is not None and "\n" not in c[2:] else others).append(c)
        for a in range(0, len(spaced), CHUNKS_AT_ONCE):
            part = spaced[a : a + CHUNKS_AT_ONCE]
            joined = "".join(map(self._plain, part)) if self.keeps_space else " ".join(part)
            out.update(zip(part, self._together(part, joined, lambda ids: self.marks[ids], self.keeps_space), strict=True))
        for a in range(0, len(lines), CHUNKS_AT_ONCE):
            part = lines[a : a + CHUNKS_AT_ONCE]
            out.update(zip(part, self._together(part, "".join(map(self._plain, part)), lambda ids: ids == self.feed, True), strict=True))
        out.update(zip(others, self._encode([self._plain(c) for c in others]), strict=True))
        return out

    def _learn(self, wanted: set[str]) -> list[str]:
        """Fill in chunks that are not known; returns those to be forgotten after this batch."""
        if len(self.chunks) > CACHE_ENTRIES // 2:
            self.older, self.chunks = self.chunks, {}
        known = self.chunks
        new = wanted.difference(known)
        known.update((c, self.older[c]) for c in new if c in self.older)
        new = list(new.difference(known))
        good = [c for c in new if safe_chunk(c)] if self.keeps_space else new
        known.update(self._encode_chunks(good))
        if len(good) < len(new):
            known.update(dict.fromkeys(c for c in new if c not in known))
        return [c for c in new if len(c) > CACHE_CHUNK_CHARS]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        whole = [at for at, t in enumerate(texts) if GLUE in t]
        cuts = [[""] if GLUE in t else self._cut(t) for t in texts]
        if not self.keeps_space:
            long = self._learn(set().union(*cuts))
            out = [b"".join(map(self.chunks.__getitem__, c)) for c in cuts]
        else:
            long = self._learn(set().union(*(c[1:] for c in cuts)))
            out = []
            for at, (head, c) in enumerate(zip(self._encode([c[0] for c in cuts]), cuts, strict=True)):
                try:
                    if len(c) > 1 and not safe_chunk(c[0]):
                        raise TypeError
                    out.append(head + b"".join(map(self.chunks.__getitem__, c[1:])))
                except TypeError:  # a chunk without ids: its space is not safe
                    out.append(b"")
                    whole.append(at)
        for at, ids in zip(whole, self._encode([texts[at] for at in whole]), strict=True):
            out[at] = ids
        for c in long:
            del self.chunks[c]
        return out


_known: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One to a Python worker and file."""
    if path not in _known:
        _known[path] = ChunkTokenizer(path)
    return _known[path]


def slices(n: int) -> list[slice]:
    return [slice(a, a + TEXTS_AT_ONCE) for a in range(0, n, TEXTS_AT_ONCE)]
