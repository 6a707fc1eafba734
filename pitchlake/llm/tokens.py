"""Token ids of whole texts by a public word-level BPE vocabulary file.

The vocabulary drops white space, cuts letters, single digits and marks apart, and
never joins across a cut, so the ids of a text are the ids of its pieces put together.
Arrow lower-cases the texts of a batch that hold only printable ASCII, plain Latin letters
and blanks, and splits them into white-space-separated chunks; the distinct chunks are
parted into pieces as the vocabulary's own pre-tokenizer does, and the distinct pieces are
looked up, or coded by the library's BPE model where the task has not met them. Two
``take``s make the ids of all texts. In other texts a chunk of those characters is
cut likewise, any other goes through the library's whole chain. Texts with combining
marks, with which a capital may compose otherwise than a small letter, are not
lower-cased before they are split.

Everything held is bounded in bytes: a batch has about ``AT_ONCE`` bytes of text (or
one text), and what is remembered is a number of entries, none longer than ``LONGEST``.
Of two generations the older goes when the younger is full, which changes nothing but
speed."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACES, remembers

REMEMBERED = 300_000
#: longer pieces and chunks (in characters) are coded each time
LONGEST = 64
#: bytes of text whose chunks are numbered together
AT_ONCE = 8 << 20
_LATIN = "ßà-öø-įı-ſ"  # letters that no normalisation changes, lower case or without case
#: a chunk that is cut here
PLAIN = re.compile(f"[!-~À-Ö{_LATIN}Ø-Þ]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


#: a text that is cut as a whole, and its pieces, for Arrow
PLAIN_TEXT = rf"\A[!-~À-Ö{_LATIN}Ø-Þ{SPACES}]*\z"
CUT = f"('s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}{SPACES}]+)"
#: combining marks
COMBINING = "[\u0300-\u036f]"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARACTERS = byte_characters()


class Remembered(dict):
    """A memory of two generations; a missing key is made by ``make``, and forgotten if longer than ``longest``."""

    def __init__(self, make, size: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.pieces = Remembered(self._piece, remembered)
        self.others = Remembered(self._whole_chain, remembered // 4)

    def _packed(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return self._packed([t.id for t in self.model.tokenize(piece)])

    def _whole_chain(self, chunk: str) -> bytes:
        return self._packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            return b"".join([self.pieces[p] for p in PIECES.findall(chunk.lower())])
        return self.others[chunk]

    def encode(self, text: str) -> bytes:
        """Ids of a text, little endian, in the width of ``kind``."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (none null)."""
        plain = pc.match_substring_regex(texts, PLAIN_TEXT)
        found = iter(_joined(pc.utf8_lower(texts.filter(plain)), self._cut))
        others = texts.filter(pc.invert(plain))
        marked = pc.match_substring_regex(others, COMBINING)
        rest = iter(_joined(pc.if_else(marked, others, pc.ascii_lower(others)), lambda c: _table(c, self._chunk)))
        return [next(found) if p else next(rest) for p in plain.to_pylist()]

    def _cut(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of a batch's distinct plain chunks."""
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(chunks, CUT, "\\1 "))
        data, begins = _taken(pieces, lambda p: _table(p, self.pieces.__getitem__))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(begins), data])


def _table(parts: pa.Array, code) -> pa.Array:
    return pa.array(map(code, parts.to_pylist()), pa.large_binary())


def _taken(lists: pa.Array, code) -> tuple[pa.Buffer, np.ndarray]:
    """The ids of all parts of all lists in one buffer, and where each list begins and the last one ends."""
    numbered = lists.flatten().dictionary_encode()
    ids = code(numbered.dictionary).take(numbered.indices)
    ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
    return ids.buffers()[2] or pa.py_buffer(b""), ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]


def _joined(texts: pa.Array, code) -> list[bytes]:
    """Each text's white-space-separated parts, coded and put together."""
    data, begins = _taken(pc.ascii_split_whitespace(texts), code)
    data = memoryview(data)
    return [bytes(data[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def id_kind(path: str) -> np.dtype:
    """How wide the ids of a vocabulary are kept."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def encoded(batches, path: str, end_id: int):
    """(doc_id, ids with ``end_id`` at the end) for each row of Arrow batches with doc_id and text."""
    remembers("tokens", _ENCODERS.clear)
    enc = encoder(path)
    end = np.array([end_id], dtype=enc.kind).tobytes()
    for batch in batches:
        ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
        lo = 0
        while lo < len(texts):
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + AT_ONCE, side="right")))
            for doc_id, coded in zip(ids.slice(lo, hi - lo).to_pylist(), enc.encode_all(texts.slice(lo, hi - lo))):
                yield doc_id, np.frombuffer(coded + end, dtype=enc.kind)
            lo = hi
