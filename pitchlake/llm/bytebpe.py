"""Byte-level BPE with a bucketed rank queue.

A text is cut by the vocabulary's pattern; each match is merged on its own.
The matches of some texts that are not known yet are merged together in one
queue: their bytes form one linked list of tokens, with no pair across the
border of two matches, and every merge rank has a bucket of positions in it. A
bitmap of two levels of 256-bit words tells which buckets are in use:
find-first-set on each level gives the lowest rank without a scan. Its bucket is
worked off from left to right; a position whose pair has changed since is stale
and is skipped. Where a merge makes a pair of a lower rank, the rest of the
bucket waits for it. So every match is merged in its own order of ranks, and n
bytes take n log n steps at worst (the sorting of buckets), also where one match
is a whole long document.

Results of matches are remembered per Python worker; of two generations the
older goes when the younger is full, so the memory is bounded. Texts are cut, and new
matches merged, some at a time: by number and by bytes. A match is coded whole, so
beyond these bounds memory grows with the longest match and the longest text only.

Null and empty texts have no tokens, repeated rows come once each, columns other than
id and text are not read (so their names cannot clash), and an empty table gives an empty result. All 256 single bytes must be in the
vocabulary, so every text can be coded; decoding gives back its bytes."""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batched, id_text, remembers, rows, slices

REMEMBERED = 250_000
#: texts that are cut into matches at a time, by number and by UTF-8 bytes (one text at least)
AT_ONCE, BYTES_AT_ONCE = 256, 2 << 20
#: bytes of new matches that share a queue (one match at least)
MERGED_BYTES = 256 << 10
#: longer matches are coded each time, so that the memory stays bounded in bytes too
REMEMBER_BYTES = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks = load_ranks(path)
        self.n_ranks = max(self.ranks.values()) + 1
        self.find = regex.compile(pattern).findall
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pair_rank = np.full((256, 256), -1, dtype=np.int64)
        self.token_bytes: list[bytes] = [b""] * self.n_ranks
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
            if len(token) == 2:
                self.pair_rank[token[0], token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each match."""
        data = b"".join(pieces)
        n, get = len(data), self.ranks.get
        if not n:
            return [[] for _ in pieces]
        raw = np.frombuffer(data, dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        ranks = np.full(n, -1, dtype=np.int64)
        ranks[:-1] = self.pair_rank[raw[:-1], raw[1:]]
        ranks[ends[ends > 0] - 1] = -1
        # the linked list; a token is named by where it starts. A match begins where nothing is before
        after, before = list(range(1, n + 2)), list(range(-1, n))
        for i in ends.tolist():
            before[i] = -1
        pair = ranks.tolist()
        order = np.argsort(ranks, kind="stable")
        order = order[ranks[order] >= 0]
        low, top, buckets = [0] * (self.n_ranks // 256 + 1), 0, {}
        for positions in np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1):
            if len(positions):
                rank = pair[positions[0]]
                buckets[rank] = positions.tolist()
                low[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            bit = bits & -bits
            rank = word << 8 | bit.bit_length() - 1
            low[word] = bits = bits ^ bit
            if not bits:
                top ^= 1 << word
            positions = buckets.pop(rank)
            positions.sort()
            for at, i in enumerate(positions):
                if pair[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[i] = after[j]
                pair[j] = new = -1
                if before[k] == j:
                    before[k] = i
                    new = get(data[i : after[k]], -1)
                pair[i] = new
                least, left = rank, before[i]
                while True:  # the pair on the right, then the one on the left
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            low[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                            if new < least:
                                least = new
                    if left < 0:
                        break
                    i, left = left, -1
                    new = pair[i] = get(data[i:k], -1)
                if least < rank:
                    if rest := positions[at + 1 :]:
                        buckets[rank] = rest + buckets.get(rank, [])
                        low[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
                    break
        out, i, token = [], 0, self.ranks
        for end in ends.tolist():
            ids = []
            while i < end:
                ids.append(token[data[i : after[i]]])
                i = after[i]
            out.append(ids)
        return out

    def learn(self, matches: set[str], more: dict[str, bytes]) -> None:
        """Code matches; long ones go to ``more``, which the caller keeps for as long as it needs them."""
        new, pieces, get = [], [], self.ranks.get
        for m in matches:
            piece = m.encode()
            whole = get(piece)
            if whole is not None:
                self.known[m] = whole.to_bytes(4, "little")
            else:
                new.append(m)
                pieces.append(piece)
        for part in slices(list(map(len, pieces)), len(pieces) or 1, MERGED_BYTES):
            for m, piece, ids in zip(new[part], pieces[part], self.merge(pieces[part])):
                (self.known if len(piece) <= REMEMBER_BYTES else more)[m] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) >= self.remembered:
            self.older, self.known = self.known, {}
        found = [self.find(t) for t in texts]
        missing = set().union(*found).difference(self.known) if found else set()
        for m in missing.intersection(self.older):
            self.known[m] = self.older[m]
        more: dict[str, bytes] = {}
        self.learn(missing.difference(self.known), more)
        get = self.known.__getitem__
        if more:
            get = lambda m: self.known.get(m) or more[m]
        return [b"".join(map(get, matches)) for matches in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of this Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        remembers("bytebpe", _CODERS.clear)
        bpe = coder(path, pattern)

        def out():
            for b in batches:
                for at in slices(pc.binary_length(b.column("text")).to_pylist(), AT_ONCE, BYTES_AT_ONCE):
                    part = b.slice(at.start, at.stop - at.start)
                    yield from zip(part.column("doc_id").to_pylist(), bpe.encode(part.column("text").to_pylist()))

        yield from batched(out(), schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])

    def run(batches):
        remembers("bytebpe", _CODERS.clear)
        bpe = coder(path, pattern)
        yield from batched(((d, i, bpe.decode(i)) for d, i in rows(batches, "doc_id", "ids")), schema)

    return coded.mapInArrow(run, "doc_id long, ids binary, bytes binary")
