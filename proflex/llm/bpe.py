"""Operator 10: byte-level BPE encoding and decoding.

The bytes of a pre-token are read as Latin-1 text, so an Aho-Corasick automaton over the
vocabulary (also as Latin-1) finds every vocabulary entry in one pass; kept is the longest
that starts at each byte.  The encoder walks forward with these longest entries.  Two adjacent
tokens stand in the output of the merge procedure exactly when merging their joined bytes
gives the two again; this answer is memoised per pair.  When a pair is not compatible the
encoder tries the next shorter entry, and when none is left it steps back and never ends a
token at that byte again, so each byte is given up at most once: linear time.

Results equal those of the merge procedure on each match of the split pattern.

Edge cases: null and empty texts give 0 tokens and the digests of no bytes; repeated rows give
repeated results; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import id_and_text, map_batches

#: Entries held by a task's memo tables; a full table is emptied, which costs time only.
MEMO_ENTRIES = 400_000


class ByteBPE:
    """Encoder and decoder for one rank file; not shared between threads."""

    def __init__(self, rank_path: str, pattern: str, memo_entries: int = MEMO_ENTRIES):
        import ahocorasick
        import regex

        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank)
                          for word, rank in (line.split() for line in lines if line.strip())}
        self.words = {rank: word for word, rank in self.ranks.items()}
        self.sizes = {rank: len(word) for word, rank in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, rank in self.ranks.items():
            self.automaton.add_word(word.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.memo_entries = memo_entries
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.encoded: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merge procedure itself, quadratic; used on the bytes of two tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merge procedure can put these two tokens beside each other."""
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            a, b = self.words[left], self.words[right]
            if len(self.compatible) >= self.memo_entries:
                self.compatible.clear()
            known = self.compatible[pair] = self.merged(a + b) == [a, b]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of `token`, or -1."""
        known = self.shorter.get(token)
        if known is None:
            word = self.words[token]
            known = next((self.ranks[word[:n]] for n in range(len(word) - 1, 0, -1)
                          if word[:n] in self.ranks), -1)
            self.shorter[token] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        sizes, fits, compatible, shorter = self.sizes, self.fits, self.compatible, self.shorter
        size = len(data)
        longest = [-1] * size
        reach = [0] * size
        for end, token in self.automaton.iter(data.decode("latin-1")):
            length = sizes[token]
            start = end + 1 - length
            if length > reach[start]:
                reach[start], longest[start] = length, token
        pos, last, tokens, dead = 0, -1, [], set()
        token = longest[0]
        while pos < size:
            while token >= 0:
                end = pos + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    known = compatible.get((last, token))
                    if fits(last, token) if known is None else known:
                        break
                known = shorter.get(token)
                token = self.next_shorter(token) if known is None else known
            if token >= 0:
                tokens.append(token)
                last, pos = token, end
                token = longest[pos] if pos < size else -1
            elif tokens:
                dead.add(pos)
                token = tokens.pop()
                pos -= sizes[token]
                last = tokens[-1] if tokens else -1
                token = self.next_shorter(token)
            else:
                raise ValueError("the rank file lacks a token for a single byte")
        return tokens

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        known = self.encoded
        pieces = self.findall(text)
        if len(known) > self.memo_entries:
            known.clear()
        for piece in set(pieces).difference(known):
            tokens = self.encode_piece(piece.encode())
            known[piece] = struct.pack(f"<{len(tokens)}I", *tokens)
        return b"".join([known[piece] for piece in pieces])

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def worker_codec(rank_path: str, pattern: str) -> ByteBPE:
    """One codec for the tasks that follow each other in a Python worker: its tables hold what is true of the
    rank file, and stay below their fixed size."""
    return ByteBPE(rank_path, pattern)


def encode_documents(df: DataFrame, rank_path: Callable[[], str], pattern: str,
                     id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    `with_ids` also ids (array of int) and decoded (binary).

    `rank_path` is called in the task, as the file may lie elsewhere on each machine.  A
    projection of the rows: nothing is shuffled, and a lost task is run again alone."""
    source = id_and_text(df, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += ", ids array<int>, decoded binary"

    def make():
        import numpy as np
        from proflex.llm.bpe import worker_codec
        codec = worker_codec(rank_path(), pattern)

        def row(doc_id, text):
            ids = codec.encode(text or "")
            decoded = codec.decode(ids)
            out = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                   hashlib.sha256(decoded).hexdigest())
            return [out + (np.frombuffer(ids, "<u4").tolist(), decoded) if with_ids else out]
        return row

    return map_batches(source, make, fields)
