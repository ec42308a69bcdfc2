"""Operator 2: BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can end its encoding. The
encoder walks an automaton whose suffix links list the vocabulary entries that end
at a position, longest first, and keeps the first that may follow the last token of
the prefix before it; following those tokens back from the end gives the ids. Whether
two tokens may stand side by side is a property of the pair alone: while the merges
inside both are replayed from the bytes at their border outwards, no merge across the
border may come up first.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemill.llm.common import map_rows

#: Fixed value: the pre-tokenising pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40
#: Entries of the per-task caches (words; pairs of tokens).
CACHE_WORDS = 250_000
CACHE_PAIRS = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = n
            self.parts.setdefault(self.ids[a + b], (*pair, n))
        self._build_automaton()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.border = lru_cache(maxsize=None)(self._border)
        self.follows: dict[int, bool] = {}
        self.whole = cache(self._whole)

    def _border(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The nodes of a token's merge tree along one border, from the byte up, each with the rank of the merge that consumes it."""
        path, rank = [], NEVER
        while True:
            path.append((token, rank))
            if token not in self.parts:
                return path[::-1]
            a, b, rank = self.parts[token]
            token = b if right else a

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as these two tokens."""
        known = self.follows.get(a << 20 | b)
        if known is None:
            if len(self.follows) >= CACHE_PAIRS:
                self.follows.clear()
            known = self.follows[a << 20 | b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, i, j = self.border(a, True), self.border(b, False), 0, 0
        while True:
            (x, next_x), (y, next_y) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            # of equal merges the leftmost comes first
            if across < next_x and across <= next_y and across < NEVER:
                return False
            if next_x == next_y == NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token: its own two parts meet before any other merge."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        if not (self.whole(a) and self.whole(b)):
            return False
        left, right, i, j = self.border(a, True), self.border(b, False), 0, 0
        while i < len(left) - 1 or j < len(right) - 1:
            (x, next_x), (y, next_y) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            if across < next_x and across <= next_y and across < NEVER:
                return False
            i, j = (i + 1, j) if next_x <= next_y else (i, j + 1)
        return True

    def _build_automaton(self) -> None:
        """States for all prefixes of tokens; ``link`` leads to the longest proper suffix that is a state, ``ends`` lists the tokens that end there."""
        self.step, self.link, self.ends = {}, [0], [()]
        level = {0: [(token, i) for token, i in self.ids.items()]}
        depth = 0
        while level:
            deeper: dict[int, list] = {}
            for state, tokens in level.items():
                for token, i in tokens:
                    key = state << 8 | token[depth]
                    child = self.step.get(key)
                    if child is None:
                        child = self.step[key] = len(self.link)
                        back = self.link[state]
                        while state and back and back << 8 | token[depth] not in self.step:
                            back = self.link[back]
                        self.link.append(self.step.get(back << 8 | token[depth], 0) if state else 0)
                        self.ends.append(None)
                    if len(token) == depth + 1:
                        self.ends[child] = ((i, depth + 1),)
                    else:
                        deeper.setdefault(child, []).append((token, i))
            depth += 1
            level = deeper
        for state in range(1, len(self.link)):  # links lead to shorter prefixes, which have smaller numbers
            self.ends[state] = (self.ends[state] or ()) + self.ends[self.link[state]]

    def _next(self, state: int, byte: int) -> int:
        """The state after one more byte; kept, so that links are followed once."""
        back = state
        while (found := self.step.get(back << 8 | byte)) is None and back:
            back = self.link[back]
        self.step[state << 8 | byte] = found = found or 0
        return found

    def encode_sorted(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens in sorted order: what is stored for a prefix serves all neighbours that share it."""
        states, last, size, before, out = [0], [-1], [0], b"", []
        step, ends, known = self.step, self.ends, self.follows.get
        for piece in pieces:
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], size[shared + 1 :]
            for at in range(shared, len(piece)):
                state = step.get(states[at] << 8 | piece[at])
                if state is None:
                    state = self._next(states[at], piece[at])
                for token, length in ends[state]:
                    start = at + 1 - length
                    if start == 0:
                        fits = self.whole(token)
                    elif (fits := known(last[start] << 20 | token)) is None:
                        fits = self.compatible(last[start], token)
                    if fits:
                        break
                states.append(state)
                last.append(token)
                size.append(length)
            ids, end = [], len(piece)
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            out.append(ids)
            before = piece
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.encode_sorted([piece])[0]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special tokens in it become their ids."""
        return [int(i) for i in TextCodec(self).encode(text).split(",") if i]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class TextCodec:
    """Whole texts to ids in decimal text and back; ids of recent pre-tokens are kept in two generations."""

    def __init__(self, bpe: PrefixBPE) -> None:
        self.bpe, self.recent, self.older = bpe, {}, {}
        self.token_bytes = {str(i): b for i, b in bpe.bytes_of.items()}

    def _learn(self, pieces: set[str]) -> None:
        """Has ids for these pre-tokens in ``recent``."""
        new = pieces.difference(self.recent)
        if len(self.recent) + len(new) > CACHE_WORDS:
            self.older, self.recent = self.recent, {}
            new = pieces
        kept = new.intersection(self.older)
        self.recent.update((piece, self.older[piece]) for piece in kept)
        rest = sorted(piece.encode() for piece in new.difference(kept))
        for piece, ids in zip(rest, self.bpe.encode_sorted(rest), strict=True):
            self.recent[piece.decode()] = ",".join(map(str, ids))

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Ids of each text, joined by commas."""
        split, special = self.bpe.pieces.findall, self.bpe.split_special
        dealt = []
        for text in texts:
            if special is None or not special.search(text):
                dealt.append(split(text))
            else:  # what is between special tokens is split alone
                dealt.append([p for part in special.split(text) for p in ((part,) if part in self.bpe.special else split(part))])
        self._learn(set().union(*dealt).difference(self.bpe.special))
        known = self.recent
        for token, i in self.bpe.special.items():
            known.setdefault(token, str(i))
        return [",".join(map(known.__getitem__, pieces)) for pieces in dealt]

    def encode(self, text: str) -> str:
        return self.encode_batch([text])[0]

    def decode(self, ids: str) -> bytes:
        """UTF-8 of the decoded text."""
        data = b"".join(map(self.token_bytes.__getitem__, ids.split(","))) if ids else b""
        return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> TextCodec:
    """The codec of a vocabulary file, once in each Python worker."""
    return TextCodec(PrefixBPE(path))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """Encodes every text and decodes it again.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with ``ids`` (array)
    before the hashes if ``keep_ids`` and ``decoded`` behind it if also ``keep_decoded``. A null text counts as empty: no tokens, the hashes
    of the empty string. Repeated rows and ids give one row each; further columns of ``docs`` are
    left out; an empty table gives an empty table. Nothing is shuffled.
    """
    sha = lambda data: hashlib.sha256(data).hexdigest()
    keep_decoded = keep_ids and keep_decoded
    fields = [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_decoded
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def make():
        texts = codec(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {"n": [], "i": [], "d": [], "ids": [], "decoded": []}
            whole = [text or "" for text in batch.column(1).to_pylist()]
            for ids in texts.encode_batch(whole):
                data = texts.decode(ids)
                out["n"].append(ids.count(",") + 1 if ids else 0)
                out["i"].append(sha(ids.encode()))
                out["d"].append(sha(data))
                if keep_ids:
                    out["ids"].append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                if keep_decoded:
                    out["decoded"].append(data.decode())
            kept = [pa.array(out[name], kind) for name, kind in fields]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), *kept, pa.array(out["i"]), pa.array(out["d"])], [id_col, "n_tokens", *(name for name, _ in fields), "ids_sha256", "decoded_sha256"])

        return each

    kept = "ids array<int>, " * keep_ids + "decoded string, " * keep_decoded
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {id_type}, n_tokens bigint, {kept}ids_sha256 string, decoded_sha256 string")
