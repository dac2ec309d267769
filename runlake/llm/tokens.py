"""Exact, cached encoding with the public BPE tokenizers.

Both vocabularies split a text into pieces before any merge is applied, and a
piece never reaches across a lone ASCII space between two visible characters.
Texts are therefore cut there; Arrow finds a batch's distinct chunks, each is
encoded once per worker, and numpy puts the ids in place. The ids equal those
of the whole text (tests compare with ``Tokenizer.encode``), at a fraction of
the time.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are certainly neither white space nor combining marks.
_VISIBLE = "!-~¡-˿Ͱ-҂‐-‧‰-⁞₠-₿"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks whose pieces a plain ``re`` pattern finds: ASCII, Latin-1 letters, lone line ends.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+(?:\n[!-~À-ÖØ-öø-ÿ]+)*").fullmatch
_WORD = re.compile(f"([{_LETTERS}]+)([.,;:!?]?)").fullmatch
_CUT = re.compile(f"(?<=[{_VISIBLE}]) (?=[{_VISIBLE}])").split
#: Texts in which some space is no such cut (RE2).
_ODD = f"[^{_VISIBLE} \\n]|  | \\n|\\n |\\n\\n|^[ \\n]|[ \\n]$"
# The split patterns of the two vocabularies, on the characters above.
_BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\n").findall
_WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+").findall


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class ChunkEncoder:
    """``encode(texts)`` gives all ids of an Arrow string array and each text's bounds.

    ``limit`` bounds the cached chunks of a generation; two generations are kept,
    so a worker's memory does not grow with the corpus.
    """

    def __init__(self, name: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.spaced = "Split" not in str(self.tokenizer.pre_tokenizer)[:200]
        self.lead = " " if self.spaced else ""
        self.pieces = _BYTE_PIECES if self.spaced else _WORD_PIECES
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = _byte_letters()
        self.limit = limit
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    @property
    def bits(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or piece[0] < "!":
            piece = piece.encode().decode("latin1").translate(self.alphabet)
        ids = [t.id for t in self.merge(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str, lead: str) -> bytes:
        if not chunk:
            return b""
        if word := _WORD(chunk):
            word, mark = word[1], word[2]
            if mark and mark not in self.marks:
                self.marks[mark] = self._piece(mark)
            known = self.chunks.get(word) if lead or not self.spaced else None
            if known is None:
                known = self._piece(lead + word if self.spaced else word.lower())
            return known + self.marks[mark]
        if len(chunk) <= 200 and _PLAIN(chunk):
            return b"".join([self._piece(p) for p in self.pieces(lead + chunk if self.spaced else chunk.lower())])
        ids = self.tokenizer.encode(lead + chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        if len(self.chunks) >= self.limit:
            self.older, self.chunks = self.chunks, {}
        known, older, lead, out = self.chunks, self.older, self.lead, []
        for c in chunks:
            got = known.get(c)
            if got is None:
                got = older.get(c)
                if got is None:
                    got = self._chunk(c, lead)
                if len(c) <= 60:
                    known[c] = got
            out.append(got)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts, one after the other, and the n + 1
        bounds of the texts among them; null encodes as empty."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = split.to_pylist()
            for i in np.flatnonzero(odd):
                parts[i] = _CUT(texts[i].as_py())
            split = pa.array(parts, pa.list_(pa.string()))
        at = split.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = self._look_up(coded.dictionary.to_pylist())
        if self.spaced:  # a text's first chunk has no space before it
            heads = pc.list_element(split, 0).to_pylist() if len(split) else []
            index[at[:-1]] = len(found) + np.arange(len(heads))
            found += [self._chunk(h, "") for h in heads]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[index]
        ends = np.cumsum(n)
        take = np.repeat(starts[index] - (ends - n), n)
        take += np.arange(len(take))
        bounds = np.concatenate([[0], ends])[at]
        return pool[take], bounds


_encoders: dict[str, ChunkEncoder] = {}


def encoder(name: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file (a public one's name, or a path)."""
    if name not in _encoders:
        _encoders[name] = ChunkEncoder(name)
    return _encoders[name]
