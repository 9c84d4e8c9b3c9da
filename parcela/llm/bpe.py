"""Byte-level BPE on a public vocabulary file, the same ids as the ``tokenizers`` library gives.

The merges run in ``tiktoken``, several times as fast as an ``Encoding`` with offsets. That is valid
where the file's merge ranks and ids agree and nothing normalizes the text, which ``load`` proves
from the file before it answers; any other file is left to its own library.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import regex
import tiktoken

DEFAULT = "byte_bpe_50k.json"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        added = spec.get("added_tokens") or []
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens with context rules")
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in added}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(set(order)):
            raise ValueError(f"{path}: merge ranks and ids disagree")
        self.ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items()}
        self.pattern = public_tokenizers.PATTERN
        self.core = tiktoken.Encoding("bytes", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.special)._core_bpe
        self._all = set(self.special)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text; special strings inside it become their own ids, as by default in the library."""
        try:
            return bytes(self.core.encode_to_tiktoken_buffer(text, self._all))
        except ValueError:  # a run of white space too long for the library's regex stack
            return self._ids_by_pieces(text)

    def _ids_by_pieces(self, text: str) -> bytes:
        ids: list[int] = []
        cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        for part in cut.split(text) if cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in pre_tokens(self.pattern).findall(part):
                    ids += self.core.encode_single_piece(piece.encode())
        return np.array(ids, dtype="<u4").tobytes()

    def piece_length(self, piece: str) -> int:
        """The number of tokens of one pre-token."""
        return len(self.core.encode_single_piece(piece.encode()))


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)


@lru_cache(maxsize=4)
def pre_tokens(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)
