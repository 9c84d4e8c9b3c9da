"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the driver, with the library
itself; that set is as large as the vocabulary at most. A pre-token in the set counts one, every
other pre-token is merged. A pre-token's tokens do not depend on its neighbours, so the sum is
the library's count for the whole text. One pass, no shuffle.

Pre-tokens are cut by letters, numbers and white space. Libraries have the Unicode tables of their
own release, so a text with a character whose kind is not the same since an old release is merged as a
whole, in the encoder that has the library's tables.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import arrow_map, id_type

#: Merged pre-tokens that a worker remembers; beyond it they are merged anew.
REMEMBERED = 200_000


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, as a text of their own, encode to exactly one id, by the library."""
    from tokenizers import Tokenizer

    letters = bpe.byte_letters()
    library = Tokenizer.from_file(path)
    special = {t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens") or []}
    texts = []
    for piece in library.get_vocab(with_added_tokens=False):
        if piece not in special:
            try:
                texts.append(bytes(letters[c] for c in piece).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    return frozenset(t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def _kind(category: str) -> str:
    return category[0] if category[0] in "LNZ" else "-" if category != "Cn" else "?"


@lru_cache(maxsize=1)
def settled_characters() -> frozenset[str]:
    """Characters that Unicode 3.2 already had and that still are letters, numbers, spaces or neither, as they were then."""
    old = unicodedata.ucd_3_2_0
    kinds = ((c, _kind(old.category(c))) for c in map(chr, range(sys.maxunicode + 1)))
    return frozenset(c for c, k in kinds if k != "?" and k == _kind(unicodedata.category(c)))


class _Counts(dict):
    def __init__(self, whole: frozenset[str], merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge, self.room = merge, len(whole) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(self) < self.room and len(piece) < 64:
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def _counter(path: str, whole: frozenset[str]):
    encoder = bpe.load(path)
    counts = _Counts(whole, encoder.piece_length).__getitem__
    find = bpe.pre_tokens(encoder.pattern).findall
    settled = settled_characters().issuperset
    special = regex.compile("|".join(regex.escape(s) for s in sorted(encoder.special, key=len, reverse=True))) if encoder.special else None

    def count(text: str) -> int:
        if not text.isascii() and not settled(text):
            return len(encoder.ids(text)) // 4
        parts = special.split(text) if special else [text]
        return len(parts) - 1 + sum(sum(map(counts, find(p))) for p in parts)

    return count


def _library_counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def _shortcut_applies(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    try:
        bpe.load(path)
    except ValueError:
        return False
    return True


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    A null or empty text has 0 bytes and 0 tokens. Every row is counted by itself, so null and
    repeated ids are kept; an empty table gives no rows; other columns are ignored. Files that
    are not plain byte-level BPE are counted by their own library.
    """
    path = tokenizer_path or bpe.default_path()
    shortcut = _shortcut_applies(path)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path) if shortcut else frozenset())
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = _counter(path, whole.value) if shortcut else _library_counter(path)
        texts = [t.as_py() or "" for t in batch.column(1)]
        n = [count(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    return arrow_map(docs, [id_col, text_col], body, schema)
