"""Byte-level BPE with the tiktoken library and a local rank file.

Very long texts are cut at safe boundaries first, so that the pattern engine never scans more than a bounded
stretch at once; decoding goes straight to bytes.

Defined results: a null text is an empty one (no tokens); the text of a special token is ordinary text; repeated
rows give repeated results; other columns of the input are not carried and may have any name; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import common

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Code points after which a text is cut at the next safe boundary.
PIECE = 1 << 15
SAFE = re.compile(r"[A-Za-z](?=[\x00-@\[-`{-\x7f])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Cuts of ``text``, each right after an ASCII letter whose successor is an ASCII character and no letter.

    Every match of the pattern that holds a letter consists, from its first letter on, of letters only, and no
    look-ahead ever sees past such a place; so the matches on either side are those of the whole text. What a letter
    is, no two versions of Unicode disagree about in ASCII. Where a stretch has no such place, it stays in one piece.
    """
    start, n = 0, len(text)
    while n - start > size:
        m = SAFE.search(text, start + size - 1)
        end = m.end() if m else n
        yield text[start:end]
        start = end
    if start < n or not n:
        yield text[start:]


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += coder.encode_ordinary(piece)
    return ids


def decode(coder: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The bytes of the ids; they need not be whole characters."""
    return coder.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text."""

    def make():
        coder = encoding(path, pattern)
        return lambda doc_id, text: (doc_id, encode(coder, text or ""))

    return common.map_rows(docs.select(id_col, text_col), make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, bytes) of a table (doc_id, ids)."""

    def make():
        coder = encoding(path, pattern)
        return lambda doc_id, ids: (doc_id, decode(coder, ids or []))

    return common.map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def digest(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode each text in one pass: counts and digests, without shipping the ids."""

    def make():
        coder = encoding(path, pattern)
        digits = [str(i) for i in range(coder.n_vocab)]

        def of(doc_id, text):
            ids = encode(coder, text or "")
            listed = " ".join(map(digits.__getitem__, ids)).encode()
            return doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decode(coder, ids)).hexdigest()

        return of

    return common.map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE))
