"""Byte-level BPE through a sentencepiece model that is written from a rank file.

The model file is serialised here, field by field: each entry of the vocabulary is a piece in
which a byte b is the character 256 + b, its score is the negative rank, and the normaliser
changes nothing.  Sentencepiece then merges the best-scored adjacent pair, leftmost first, which
is the order of the ranks.  A pre-token that is itself an entry has that entry's id, as in the
reference library of rank files.  Decoding maps ids to the bytes of their entries.

Defined results: a null or empty text has no ids; texts of any length are encoded whole; equal
texts give equal results, each row its own; of equally ranked pairs the leftmost is merged; a null doc_id
stays null; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import struct
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import map_batches

COLUMNS = [("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
#: Pre-tokens whose ids a task remembers.
PRETOKENS = 300_000

_VARINT, _BYTES, _FIXED32 = 0, 2, 5
_UNKNOWN, _BPE = 2, 2


def load_ranks(path: str) -> list[bytes]:
    """Entries of a rank file, in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = sorted((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, file))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [entry for _, entry in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, value) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == _BYTES:
        return head + _varint(len(value)) + value
    return head + (struct.pack("<f", value) if kind == _FIXED32 else _varint(value))


def mapped(data: bytes) -> str:
    return "".join(chr(256 + b) for b in data)


def serialised(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece model file; the piece behind the vocabulary stands for what is unknown and never occurs."""
    pieces = [_field(1, _BYTES, mapped(entry).encode()) + _field(2, _FIXED32, -float(rank)) for rank, entry in enumerate(vocabulary)]
    pieces.append(_field(1, _BYTES, b"<unk>") + _field(2, _FIXED32, 0.0) + _field(3, _VARINT, _UNKNOWN))
    trainer = _field(3, _VARINT, _BPE) + _field(4, _VARINT, len(pieces)) + _field(40, _VARINT, len(vocabulary)) + b"".join(_field(n, _VARINT, -1) for n in (41, 42, 43))
    normaliser = _field(1, _BYTES, b"identity") + b"".join(_field(n, _VARINT, 0) for n in (3, 4, 5))
    return b"".join(_field(1, _BYTES, p) for p in pieces) + _field(2, _BYTES, trainer) + _field(3, _BYTES, normaliser)


class Codec:
    def __init__(self, vocabulary: list[bytes], pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.vocabulary = vocabulary
        self.rank = {entry: i for i, entry in enumerate(vocabulary)}
        self.split = regex.compile(pattern).findall
        self.pieces = SentencePieceProcessor(model_proto=serialised(vocabulary))
        self.listed: dict[str, str] = {}  # decimal ids of pre-tokens, and the bytes that these decode to
        self.decoded: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(vocabulary))]
        self.table = [chr(256 + b) for b in range(256)]

    def learn(self, tokens: set[str]) -> None:
        """Encode and decode pre-tokens that are not known yet."""
        if len(self.listed) > PRETOKENS:
            self.listed.clear()
            self.decoded.clear()
        whole, parted = [], []
        for t in tokens.difference(self.listed):
            data = t.encode()
            if (rank := self.rank.get(data)) is not None:
                whole.append((t, [rank]))
            else:
                parted.append((t, "".join(map(self.table.__getitem__, data))))
        found = zip((t for t, _ in parted), self.pieces.encode([m for _, m in parted], out_type=int, num_threads=1)) if parted else ()
        for t, ids in (*whole, *found):
            self.listed[t] = ",".join(map(self.decimal.__getitem__, ids))
            self.decoded[t] = b"".join(map(self.vocabulary.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text its ids, as decimals joined by commas, and what they decode to."""
        tokens = list(map(self.split, texts))
        self.learn(set().union(*tokens))
        return [(",".join(map(self.listed.__getitem__, ts)), b"".join(map(self.decoded.__getitem__, ts))) for ts in tokens]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): the number of ids, digests of the ids and of the decoded bytes; keep_ids adds the ids."""

    def make():
        codec = Codec(load_ranks(ranks_path), pattern)

        def work(keys, texts):
            for key, (listed, decoded) in zip(keys, codec.encode([t.decode() for t in texts])):
                out = (key, listed.count(",") + bool(listed), sha256(listed.encode()).hexdigest(), sha256(decoded).hexdigest())
                yield (*out, [int(i) for i in listed.split(",") if i]) if keep_ids else out

        return work

    return map_batches(docs, make, COLUMNS + [("ids", "array<long>")] * keep_ids, size=64)
