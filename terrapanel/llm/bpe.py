"""Operator 7: byte-level BPE with a sentencepiece model that is serialised from a rank file.

Every byte is written as one printable character (a fixed public map); each vocabulary entry becomes a piece with the
score minus its rank, so that the best-scored merge of sentencepiece is the lowest-ranked merge of the rank file. The
normalizer is the identity. Each match of the split pattern is encoded on its own; decoding inverts the byte map.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from terrapanel.llm.common import map_texts

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
CACHED = 300_000  # pre-tokens a worker keeps; beyond that it starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def byte_characters() -> list[str]:
    """A printable character per byte: Latin-1's own where it has one, else the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(0x100 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, a number or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is the unknown piece, piece r + 1 the token of rank r."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    chars = byte_characters()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2)  # model type BPE
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the rank files' own splitter takes white space as Unicode defines it
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        chars = byte_characters()
        self.map = {b: c for b, c in enumerate(chars)}
        back = {ord(c): b for b, c in enumerate(chars)}
        self.tokens = [bytes(back[ord(c)] for c in self.sp.id_to_piece(i)) for i in range(1, self.sp.get_piece_size())]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts, known = self.find(text), self.known
        new = [t for t in {*parts} if t not in known]
        if new:
            if len(known) + len(new) > CACHED:
                known = self.known = {}
                new = [*{*parts}]
            ids = self.sp.encode([t.encode().decode("latin-1").translate(self.map) for t in new], num_threads=1)
            known.update((t, (np.asarray(x, "<u4") - np.uint32(1)).astype("<u4").tobytes()) for t, x in zip(new, ids, strict=True))
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    """The worker's codec for a model, made once."""
    key = hashlib.sha256(model).digest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded bytes per document; ``with_ids`` adds the ids and the decoded text.

    A null text counts as empty (no tokens, digests of nothing); a null id stays null; repeated rows are encoded each on
    its own; other columns are ignored. The vocabulary is read on the driver and is the only thing sent to the tasks.
    """
    model = serialise_model(read_ranks(ranks_path))
    made = docs.sparkSession.sparkContext.broadcast(model)  # about 1 MB: the vocabulary's size, not the data's

    def encode(ids: list, texts: list) -> dict:
        own = codec(made.value, pattern)
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for t in texts:
            coded = own.encode(t or "")
            plain = own.decode(coded)
            out["n_tokens"].append(len(coded) // 4)
            out["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
            if with_ids:
                out["ids"].append(np.frombuffer(coded, "<u4").astype("int32"))
                out["decoded"].append(plain.decode())
        return out | {"doc_id": ids}

    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return map_texts(docs.select("doc_id", "text"), schema, encode, chars=500_000)
