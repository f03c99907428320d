"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file (one base64 token and its rank a line) whose path is a parameter. It
is loaded once in each Python worker. Each byte stands for one printable character, so that the
library's string vocabulary can hold any byte sequence; every split of a token into two tokens is a
merge, in order of the rank of what it makes, which gives the merges of the rank file.

A text is cut into pieces by the pattern. Pieces of one Arrow batch are encoded once each by the
library and put back in order; a bounded cache keeps frequent pieces between batches.

Results for edge cases: a null or empty text has no ids, no offsets and empty decoded bytes. Very
long texts are encoded whole. Repeated rows give repeated results. A null id list decodes to empty
bytes; an unknown id fails the job rather than vanish.
"""

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.common import keyed_text

# White space as Unicode lists it; the regex module's own class has four control characters more.
UNICODE_SPACE = r"\t-\r \x85\xa0  -     　"
PIECES_KEPT = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one above U+00FF."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, others = [], 0
    for byte in range(256):
        if byte in printable:
            out.append(chr(byte))
        else:
            out.append(chr(256 + others))
            others += 1
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        # One thread a worker: Spark already runs a worker for each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(self.characters)}
        vocab = {self.spell(token): rank for token, rank in ranks.items()}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            splits = [(token[:i], token[i:]) for i in range(1, len(token))]
            splits = [(a, b) for a, b in splits if a in ranks and b in ranks]
            splits.sort(key=lambda s: (ranks[s[0]], ranks[s[1]]))
            merges += [(self.spell(a), self.spell(b)) for a, b in splits]
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        space, no_space = f"[{UNICODE_SPACE}]", f"[^{UNICODE_SPACE}]"
        pattern = pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(r"\s", space).replace(r"\S", no_space)
        self.pattern = regex.compile(pattern)
        # From id to bytes, through the byte table in reverse.
        self.bytes_of = {rank: bytes(self.byte_of[c] for c in text) for text, rank in vocab.items()}
        self.cache = {}

    def spell(self, token: bytes) -> str:
        return "".join(self.characters[b] for b in token)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, pieces) -> None:
        """Encode pieces that the cache lacks; afterwards it has all of ``pieces``.

        The cache keeps ids as bytes of little-endian unsigned 32-bit integers.
        """
        new = list({p for p in pieces if p not in self.cache})
        if len(self.cache) + len(new) > PIECES_KEPT:
            self.cache.clear()
            new = list(set(pieces))
        for piece, got in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self.cache[piece] = np.array(got.ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        cut = self.pieces(text)
        found = list(map(self.cache.get, cut))
        if None in found:
            self.learn(cut)
            found = map(self.cache.__getitem__, cut)
        return np.frombuffer(b"".join(found), "<u4")

    def encode_with_offsets(self, text: str):
        """Ids, and for each id where its first and last character begin and end in the text.

        A character whose bytes are split over several ids is in the span of each of them.
        """
        ids, starts, ends, at = [], [], [], 0
        cut = self.pieces(text)
        for piece, got in zip(cut, self.library.encode_batch(cut, add_special_tokens=False)):
            ids += got.ids
            starts += [at + a for a, _ in got.offsets]
            ends += [at + b for _, b in got.offsets]
            at += len(piece)
        return ids, starts, ends

    def decode(self, ids) -> bytes:
        """The bytes of the ids. They are joined before any decoding to characters, so that a
        character which was split over ids comes back whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def vocabulary(name="byte_bpe_multi_50k.tiktoken"):
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(df: DataFrame, path: str, pattern: str, key="doc_id", text="text", offsets=False) -> DataFrame:
    """``doc_id, ids`` and, if asked for, the character spans ``starts, ends``."""
    schema = f"doc_id {df.schema[key].dataType.simpleString()}, ids array<int>"
    if offsets:
        schema += ", starts array<int>, ends array<int>"

    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            columns = [batch.column(0)]
            texts = batch.column(1).to_pylist()
            if offsets:
                rows = [tool.encode_with_offsets(t) for t in texts]
                columns += [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(3)]
            else:
                rows = [tool.encode(t).astype("<i4") for t in texts]
                columns.append(pa.array(rows, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

    return keyed_text(df, key, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, key="doc_id", ids="ids") -> DataFrame:
    """``doc_id, decoded``: the bytes that a list of ids stands for."""
    schema = f"doc_id {df.schema[key].dataType.simpleString()}, decoded binary"

    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            rows = [tool.decode(row or ()) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "decoded"])

    return df.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key="doc_id", text="text") -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256, whole``.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers, ``whole`` tells
    whether the decoded bytes are the text's.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"]

    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            sizes, id_digests, byte_digests, whole = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = tool.encode(t)
                decoded = tool.decode(ids.tolist())
                sizes.append(len(ids))
                id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                byte_digests.append(hashlib.sha256(decoded).hexdigest())
                whole.append(decoded == t.encode())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), id_digests, byte_digests, whole]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return keyed_text(df, key, text).mapInArrow(run, schema)
