"""Byte-level BPE by a sentencepiece model that is written, not trained.

A rank file (one base64 token and its rank per line) becomes a sentencepiece model
of type BPE: each token is a piece whose characters stand for its bytes, a piece's
score is its negative rank, its id the rank, and normalisation is the identity. Sentencepiece
then merges the pair of the highest score, the leftmost of equal ones, which is the
merge of the lowest rank. A text is cut by the vocabulary's pattern; each match is
one pre-token and is encoded for itself, so no merge crosses a match. Decoding maps
pieces back to characters and those to bytes, which are joined.

The rank file is read by the driver and the model (at most ``MAX_MODEL`` bytes) goes
to the tasks as a broadcast; a worker keeps the ids of the pre-tokens it met in a
memory of ``MEMORY`` entries, which bears on time only.

Null and empty texts have no ids and decode to no bytes. Special tokens are ordinary
text. Texts are encoded whole, whatever their length. Equal rows stay rows, extra
columns stay, whatever they are called but for ``ids`` and ``decoded``, the columns
added here, which are replaced. Empty tables give empty results. A null array of ids
decodes to null, an id that the vocabulary lacks is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb

from promptledger.llm.common import table
from promptledger.session import settle

UNKNOWN = "\u2047"  # a model must have one; it stands for no byte
ZERO = "\u0100"  # stands for byte 0, which a piece cannot hold
MAX_MODEL = 32 * 1024 * 1024
MEMORY = 400_000
LONG = 64  # longer pre-tokens are not remembered
SLICE = 1 << 18  # bytes of texts, or ids, that a task handles at a time


def to_chars(data: bytes) -> str:
    """One character per byte, that of the byte's value."""
    return data.decode("latin-1").replace("\0", ZERO)


def to_bytes(chars: str) -> bytes:
    return chars.replace(ZERO, "\0").encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece of id r is the token of rank r."""
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    if lacking := {bytes([b]) for b in range(256)} - ranks.keys():
        raise ValueError(f"the vocabulary lacks {len(lacking)} bytes")
    model = pb.ModelProto()
    for rank, token in enumerate(by_rank):
        model.pieces.add(piece=to_chars(token), score=-rank, type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(by_rank)
    spec = model.normalizer_spec
    spec.name = "identity"
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    data = model.SerializeToString()
    if len(data) > MAX_MODEL:
        raise ValueError(f"a model of {len(data)} bytes is too large to broadcast")
    return data


class Encoder:
    """A model and the ids of the pre-tokens that were met, as bytes of 32-bit numbers."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        ids = self.pieces.encode([to_chars(t.encode()) for t in tokens], num_threads=1)
        ends = np.cumsum([4 * len(i) for i in ids]).tolist()
        flat = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
        self.known.update(zip(tokens, (flat[a:b] for a, b in zip([0, *ends], ends))))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; what the texts have that is new is encoded in one call."""
        tokens = [self.cut(text or "") for text in texts]
        different = set().union(*tokens)
        fresh = [t for t in different if t not in self.known]
        if len(self.known) + len(fresh) > MEMORY:
            self.known = {t: self.known[t] for t in different if t in self.known}
        self._learn(fresh)
        ids = [b"".join(map(self.known.__getitem__, row)) for row in tokens]
        for t in fresh:
            if len(t) > LONG:
                del self.known[t]
        return ids

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list array of ids, one list per text."""
        out = []
        for part in slices(texts, pc.fill_null(pc.binary_length(texts), 0)):
            rows = self.ids(part.to_pylist())
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def slices(rows: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """The rows, a few at a time: up to ``SLICE`` by size, one row at least."""
    ends, start = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(rows):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield rows.slice(start, stop - start)
        start = stop


def decode_ids(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The joined bytes of each list's tokens; null for a null list."""
    out = []
    for part in slices(ids, pc.fill_null(pc.list_value_length(ids), 0)):
        flat = tokens.take(part.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False), dtype=np.int64)])
        lists = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        offsets = ends[np.concatenate([[0], np.cumsum(lists)])].astype(np.int64)
        # The tokens taken lie in one buffer in order, so joining them is a matter of offsets.
        data = flat.buffers()[2] or pa.py_buffer(b"")
        joined = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), data])
        out.append(pc.if_else(part.is_valid(), joined, pa.scalar(None, pa.large_binary())).cast(pa.binary()))
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


#: Encoders of this worker by their model's place, so that its tasks share what was learnt.
_encoders: dict[tuple[int, str], Encoder] = {}


class ByteBpe:
    """Encoding and decoding of whole columns by one vocabulary."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        self.model: Broadcast = spark.sparkContext.broadcast(model_of(read_ranks(ranks_path)))
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        """The array of the text's token ids."""
        model, pattern = self.model, self.pattern

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            data = model.value
            key = hash(data), pattern
            if key not in _encoders:
                _encoders.clear()
                _encoders[key] = Encoder(data, pattern)
            for batch in batches:
                yield _encoders[key].encode(batch)

        return run(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for."""
        model = self.model

        @F.arrow_udf(T.BinaryType())
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces = sentencepiece.SentencePieceProcessor(model_proto=model.value)
            known = pieces.get_piece_size() - 1  # without the unknown piece
            tokens = pa.array([to_bytes(p) for p in pieces.id_to_piece(list(range(known)))], pa.large_binary())
            for batch in batches:
                yield decode_ids(batch, tokens)

        return run(ids)

    def encoded(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``ids``."""
        return settle(df.withColumn("ids", self.encode(F.col(text))), "ids")

    def decoded(self, df: DataFrame, ids: str = "ids") -> DataFrame:
        """``df`` with ``decoded``."""
        return settle(df.withColumn("decoded", self.decode(F.col(ids))), "decoded")


def op11_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    codec = ByteBpe(spark, ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = codec.decoded(codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
