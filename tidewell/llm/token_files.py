"""Token ids as chunk files of compressed planes, with a chunk index.

Documents are dealt into ranges of their key, sorted, encoded, and put into chunks of whole documents. A chunk's ids are
cut into blocks of a fixed size; each block is transposed, so that plane 0 has the lowest byte (or bit) of every id,
plane 1 the next, and each plane is compressed with zstandard by itself. Chunks are written by Spark's own committer, one
row per chunk and file order within each part, so that a lost executor leaves no half-written file. The index has the
place of every chunk in the stream of all ids; a reader opens the chunks it needs and nothing else.

Chunk: magic ``TWP1``, then little-endian uint8 kind (0 bytes, 1 bits), uint8 bytes per id, uint32 ids per block, uint64
ids; per block and plane uint32 the compressed size; then the compressed planes in that order.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import arrow_limits, running_start, scratch_path
from .words import Words, blocks

MAGIC, HEAD = b"TWP1", struct.Struct("<4sBBIQ")
BLOCK_IDS, CHUNK_IDS, RANGE_BYTES, LEVEL = 1 << 15, 1 << 18, 24 << 20, 3
CHUNK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType())])


def pack(ids: np.ndarray, width: int, bits: bool = False, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """ids (unsigned, below 256**width) in the chunk format."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    planes = []
    for i in range(0, ids.size, block):
        raw = ids[i : i + block].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
        table = np.unpackbits(raw, axis=1, bitorder="little").T if bits else raw.T
        planes += [press.compress((np.packbits(p, bitorder="little") if bits else np.ascontiguousarray(p)).tobytes()) for p in table]
    return HEAD.pack(MAGIC, bits, width, block, ids.size) + struct.pack(f"<{len(planes)}I", *map(len, planes)) + b"".join(planes)


def unpack(blob: bytes) -> np.ndarray:
    """The ids of a chunk, uint32."""
    import zstandard

    magic, bits, width, block, n = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a chunk of token planes")
    per_block = width * (8 if bits else 1)
    n_blocks = -(-n // block)
    sizes = struct.unpack_from(f"<{n_blocks * per_block}I", blob, HEAD.size)
    out, at, k, press = np.zeros((n, 4), np.uint8), HEAD.size + 4 * len(sizes), 0, zstandard.ZstdDecompressor()
    for i in range(0, n, block):
        m = min(block, n - i)
        rows = []
        for _ in range(per_block):
            plane = np.frombuffer(press.decompress(blob[at : at + sizes[k]], max_output_size=max(1, m)), np.uint8)
            rows.append(np.unpackbits(plane, count=m, bitorder="little") if bits else plane)
            at, k = at + sizes[k], k + 1
        out[i : i + m, :width] = np.packbits(np.stack(rows).T, axis=1, bitorder="little") if bits else np.stack(rows).T
    return out.view("<u4").ravel()


_TAIL, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIMPLE = np.zeros(256, bool)
_SIMPLE[97:123] = True


class WordEncoder:
    """Ids of texts under a vocabulary that lower-cases, drops white space and never joins across it.

    Such a vocabulary gives a text the ids of its words one after another, so every distinct word goes through the
    tokenizers library once for each worker, and the ids are laid out with numpy. The file is looked at first: if
    its normaliser or splitter is of another kind, whole texts are encoded by the library instead.
    """

    MOST_WORDS = 1 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        steps = own.get("pre_tokenizer") or {}
        self.by_word = (
            [x["type"] for x in (own.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [(x["type"], x.get("behavior"), x.get("invert")) for x in steps.get("pretokenizers", [])] == [("Split", "Removed", True), ("ByteLevel", None, None)]
            and not any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in own.get("added_tokens", []))
        )
        self.added = [x["content"].encode() for x in own.get("added_tokens", [])]
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _learn(self, h: int, ids: list[int]) -> None:
        k = self.known[h] = len(self.known)
        if k >= self.first.size:
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)

    def encode(self, block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and n + 1 bounds."""
        w = Words(block)
        if not self.by_word or any(x in w.data.tobytes() for x in self.added):
            got = [x.ids for x in self.library.encode_batch_fast(block.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        # A single mark after an ASCII letter or digit is a piece of its own: nothing composes or matches across it.
        cut = (w.end - w.start > 1) & _TAIL[w.data[w.end - 1]]
        cut[cut] = _PLAIN[w.data[w.end[cut] - 2]]
        pieces = np.cumsum(1 + cut)
        starts, ends = np.repeat(w.start, 1 + cut), np.repeat(w.end, 1 + cut)
        last = pieces[cut] - 1
        starts[last], ends[last - 1] = w.end[cut] - 1, w.end[cut] - 1
        of = np.concatenate([[0], pieces])[w.of]
        w.start, w.end = starts, ends
        unique, back = np.unique(w.hashes(lower=True), return_inverse=True)
        if len(self.known) + unique.size > self.MOST_WORDS:
            self._reset()
        keys = unique.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            place = np.zeros(unique.size, np.int64)
            place[back] = np.arange(back.size)
            rest = []
            for i in new:
                raw = w.word(place[i]).lower()
                if _SIMPLE[np.frombuffer(raw, np.uint8)].all():
                    self._learn(keys[i], [t.id for t in self.library.model.tokenize(raw.decode())])
                else:
                    rest.append((keys[i], w.word(place[i]).decode()))
            for (h, _), got in zip(rest, self.library.encode_batch_fast([x for _, x in rest], add_special_tokens=False)):
                self._learn(h, got.ids)
        at = np.array([self.known[h] for h in keys], np.int64)[back]
        sizes = self.count[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(bounds[-1]) + np.repeat(self.first[at] - bounds[:-1], sizes)]
        return ids, bounds[of]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _chunks(path: str, end_id: int | None, bits: bool, chunk_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder, part, chunk = word_encoder(path), TaskContext.get().partitionId(), 0
        width = max(1, -(-max(encoder.vocabulary - 1, end_id or 0).bit_length() // 8))
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        sizes: list[int] = []
        total = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.uint32), *held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([ids.size], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids, width, bits)], pa.binary())], names=CHUNK.names)

        for batch in batches:
            for first, block in blocks(batch.column(1)):
                ids, bounds = encoder.encode(block)
                for k, key in enumerate(batch.column(0).slice(first, len(block)).to_pylist()):
                    held.append(ids[bounds[k] : bounds[k + 1]])
                    if end_id is not None:
                        held.append(np.array([end_id], np.uint32))
                    keys.append(key)
                    sizes.append(int(bounds[k + 1] - bounds[k]) + (end_id is not None))
                    total += sizes[-1]
                    if total >= chunk_ids:
                        yield out()
                        held, keys, sizes, chunk, total = [], [], [], chunk + 1, 0
        if keys:
            yield out()

    return write


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int | None = None, bits: bool = False, text: str = "text", key: str = "doc_id", range_bytes: int = RANGE_BYTES, chunk_ids: int = CHUNK_IDS) -> None:
    """Writes out/ids (the chunks) and out/index (part, chunk, start, n_ids, n_docs, n_bytes) for docs in ascending key order.

    Null text: no ids but the end id. Null keys come first; rows with equal keys follow each other in the order of the
    hashes of their texts. Empty input: both tables without rows. Further columns aren't read.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # Rows of one key, or of none, are dealt over ranges as well: by the hash of their texts, equal texts by their row.
    dealt = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-size // range_bytes)), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    dealt.mapInArrow(_chunks(path, end_id, bits, chunk_ids), CHUNK).write.mode("overwrite").parquet(f"{out}/ids")
    chunks = docs.sparkSession.read.schema(CHUNK).parquet(f"{out}/ids").select("part", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"), F.length("blob").alias("n_bytes"))
    running_start(chunks, "n_ids", "start", "part", ["chunk"]).select("part", "chunk", "start", "n_ids", "n_docs", "n_bytes").write.mode("overwrite").parquet(f"{out}/index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, chunk: one row per document, from the planes and the index alone.

    start: ids of all documents before; ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, keys, sizes, blob in zip(*(batch.column(i) for i in range(5))):
                ids, lengths = unpack(blob.as_py()), np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([chunk.as_py()] * n, pa.int32()), keys.values, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["part", "chunk", "doc_id", "place", "n_tokens", "ids_crc32"])

    chunks = spark.read.schema(CHUNK).parquet(f"{path}/ids").select("part", "chunk", "doc_ids", "lengths", "blob")
    got = chunks.mapInArrow(read, "part int, chunk int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", "start")
    return got.join(index, ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "chunk")


def token_files(docs: DataFrame, path: str, end_id: int | None = None, out: str | None = None, **how) -> DataFrame:
    """Writes docs' token files below out (the shared scratch folder unless given) and returns what is read back."""
    out = out or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, out, end_id, **how)
    return read_token_files(docs.sparkSession, out)
