"""Media columns: payloads stored by content in tar shards, described by rows of digest, shard, offset and length.

A text's UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, become the samples of an 8-bit greyscale
PNG, 64 samples a line. Every task packs the images of its rows into tar shards of bounded size under the shared
folder; a shard holds equal images once, under the image's SHA-256, and is itself named by what it holds, so a task
that runs again writes the same file. Rows name images by digest; an index has one place (shard, offset, length) for
each digest, whichever task stored it, so that equal texts are read, checked and described once. Width and height come
from range reads of an image's first 33 bytes alone; samples are only read where features need them.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, scratch_path, texts, written

#: PNG's fixed values: signature, and the bytes that signature and header chunk take.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
WIDTH = 64


def padded(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 4) -> bytes:
    """payload (a multiple of 64 bytes) as a greyscale PNG, one unfiltered line for each 64 samples."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode(image: bytes) -> bytes:
    """The samples of an image that `encode` made."""
    width, height, _ = read_header(image)
    at, packed = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not expected here")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, entropy in bits and the shares of 8 equal bands of sample values."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    bands = ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(1) / len(samples))
    return f"mean={(counts * np.arange(256)).sum() / len(samples):.4f};entropy={abs((share * np.log2(share)).sum()):.4f};bands={bands}"


class _Shard:
    """A tar file that grows under a name of its own and moves to its content's name when it is complete."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"{self.folder}/.part-{uuid.uuid4().hex}"
        self.out, self.size, self.at, self.rows = self.fs.open_output_stream(self.name, compression=None), 0, {}, []

    def add(self, doc_id, n_bytes: int, image: bytes) -> None:
        digest = hashlib.sha256(image).hexdigest()
        if digest not in self.at:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + bytes(-len(image) % 512))
            self.at[digest] = self.size + len(head)
            self.size += len(head) + len(image) + -len(image) % 512
        self.rows.append((doc_id, n_bytes, digest, self.at[digest], len(image)))

    def close(self, scheme: str) -> pa.RecordBatch:
        self.out.write(bytes(1024))
        self.out.close()
        final = f"{self.folder}/{hashlib.sha256(''.join(self.at).encode()).hexdigest()[:32]}.tar"
        if self._stored(final):  # by an earlier attempt of the task; some stores refuse to rename onto a file
            self.fs.delete_file(self.name)
        else:
            try:
                self.fs.move(self.name, final)
            except OSError:
                if not self._stored(final):
                    raise
                self.fs.delete_file(self.name)
        ids, sizes, digests, offsets, lengths = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array([scheme + final] * len(ids), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
            ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
        )

    def _stored(self, path: str) -> bool:
        return self.fs.get_file_info(path).type == fs.FileType.File


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20, shard_rows: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) of every row, its image stored in a tar shard under `folder`.

    Null text is stored as an empty one: 64 bytes 0. Equal texts give equal images and digests; a shard stores them
    once. A shard closes when it passes `shard_bytes` or has `shard_rows` rows. The index is written to the shared
    folder, so images are stored once whatever reads it. Rows that share an id or have none are rows of their own;
    columns other than id and text are not read; an empty table gives an empty index.
    """
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), rows_of(b, "text"), strict=True):
                shard = shard or _Shard(folder)
                shard.add(doc_id, len(text), encode(padded(text)))
                if shard.size >= shard_bytes or len(shard.rows) >= shard_rows:
                    yield shard.close(scheme)
                    shard = None
        if shard:
            yield shard.close(scheme)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-index")


def objects(index: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """(digest, shard, offset, length): one place for each stored image, the first of those it lies at.

    They are dealt out so that a task reads neighbouring images, in order, about `chunk_bytes` of them.
    """
    places = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, total // chunk_bytes)
    return places.repartition(parts, "shard", F.floor(F.col("offset") / F.lit(chunk_bytes // 8))).sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the bytes its rows point at, or their first `most`."""
    path, source = None, None
    for b in batches:
        found = []
        for shard, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if shard != path:
                if source:
                    source.close()
                store_fs, inner = fs.FileSystem.from_uri(shard)
                path, source = shard, store_fs.open_input_file(inner)
            found.append(source.read_at(min(length, most or length), offset))
        yield b, found
    if source:
        source.close()


def headers(objects: DataFrame) -> DataFrame:
    """objects with width, height and bits, from the first 33 bytes of each image alone; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, heads in _ranges(batches, HEADER_BYTES):
            found = [read_header(h) for h in heads]
            more = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "width", "height", "bits"])

    fields = ", ".join(f"{c} {t}" for c, t in objects.dtypes)
    return objects.mapInArrow(run, f"{fields}, width int, height int, bits int")


def read_back(objects: DataFrame) -> DataFrame:
    """objects with payload_sha256, tail_crc32 and feature of the samples, read from the stored images.

    An image whose digest is not the row's, or whose samples are not as many as its header says, raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, images in _ranges(batches, None):
            found, column = [], {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for image, digest, width, height in zip(images, column["digest"], column["width"], column["height"], strict=True):
                payload = decode(image)
                if hashlib.sha256(image).hexdigest() != digest or len(payload) != width * height:
                    raise ValueError(f"stored image {digest} reads otherwise")
                found.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature(payload)))
            more = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "payload_sha256", "tail_crc32", "feature"])

    fields = ", ".join(f"{c} {t}" for c, t in objects.dtypes)
    return objects.mapInArrow(run, f"{fields}, payload_sha256 string, tail_crc32 long, feature string")


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with its image's place, header and features: store, headers, read_back and a join on the digest."""
    index = store(docs, folder, id_col, text_col)
    found = read_back(headers(objects(index)))
    return index.select("doc_id", "n_bytes", "digest").join(found, "digest")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, from images stored in the shared folder and read back, and shard, offset, width and height.

    payload_bytes is the header's width times its height; media_bytes the stored length.
    """
    rows = media_columns(texts(docs, "doc_id", "text"), scratch_path(docs.sparkSession, "media"))
    size = (F.col("width").cast("long") * F.col("height")).alias("payload_bytes")
    return rows.select("doc_id", "n_bytes", size, "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("digest").alias("media_sha256"), "feature", "shard", "offset", "width", "height")
