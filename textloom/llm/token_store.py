"""Token ids in independent zstandard frames with a trailing seek table.

A file holds documents in ascending order, their ids as little-endian unsigned 32-bit integers:

    frame 0 | frame 1 | ... | seek table | footer

Every frame is a zstandard frame of its own and holds whole documents, FRAME_BYTES of ids or one longer
document. The seek table is a zstandard skippable frame, which plain decoders pass over. It holds, for
each frame, its place, its packed and plain length, the CRC-32 of both, and its first document; and for
each document its doc_id, whether that is null, and its number of ids. The footer gives the table's
length, the CRC-32 of the table, the counts and the format's name. A reader needs the footer, the table
and the frames of the documents that it is asked for, and nothing else of the file.

Files are written by tasks under a name of the attempt's own and renamed when complete, so a task that
is repeated, or runs twice, leaves one whole file.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, map_batches, new_path, table

#: Fixed values of the format.
NAME, SKIPPABLE = b"TLTOKEN1", 0x184D2A5E
FRAME = np.dtype([("place", "<u8"), ("packed", "<u8"), ("plain", "<u8"), ("packed_crc", "<u4"), ("plain_crc", "<u4"), ("first", "<u8")])
DOC = np.dtype([("doc_id", "<i8"), ("n", "<u8"), ("null", "u1")])
FOOTER = struct.Struct("<QIQQ8s")  # length of the table with its head, CRC-32, frames, documents, NAME
FRAME_BYTES, FILE_BYTES = 1 << 18, 1 << 28
BATCH = 20_000
VOCABULARY, END_ID = "word_bpe_49k.json", 1
#: Words whose ids a task remembers; past this many it forgets them all and starts anew.
REMEMBERED = 600_000
PUNCTUATION = ".,;:!?"


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.fs, self.path = store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.own)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.place, self.held = frame_bytes, 0, []
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.first = self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids) // 4, doc_id is None))
        self.held.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        plain = b"".join(self.held)
        packed = self.pack.compress(plain)
        self.frames.append((self.place, len(packed), len(plain), zlib.crc32(packed), zlib.crc32(plain), self.first))
        self.out.write(packed)
        self.place += len(packed)
        self.held, self.size, self.first = [], 0, len(self.docs)

    def close(self) -> None:
        if self.held:
            self.flush()
        body = np.array(self.frames, FRAME).tobytes() + np.array(self.docs, DOC).tobytes()
        head = struct.pack("<II", SKIPPABLE, len(body) + FOOTER.size)
        self.out.write(head + body + FOOTER.pack(len(head) + len(body), zlib.crc32(head + body), len(self.frames), len(self.docs), NAME))
        self.out.close()
        self.fs.move(self.own, self.path)


@dataclass
class Document:
    doc_id: int | None
    n: int
    frame: int
    offset: int  # in ids, within the frame


class Reader:
    """Reads the footer and the seek table; frames only when documents in them are asked for."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length, crc, frames, docs, name = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        body = self.file.read_at(length, size - FOOTER.size - length)
        if name != NAME or zlib.crc32(body) != crc:
            raise ValueError(f"{uri} has no whole seek table")
        self.frames = np.frombuffer(body, FRAME, frames, 8)
        self.docs = np.frombuffer(body, DOC, docs, 8 + frames * FRAME.itemsize)
        self.unpack = zstandard.ZstdDecompressor()
        self.starts = np.r_[0, np.cumsum(self.docs["n"].astype(np.int64))]

    def __len__(self) -> int:
        return len(self.docs)

    def frame_of(self, k: int) -> int:
        return int(np.searchsorted(self.frames["first"], k, "right")) - 1

    def frame(self, k: int) -> bytes:
        f = self.frames[k]
        packed = self.file.read_at(int(f["packed"]), int(f["place"]))
        if zlib.crc32(packed) != f["packed_crc"]:
            raise ValueError(f"frame {k} is damaged")
        plain = self.unpack.decompress(packed, max_output_size=int(f["plain"]))
        if zlib.crc32(plain) != f["plain_crc"]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def read(self, k: int, frame: bytes | None = None) -> bytes:
        """The ids of the k-th document, from its frame if that is at hand."""
        at = self.frame_of(k)
        first = int(self.frames[at]["first"])
        start = int(self.starts[k] - self.starts[first]) * 4
        return (frame if frame is not None else self.frame(at))[start : start + int(self.docs["n"][k]) * 4]

    def find(self, doc_id: int) -> list[int]:
        """Places of a document's id, by binary search; files are in ascending order."""
        ids = self.docs["doc_id"]
        return list(range(int(np.searchsorted(ids, doc_id)), int(np.searchsorted(ids, doc_id, "right"))))

    def id_of(self, k: int) -> int | None:
        return None if self.docs["null"][k] else int(self.docs["doc_id"][k])


def _words(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


#: How byte-level vocabularies write bytes that aren't printable characters: as the characters from 256 on.
BYTES = dict(zip((k for k in range(256) if not (33 <= k <= 126 or 161 <= k <= 172 or 174 <= k)), range(256, 512), strict=False))


def _ends_in_letter(word: str) -> bool:
    """Whether a word's normalised form (NFC, lower case) ends in a letter, after which punctuation begins a token of its own.

    A letter may normalise to a letter and combining marks, which stay with the punctuation after them.
    """
    if word.isascii():
        return word[-1:].isalpha()
    low = unicodedata.normalize("NFC", word).lower()
    return low[-1:].isalpha() and unicodedata.is_normalized("NFC", low) and low[-1].lower() == low[-1]


class Encoder(dict):
    """Encodes texts word by word: the tokenizer drops white space and no token or rule of it spans any,
    so a text's ids are those of its words, and a word is encoded by the library once and remembered.

    Only white space that all of its rules agree on ends a word here; the rest is left to the library.
    Neither normalising nor splitting changes a word of Latin-1 letters besides lower case, so the
    library's model gets it directly; punctuation after what normalises to a letter begins a token of
    its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.model = self.of.model
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if len(core) < len(word) and _ends_in_letter(core):
            ids = self[core] + self[word[len(core) :]]
        elif word.isalpha() and word.isascii() or word.isalpha() and max(word) < "\u0100":
            low = word.lower()
            if low != word:
                ids = self[low]
            else:
                units = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
                ids = np.array([t.id for t in self.model.tokenize(units)], "<u4").tobytes()
        else:
            ids = np.array(self.of.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = b""
        return [b"".join(map(self.__getitem__, _words(t))) for t in texts]


@cache
def encoder(vocabulary: str) -> Encoder:
    """One for a worker process, whichever tasks it runs."""
    return Encoder(vocabulary)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns a row for each file: part, path, docs, ids.

    A null id comes first, a null text is empty (its only id is the end id), and rows of one id are in
    the order of their texts. An empty table gives no file. Texts are dealt by range and encoded by the
    task that writes them, since a range exchange runs what is below it twice.
    """
    spark = docs.sparkSession
    if not files:  # as many tasks as other exchanges have, and no file of much over FILE_BYTES of text
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spread = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = spread.withColumn("_part", F.spark_partition_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, part, ids, encode = None, "", 0, 0, encoder(vocabulary).encode
        for b in batches:
            if writer is None:
                part = b.column("_part")[0].as_py()
                path = f"{folder}/tokens-{part:06d}.tlt"
                writer = Writer(path)
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                plain = encode([text.as_py()])[0] + end
                ids += len(plain) // 4
                writer.add(doc_id, plain)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [path], "docs": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([ids], pa.int64())})

    return ordered.mapInArrow(run, "part long, path string, docs long, ids long")


def read_back(listing: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; `listing` is write()'s result.

    The rows of the listing, as many as files, reach the driver: a file's first start is the sum of those before.
    A task holds one frame, and rows of BATCH documents.
    """
    spark, at, starts = listing.sparkSession, 0, []
    for r in listing.orderBy("part").collect():
        starts.append((r["path"], at))
        at += r["ids"]
    paths = spark.createDataFrame(starts, "path string, first long").repartition(max(1, len(starts)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                r = Reader(path)
                held, frame = -1, b""
                for at in range(0, len(r), BATCH):
                    some, crcs = range(at, min(len(r), at + BATCH)), []
                    for k in some:
                        if (f := r.frame_of(k)) != held:
                            held, frame = f, r.frame(f)
                        crcs.append(zlib.crc32(r.read(k, frame)))
                    own = slice(some.start, some.stop)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r.id_of(k) for k in some], pa.int64()), "start": pa.array(r.starts[own] + first, pa.int64()), "n_tokens": pa.array(r.docs["n"][own].astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())})

    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents' ids to a new folder among the shared ones and reads them back."""
    spark = docs.sparkSession
    listing = write(docs, new_path(spark, "tokens"), vocabulary or vocabulary_path())
    kept = new_path(spark, "tokens-listing")
    listing.write.parquet(kept)
    return read_back(spark.read.schema(listing.schema).parquet(kept))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
