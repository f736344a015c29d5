"""Token ids in binary files of independent zstandard frames with a seek table at the end.

A file is a run of zstandard frames, each of whole documents, then a skippable
frame with the document index, then a skippable frame with the seek table of the
zstandard seekable format: compressed size, size and checksum of every frame. Any
zstandard reader can read the file from front to back; one that knows the tables
fetches the frames of the documents asked for and checks each before use.

    magic, sizes and order of the tables are fixed values, see the constants.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.bpe import Chunks
from matchbook.llm.texts import keyed_documents, map_rows, uncollected
from matchbook.runtime import shared_folder

# Fixed values of the seekable format and of the document index.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


class TokenWriter:
    """Writes documents to an open binary file, a frame at a time.

    A frame closes once it holds ``frame_ids`` ids; a longer document has one of its own.
    """

    def __init__(self, sink, width: int = 4, frame_ids: int = 1 << 16, level: int = 3):
        self._sink, self._kind, self._most = sink, np.dtype(f"<u{width}"), frame_ids
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._frame: list[bytes] = []
        self._held = 0
        self._frames: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, int, int, int, int]] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        known = doc_id is not None
        self._docs.append((doc_id if known else 0, known, len(self._frames), self._held, len(ids)))
        self._frame.append(ids.astype(self._kind).tobytes())
        self._held += len(ids)
        self.n_tokens += len(ids)
        if self._held >= self._most:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self._frame)
        packed = self._zstd.compress(data)
        self._sink.write(packed)
        self._frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._frame, self._held = [], 0

    def close(self) -> int:
        """Write the tables; returns the number of documents."""
        if self._frame:
            self._flush()
        index = self._zstd.compress(np.array(self._docs, INDEX).tobytes())
        head = struct.pack("<BI", self._kind.itemsize, len(self._docs))
        self._sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(head) + len(index)) + head + index)
        table = b"".join(struct.pack("<III", *frame) for frame in self._frames)
        table += FOOTER.pack(len(self._frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        return len(self._docs)


class TokenReader:
    """Reads documents of such a file by their place in it; decompresses only frames asked for."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        n_frames, flag, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - FOOTER.size - 12 * n_frames
        table = np.frombuffer(source.read_at(12 * n_frames, table_at), "<u4").reshape(-1, 3)
        self._frames = table.astype(np.int64)
        self._starts = np.concatenate(([0], np.cumsum(self._frames[:, 0])))
        index_at, index_size = int(self._starts[-1]), table_at - 8 - int(self._starts[-1])
        packed = source.read_at(index_size, index_at)
        magic, _, width, n_docs = struct.unpack("<IIBI", packed[:13])
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index before the seek table")
        self._kind = np.dtype(f"<u{width}")
        self._zstd = zstandard.ZstdDecompressor()
        data = self._zstd.decompress(packed[13:], max_output_size=max(1, n_docs * INDEX.itemsize))
        self.index = np.frombuffer(data, INDEX)
        self._open: tuple[int, np.ndarray] = (-1, np.zeros(0, self._kind))
        self.frames_read = 0

    def __len__(self) -> int:
        return len(self.index)

    def _frame(self, k: int) -> np.ndarray:
        if self._open[0] != k:
            packed_size, size, checksum = map(int, self._frames[k])
            packed = self._source.read_at(packed_size, int(self._starts[k]))
            data = self._zstd.decompress(packed, max_output_size=max(1, size))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} fails its checksum")
            self._open = (k, np.frombuffer(data, self._kind))
            self.frames_read += 1
        return self._open[1]

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        doc_id, known, frame, at, n = self.index[i].tolist()
        return (doc_id if known else None), self._frame(frame)[at : at + n]


@lru_cache(maxsize=2)
def library_chunks(path: str, **options) -> Chunks:
    """Ids of texts by the ``tokenizers`` library, without its special tokens added.

    One for each Python worker, so pieces are known from task to task.
    """
    # Tasks are the parallelism here.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sizes = _byte_sizes(tokenizer)

    def encode_many(texts: list[str]) -> list[bytes] | pa.LargeBinaryArray:
        if sizes is not None and len(texts) > 1 and texts[0][0] == " ":
            return pa.concat_arrays([encode_joined(texts[at : at + 256]) for at in range(0, len(texts), 256)])
        return encode_each(texts)

    def encode_each(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode_joined(texts: list[str]) -> pa.LargeBinaryArray:
        """Pieces with a space before and none inside, as one text: its ids are cut where pieces end."""
        text = "".join(texts)
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        ends = np.append(np.flatnonzero(data == ord(" "))[1:], len(data))
        covered = np.cumsum(sizes[ids])
        cuts = np.searchsorted(covered, ends)
        if len(ends) != len(texts) or covered[-1] != len(data) or not np.array_equal(covered[cuts], ends):
            return pa.array(encode_each(texts), pa.large_binary())
        bounds = np.append(0, 4 * (cuts + 1))
        buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), buffers)

    return Chunks(lambda text: encode_many([text])[0], encode_many, **options)


def _byte_sizes(tokenizer) -> np.ndarray | None:
    """Bytes of the text that each id stands for; none unless the vocabulary is one of plain bytes."""
    cut = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or type(cut).__name__ != "ByteLevel" or cut.add_prefix_space:
        return None
    sizes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True) + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(token)  # a character for every byte
    for i, token in tokenizer.get_added_tokens_decoder().items():
        if token.lstrip or token.rstrip:
            return None
        sizes[i] = len(token.content.encode("utf-8"))
    return sizes


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int | None = 2,
    frame_ids: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[dict]:
    """Encode every text and write one file per range of ids; returns the files in order.

    Files go by ascending id (null first; equal ids by a hash of their text), each
    entry has ``path, n_docs, n_tokens, before`` where ``before`` counts the ids in
    the files before it. Null and empty texts are just ``end_id``. An empty table
    gives no file. A task writes under a name of its own and renames when it is
    done, so a task that is run again leaves one whole file.
    """
    width = 2 if _largest_id(path, end_id) < 1 << 16 else 4
    # A document's key orders equal ids, and lets many rows of one id be split over files.
    ordered = keyed_documents(docs, id_col, text_col).repartitionByRange("doc_id", "text_key")
    ordered = ordered.sortWithinPartitions("doc_id", "text_key")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        batch = next(batches, None)
        if batch is None:
            return
        task = TaskContext.get()
        part = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own = f"{root}/_part-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        chunks = library_chunks(path, most=700_000)
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        with fs.open_output_stream(own) as sink:
            writer = TokenWriter(sink, width, frame_ids)
            while batch is not None:
                ids = chunks.all_ids(batch["text"].to_pylist())
                for doc_id, found in zip(batch["doc_id"].to_pylist(), ids):
                    writer.add(doc_id, np.frombuffer(found + end, "<u4"))
                batch = next(batches, None)
            n_docs = writer.close()
        fs.move(own, f"{root}/part-{part:06d}.tokens")
        yield {
            "part": [part],
            "name": [f"part-{part:06d}.tokens"],
            "n_docs": [n_docs],
            "n_tokens": [writer.n_tokens],
        }

    # One row for each file.
    rows = map_rows(ordered, uncollected(run), "part int, name string, n_docs long, n_tokens long").collect()
    files, before = [], 0
    for row in sorted(rows, key=lambda row: row["part"]):
        files.append(
            {
                "path": f"{folder}/{row['name']}",
                "n_docs": row["n_docs"],
                "n_tokens": row["n_tokens"],
                "before": before,
            }
        )
        before += row["n_tokens"]
    return files


def _largest_id(path: str, end_id: int | None) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)


def read_tokens(spark, files: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it. Tasks read whole files
    frame by frame and hold one frame at a time.
    """
    schema = "path string, n_docs long, n_tokens long, before long"
    listed = spark.createDataFrame([tuple(f.values()) for f in files], schema)
    listed = listed.repartition(max(1, len(files)))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for uri, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                fs, name = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as source:
                    reader = TokenReader(source)
                    ids, crc, sizes = [], [], []
                    for i in range(len(reader)):
                        doc_id, tokens = reader.document(i)
                        ids.append(doc_id)
                        sizes.append(len(tokens))
                        crc.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    starts = before + np.cumsum([0, *sizes])[:-1]
                    yield {"doc_id": ids, "start": starts, "n_tokens": sizes, "ids_crc32": crc}

    return map_rows(listed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    """A new folder for files in the session's shared folder; the caller removes it."""
    folder = shared_folder(spark)
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    return f"{folder}/tokens-{uuid.uuid4().hex}"


def write_and_read(docs: DataFrame, path: str, **options) -> DataFrame:
    """What ``read_tokens`` gives for the files that ``write_tokens`` has just written."""
    spark = docs.sparkSession
    files = write_tokens(docs, token_folder(spark), path, **options)
    return read_tokens(spark, files).select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("ids_crc32").cast("long").alias("ids_crc32"),
    )
