"""Token ids in binary files: fixed-size blocks, transposed into bit or byte planes, zstandard per plane.

Documents are ranged and sorted by doc_id; each range becomes one file below the shared folder. A file holds
blocks of ``BLOCK`` ids. A block is cut into planes (plane k holds bit or byte k of every id), each plane is
compressed on its own, and the chunk index at the end of the file says where each block's planes lie. Next to
it lies the document index: doc_ids and their token counts. A file counts only if the manifest names it, so an
attempt that was lost leaves nothing that is read.

File: ``MAGIC``, planes of block 0, planes of block 1, ..., document index, chunk index (zstandard over JSON),
its length as 8 bytes little-endian, ``MAGIC``.

Defined results: null text is empty and encodes to the end id alone; a null doc_id comes first; rows that repeat
a doc_id follow each other in the order of a hash of their texts; an empty table writes no file and returns no
rows; other columns are ignored.
"""

import io
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaymark.llm import common
from quaymark.session import work_path

MAGIC = b"QMTOKENS"
BLOCK = 65536
END_ID = 0
LEVEL = 3
#: Chunks of text whose ids a Python worker remembers, and characters looked up at once; both bound its memory.
REMEMBERED = 800_000
SLICE_CHARS = 2_000_000

#: Before a single space and something that is no white space, the tokenizer always starts a new word.
_BOUNDARY = re.compile(r"(?= \S)")
_WIDE = re.compile(r" (?!\S)")


class _Codes(dict):
    """Numbers words in the order in which they are first met."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        return code


class ChunkEncoder:
    """Encodes texts word by word: equal words get equal ids, so each new word is encoded once and remembered.

    Words begin at a space before a visible character, where byte-level BPE never merges across. A text that
    holds the string of a special token is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        self.code = _Codes()
        self.flat = np.zeros(0, np.int32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids of words not met before; words with a leading space are encoded many at once and cut apart by bytes."""
        fresh, self.code.fresh = self.code.fresh, []
        alone = [k for k, w in enumerate(fresh) if w[0] != " " or w[1:2].isspace() or w == " "]
        joined = np.ones(len(fresh), bool)
        joined[alone] = False
        words = [w for w, j in zip(fresh, joined.tolist()) if j]
        groups = ["".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        many = [np.array(g.ids, np.int32) for g in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(many) if many else np.zeros(0, np.int32)
        upto = np.cumsum(self.width[ids])
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode("utf-8", "replace")) for w in words], dtype=np.int64)
        cuts = np.searchsorted(upto, ends) + 1
        if not np.array_equal(upto[cuts - 1], ends):
            raise ValueError("a token crosses a word boundary")
        single = self.tokenizer.encode_batch_fast([fresh[k] for k in alone], add_special_tokens=False)
        single = [np.array(g.ids, np.int32) for g in single]
        size = np.zeros(len(fresh), np.int64)
        size[joined] = np.diff(cuts, prepend=0)
        size[alone] = [len(x) for x in single]
        begin = np.zeros(len(fresh), np.int64)
        begin[joined] = np.cumsum(size[joined]) - size[joined] + len(self.flat)
        begin[alone] = np.cumsum(size[alone]) - size[alone] + len(self.flat) + len(ids)
        self.flat = np.concatenate([self.flat, ids, *single])
        self.begin, self.size = np.append(self.begin, begin), np.append(self.size, size)

    def _words(self, text: str) -> list[str]:
        if _WIDE.search(text):
            return [w for w in _BOUNDARY.split(text) if w]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= SLICE_CHARS):
                chars += len(texts[upto])
                upto += 1
            out += self._encode_slice(texts[at:upto])
            at = upto
        return out

    def _encode_slice(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > REMEMBERED:
            self._forget()
        whole = [any(s in t for s in self.special) for t in texts]
        split = [[] if w else self._words(t) for t, w in zip(texts, whole)]
        words = [w for part in split for w in part]
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.fresh:
            self._learn()
        count = self.size[codes]
        ends = np.cumsum(count)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[codes] - (ends - count), count)]
        cut = np.concatenate([[0], ends])[np.cumsum([0] + [len(p) for p in split])]
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) if w else ids[cut[i] : cut[i + 1]]
            for i, (t, w) in enumerate(zip(texts, whole))
        ]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def pack_block(ids: np.ndarray, plane: str = "byte", level: int = LEVEL) -> list[bytes]:
    """The compressed planes of one block, the lowest bits first; planes above the largest id are left out."""
    wide = np.ascontiguousarray(ids, "<u4")
    most = int(wide.max()) if len(wide) else 0
    if plane == "byte":
        planes = wide.view(np.uint8).reshape(-1, 4).T[: max(1, (most.bit_length() + 7) // 8)]
    else:
        bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T
        planes = np.packbits(bits[: max(1, most.bit_length())], axis=1, bitorder="little")
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def unpack_block(planes: list[bytes], n: int, plane: str = "byte") -> np.ndarray:
    unpress = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpress.decompress(p), np.uint8) for p in planes]
    if plane == "byte":
        bytes4 = np.zeros((n, 4), np.uint8)
        for k, row in enumerate(rows):
            bytes4[:, k] = row
        return bytes4.view("<u4").ravel()
    bits = np.zeros((32, n), np.uint8)
    for k, row in enumerate(rows):
        bits[k] = np.unpackbits(row, bitorder="little", count=n)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    def __init__(self, sink, plane: str = "byte", block: int = BLOCK):
        self.sink, self.plane, self.block = sink, plane, block
        self.chunks, self.doc_ids, self.counts = [], [], []
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.at = self._put(MAGIC, 0)

    def _put(self, data: bytes, at: int) -> int:
        self.sink.write(data)
        return at + len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for i in range(0, stop, self.block):
            part = ids[i : min(i + self.block, stop)]
            planes = pack_block(part, self.plane)
            self.chunks.append([self.at, len(part), *map(len, planes)])
            for p in planes:
                self.at = self._put(p, self.at)
        self.waiting, self.n_waiting = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(last=True)
        documents = io.BytesIO()
        np.save(documents, np.array([0 if d is None else d for d in self.doc_ids], np.int64))
        np.save(documents, np.array([d is None for d in self.doc_ids], np.bool_))
        np.save(documents, np.array(self.counts, np.int64))
        packed = zstandard.compress(documents.getvalue(), LEVEL)
        index = {"plane": self.plane, "chunks": self.chunks, "documents": [self.at, len(packed)], "ids": self.n_ids}
        self.at = self._put(packed, self.at)
        tail = zstandard.compress(json.dumps(index).encode(), LEVEL)
        self._put(tail + len(tail).to_bytes(8, "little") + MAGIC, self.at)


class TokenFile:
    """A written file: whole, by block, or any range of its ids."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        end = self._get(size - 16, 16)
        if end[8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete token file")
        length = int.from_bytes(end[:8], "little")
        self.index = json.loads(zstandard.decompress(self._get(size - 16 - length, length)))
        documents = io.BytesIO(zstandard.decompress(self._get(*self.index["documents"])))
        ids, null, self.counts = (np.load(documents) for _ in range(3))
        self.doc_ids = [None if missing else int(d) for d, missing in zip(ids, null)]

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *lengths = self.index["chunks"][k]
        data, planes, upto = self._get(at, sum(lengths)), [], 0
        for length in lengths:
            planes.append(data[upto : upto + length])
            upto += length
        return unpack_block(planes, n, self.index["plane"])

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file; reads only the blocks that hold them."""
        ends = np.cumsum([c[1] for c in self.index["chunks"]] or [0])
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        got = [self.chunk(k) for k in range(first, min(last + 1, len(self.index["chunks"])))]
        base = int(ends[first - 1]) if first else 0
        return np.concatenate(got)[start - base : stop - base] if got else np.zeros(0, np.uint32)

    def close(self) -> None:
        self.source.close()


_MANIFEST = "first long, last long, path string, n_docs long, n_ids long, part int"


def _write_files(folder: str, tokenizer: str, plane: str):
    def write(batches):
        fs, base = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.qmt"
        writer = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = TokenFileWriter(sink, plane)
            for doc_id, tokens in zip(ids, encoder(tokenizer).encode(texts)):
                writer.add(doc_id, np.append(tokens, np.int32(END_ID)))
        if writer is None:
            return
        writer.close()
        sink.close()
        row = [writer.doc_ids[0], writer.doc_ids[-1], f"{folder}/{name}", len(writer.doc_ids), writer.n_ids]
        columns = [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([*columns, part], ["first", "last", "path", "n_docs", "n_ids", "part"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, plane: str = "byte", folder: str | None = None) -> DataFrame:
    """Writes all documents; the manifest has a row for each file, ``start`` counts the ids of files before it."""
    folder = folder or work_path(docs.sparkSession, "tokens")
    order = ["doc_id", "mark"]
    ranged = (
        docs.select("doc_id", common.whole_text().alias("text"))
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    manifest = common.settle(ranged.mapInArrow(_write_files(folder, tokenizer, plane), _MANIFEST))
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each file
    return common.settle(manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")))


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_files(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(path)
            counts = file.counts
            crcs = np.zeros(len(counts), np.int64)
            doc, missing = 0, int(counts[0]) if len(counts) else 0
            for k in range(len(file.index["chunks"])):
                ids, at = file.chunk(k), 0
                while at < len(ids):
                    step = min(missing, len(ids) - at)
                    crcs[doc] = zlib.crc32(ids[at : at + step].tobytes(), int(crcs[doc]))
                    at, missing = at + step, missing - step
                    if not missing and doc + 1 < len(counts):
                        doc += 1
                        missing = int(counts[doc])
            starts = start + np.cumsum(counts) - counts
            columns = [pa.array(file.doc_ids, pa.int64()), *map(pa.array, (starts, counts, crcs))]
            file.close()
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest."""
    files = manifest.select("path", "start")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(_read_files, _READ)
