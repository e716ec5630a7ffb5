"""Token ids in files: fixed-size blocks of ids as bit or byte planes, each compressed with zstandard, behind a chunk index.

A shard file holds the documents of one range of ``doc_id``:

    magic | planes of block 0 | planes of block 1 | ... | documents | index | footer

A block has ``block_ids`` 32-bit ids (the last one fewer). As byte planes it is four rows of bytes, as bit planes 32 rows of bits; a plane
of zeros takes no bytes. The documents (doc_id and number of ids) are an Arrow stream. The index has, for each block, its offset, number of
ids and the length of each plane; the footer has the places of both and a CRC-32. A reader opens any block without the others.

Documents are dealt by range of (doc_id, hash of the text, one of ``SALTS`` parts by the row's place in the input), so that shards follow each
other in the order of doc_id and no single id, nor one row that repeats, has to fit one task. Rows of one doc_id are in the order of that
hash; equal rows have equal bytes, so their order does not matter. Shards are written by the tasks themselves, under a temporary name and
then renamed, so a repeated task gives the same file. What reaches the driver is one row for each shard.

Null text is empty text and has only the end id. A null doc_id comes before all others. Empty tables give no rows. Other columns are not
looked at. Files with other components than ``LibraryEncoder`` knows short cuts for are encoded by the library, text by text.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm.columns import named
from quireline.llm.storage import filesystem, new_folder, publish, small_batches

MAGIC, FOOTER = b"QPLANES1", struct.Struct("<QQQIB3x8s")
BLOCK_IDS = 1 << 16
#: Parts into which the rows of one doc_id and text are dealt.
SALTS = 256
#: Pieces that are remembered, the bytes from which a piece is not, and the bytes of texts that are encoded together.
REMEMBERED, LONG, TOGETHER = 320_000, 200, 1 << 20
#: A run of these behind letters, up to the end of a piece, is one token text of its own.
STOPS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def planes_of(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """4 byte planes, lowest byte first, or 32 bit planes, lowest bit first."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return list(rows)
    return [np.packbits((row >> bit) & 1) for row in rows for bit in range(8)]


def ids_of(planes: list[np.ndarray | None], n: int, kind: str) -> np.ndarray:
    rows = np.zeros((4, n), np.uint8)
    for i, plane in enumerate(planes):
        if plane is not None:
            if kind == "byte":
                rows[i] = plane
            else:
                rows[i // 8] |= np.unpackbits(plane, count=n) << (i % 8)
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Writer:
    """One shard file; holds one block of ids and the list of documents."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_bytes = out, kind, 4 * block_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting, self.index, self.docs, self.at, self.n_ids = bytearray(), [], ([], []), 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id, ids: bytes) -> None:
        self.docs[0].append(doc_id)
        self.docs[1].append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.waiting += ids
        while len(self.waiting) >= self.block_bytes:
            self._block(bytes(self.waiting[: self.block_bytes]))
            del self.waiting[: self.block_bytes]

    def _block(self, data: bytes) -> None:
        ids, start = np.frombuffer(data, "<u4"), self.at
        sizes = []
        for plane in planes_of(ids, self.kind):
            packed = self.packer.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(packed))
            self._put(packed)
        self.index.append((start, len(ids), *sizes))

    def close(self) -> None:
        if self.waiting:
            self._block(bytes(self.waiting))
        docs_at = self.at
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.array(self.docs[0]), "n_tokens": pa.array(self.docs[1], pa.int64())})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        self._put(sink.getvalue().to_pybytes())
        index_at, body = self.at, np.array(self.index, "<u8").tobytes()
        self._put(body)
        self._put(FOOTER.pack(docs_at, index_at, len(self.index), zlib.crc32(body), self.kind == "bit", MAGIC))


class Reader:
    """A shard file through its index; ``source`` is seekable."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, os.SEEK_END) if not hasattr(source, "size") else source.size()
        docs_at, index_at, blocks, crc, bits, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        body = self._at(index_at, size - FOOTER.size - index_at)
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a whole shard file")
        self.kind = "bit" if bits else "byte"
        self.index = np.frombuffer(body, "<u8").reshape(blocks, -1)
        table = pa.ipc.open_stream(self._at(docs_at, index_at - docs_at)).read_all()
        self.doc_ids, self.n_tokens = table["doc_id"].to_pylist(), table["n_tokens"].to_numpy()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def block(self, number: int) -> np.ndarray:
        at, n, *sizes = self.index[number].tolist()
        data, place, planes, unpacker = self._at(at, sum(sizes)), 0, [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(np.frombuffer(unpacker.decompress(data[place : place + size]), np.uint8) if size else None)
            place += size
        return ids_of(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[object, int, Iterator[np.ndarray]]]:
        """(doc_id, ids of this shard before it, its ids in pieces), in order; one block is held. What of a document's pieces has not been taken
        when the next one is asked for is passed over."""
        number, held, used, before, need = -1, np.zeros(0, "<u4"), 0, 0, 0

        def pieces() -> Iterator[np.ndarray]:
            nonlocal number, held, used, need
            while need:
                if used == len(held):
                    number, used = number + 1, 0
                    held = self.block(number)
                piece = held[used : used + need]
                used, need = used + len(piece), need - len(piece)
                yield piece

        for doc_id, n in zip(self.doc_ids, self.n_tokens.tolist(), strict=True):
            need, own = n, pieces()
            yield doc_id, before, own
            for _ in own:
                pass
            before += n


class LibraryEncoder:
    """The tokenizers library on what lies between ASCII white space, which this vocabulary's tokens never cross; pieces are remembered.

    A piece that is not known is taken as a word, its ASCII letters in lower case, and the punctuation behind it, which is a pre-token of its own. A
    word of a to z is a pre-token as it stands and goes straight to the library's merges. Other words of letters go to the library many at
    once, with blanks between: each is one pre-token, so its last token is the only one that ends a word. Anything else goes by itself.

    All this holds for files of lower-case words with end-of-word marks (``words``, from the file's components). With any other file, whole
    texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from quireline.llm.bpe_stream import is_lower_case_words

        self.tokenizer, self.known, self.words = Tokenizer.from_file(path), {}, is_lower_case_words(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.packed = [struct.pack("<I", i) for i in range(len(self.ends))]  # a piece of one token has no bytes of its own
        self.merges = self.tokenizer.model.tokenize

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        known, merges, packed, others = self.known, self.merges, self.packed, []
        for w in words:
            if w.isalpha():
                known[w] = b"".join([packed[t.id] for t in merges(w.decode())])
            else:
                others.append(w)
        words, texts = others, [w.decode("utf-8") for w in others]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        for low in range(0, len(plain), 500):
            own = plain[low : low + 500]
            (ids,) = self._library([" ".join([texts[i] for i in own])])
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(own):  # some word's lower case is not letters only
                rest += own
                continue
            data, start = ids.tobytes(), 0
            for i, end in zip(own, cuts.tolist(), strict=True):
                self.known[words[i]] = data[start:end]
                start = end
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            self.known[words[i]] = ids.tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.words:
            return [ids.tobytes() for ids in self._library([t.decode("utf-8") for t in texts])]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [t.split() for t in texts]
        new = set().union(*split).difference(known)
        made, words = [], set()
        for p in new:
            low = p.lower()
            word = low.rstrip(STOPS)
            if word == p and word.isalpha():
                words.add(p)
            elif word.isalpha() or word.decode("utf-8").lower().isalpha():  # lower case may end in a mark, which stops would join
                made.append((p, word, low[len(word) :]))
                words.add(word)
                words.add(low[len(word) :])
            else:
                words.add(p)
        words.discard(b"")
        self._learn([w for w in words if w not in known])
        for p, word, stops in made:
            known[p] = known[word] + known[stops] if stops else known[word]
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for p in new | words:
            if len(p) >= LONG:
                known.pop(p, None)
        return out


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_shards(docs: DataFrame, path: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, kind: str = "byte") -> DataFrame:
    """Writes the shards now. Returns one row for each: shard, path, n_docs, n_ids, start (ids of all shards before it)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "token-planes")
    end = np.array([end_id], "<u4").tobytes()
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    held = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text).cast("binary"), F.lit(b"")).alias("data"), F.xxhash64(named(text)).alias("h"), salt.alias("salt"))
    dealt = held.repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, encoder = TaskContext.get(), None, library_encoder(path)
        files, root = filesystem(folder)
        name, temp = f"{root}/shard-{task.partitionId():06d}.qpl", f"{root}/.shard-{task.partitionId():06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(temp)
                writer = Writer(out, kind)
            docs_of, texts, low = batch.column("doc_id").to_pylist(), batch.column("data").cast(pa.binary()).to_pylist(), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                    size, high = size + len(texts[high]), high + 1
                for doc, ids in zip(docs_of[low:high], encoder.encode(texts[low:high]), strict=True):
                    writer.add(doc, ids + end)
                low = high
        if writer is not None:
            writer.close()
            out.close()
            publish(files, temp, name)
            row = {"shard": [task.partitionId()], "path": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.docs[0])], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    shards = sorted(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").collect())
    before, rows = 0, []
    for s in shards:
        rows.append((s.shard, s.path, s.n_docs, s.n_ids, before))
        before += s.n_ids
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, start long")


def read_documents(shards: DataFrame, doc_id_type: str) -> DataFrame:
    """Per document of the shard files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_encoder.cache_clear()  # workers that have written shards still hold one
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, place = filesystem(path)
                rows: list[list] = [[], [], [], []]
                with files.open_input_file(place) as source:
                    shard = Reader(source)
                    for doc, before, pieces in shard.documents():
                        n, crc = 0, 0
                        for piece in pieces:
                            n, crc = n + len(piece), zlib.crc32(piece, crc)
                        for column, value in zip(rows, (doc, start + before, n, crc), strict=True):
                            column.append(value)
                        if len(rows[0]) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *(pa.array(c, pa.int64()) for c in rows[1:])], names=names)
                            rows = [[], [], [], []]
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *(pa.array(c, pa.int64()) for c in rows[1:])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    kind = to_arrow_type(_parse_datatype_string(doc_id_type))
    return shards.select("path", "start").mapInArrow(run, f"doc_id {doc_id_type}, start long, n_tokens long, ids_crc32 long")


def shard_rows(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """The list of shards, dealt out for reading: a shard is one row, and rows go round."""
    return shards.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


