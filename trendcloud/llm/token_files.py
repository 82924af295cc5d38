"""Token ids of a corpus in seekable files, and a reader that decompresses only what is asked for.

A file holds documents in ascending id order:

* independent zstandard frames of whole documents, each about `FRAME_BYTES` of
  ids as little-endian unsigned 32-bit numbers, with zstandard's own checksum;
* a skippable frame with one record per document (where it lies);
* a trailing seek table: per frame its compressed and its plain size and a
  checksum of the plain bytes, in the layout of the public seekable zstandard
  format, so a plain zstandard decoder reads the files too.

Documents are dealt out by ranges of ids, so file after file is in order. Each
task writes its file under a name of its own and reports it when it is complete;
the manifest lists the reported ones, so files of lost or repeated tasks are
never read. Files go through Arrow's file systems (file, hdfs, s3, gs URIs).
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendcloud.llm.common import bounded_batches, offsets, pieces, ranges, shuffle_partitions, utf8
from trendcloud.llm.token_counts import byte_letters, special_strings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME_BYTES = 1 << 20
#: Distinct words and pieces whose ids a task remembers before it forgets all of them.
REMEMBERED = 1 << 19
#: Bytes of texts that are cut at once.
BLOCK_BYTES = 1 << 21

#: Fixed: how texts are cut after they are lower-cased (the public pattern of this format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: Latin letters that need no composition and have one lower-case letter each.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž"

# Kinds of bytes.
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)

# Fixed values of the zstandard seekable format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_DOCUMENTS = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: One document: its id, whether it has one, its frame, its place in the frame and its ids.
RECORD = np.dtype([("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


class WordIds(dict):
    """The ids of a text's words, as bytes, of a tokenizer that drops white space and keeps words apart.

    Blocks of texts are cut as arrays of bytes: a plain word into its lower-cased
    pieces, one of the tokenizer's pattern each; any other word stands whole, as it
    is in the text. Each distinct one of a block is looked up, and what has not been
    seen before is cut by the tokenizer's own steps and merged.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # The library's own cache of merged words outlives the tokenizer in a reused worker.
        self.tokenizer.model._resize_cache(0)
        self.tokenize = self.tokenizer.model.tokenize
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(32)]
        spec = json.loads(tokenizer_json)
        _check(spec)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Among the plain letters these are all the letters and numbers there are.
        self.find = re.compile(pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9")).findall
        self.plain = re.compile(f"[!-~{LETTERS}]+").fullmatch
        self.shown = byte_letters()
        self.pieces: dict[str, bytes] = {}
        special = sorted(special_strings(spec), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, special))})").split if special else None
        # No text holds the byte 255, so these words stand for special strings alone.
        self.marks = {s: b" \xff%d " % i for i, s in enumerate(special)}
        ids = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = {mark.strip(): struct.pack("<I", ids[s]) for s, mark in self.marks.items()}
        self.signs = {s[:2].encode() for s in special} | {b"\xff"}
        self.space = re.compile(rb"[\t-\r ]").search
        self.kinds, self.low, self.pairs = _byte_tables(pattern == PATTERN)
        self._forget()

    def _merge(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenize(piece)]
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self._merge(piece)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = self[word] = self._merge(word.lower().decode())
            return ids
        text = word.decode()
        ascii_ = text.isascii()
        if (ascii_ and text.isprintable()) or self.plain(text):
            text = text.lower()
            found = [text] if text.isalpha() else self.find(text)
            if not ascii_:  # a byte-level vocabulary shows bytes as letters
                found = [p.encode().decode("latin-1").translate(self.shown) for p in found]
        else:
            normal = self.tokenizer.normalizer.normalize_str(text)
            found = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        ids = self[word] = self._merge(found[0]) if len(found) == 1 else b"".join(map(self._piece, found))
        return ids

    def of(self, docs: Iterable[tuple[int | None, bytes]]) -> Iterator[tuple[int | None, bytes]]:
        """(key, ids) of each (key, text), in the same order."""
        ids: list[bytes] = []
        for block in self._blocks(docs):
            if len(self) > REMEMBERED:
                self._forget()
            keys, parts, last = zip(*block, strict=True)
            for key, part, whole in zip(keys, self._block(parts), last, strict=True):
                ids.append(part)
                if whole:
                    yield key, b"".join(ids)
                    ids = []

    def _forget(self) -> None:
        self.clear()
        self.pieces.clear()
        self.update(self.special)

    def _blocks(self, docs: Iterable[tuple[int | None, bytes]]) -> Iterator[list[tuple[int | None, bytes, bool]]]:
        """(key, part of its text, is it the last one) in blocks; long texts are cut at white space."""
        block, size = [], 0
        for key, text in docs:
            if self.cut and any(s in text for s in self.signs):
                parts = self.cut(text.decode())
                text = b"".join(self.marks[p] if i % 2 else p.encode() for i, p in enumerate(parts))
            at, last = 0, False
            while not last:
                space = self.space(text, at + BLOCK_BYTES)
                end = space.start() if space else len(text)
                last = not space
                block.append((key, text[at:end], last))
                size += end - at + 64  # a row without text weighs something too
                at = end
                if size >= BLOCK_BYTES:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    def _block(self, parts: tuple[bytes, ...]) -> list[bytes]:
        """The ids of each part: those of the distinct words and pieces, put in place."""
        raw = np.frombuffer(b"\n%b\n" % b"\n".join(parts), np.uint8)
        kind, low = self._kinds(raw)
        begin = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        held = kind[1:] != SPACE
        places = np.flatnonzero(begin & held) + 1
        ends = np.append(np.flatnonzero(begin[held]), np.count_nonzero(held)).astype(np.int32)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(low[1:][held])]
        found = pa.Array.from_buffers(pa.binary(), len(places), buffers).dictionary_encode()
        words = [self[w] for w in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        which = found.indices.to_numpy()
        counts = sizes[which]
        ids = np.frombuffer(b"".join(words), "<u4")[ranges(offsets(sizes)[which], counts)].tobytes()
        heads = 1 + offsets(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        cuts = 4 * offsets(counts)[np.searchsorted(places, heads)]
        return [ids[a:b] for a, b in pairwise(cuts.tolist())]

    def _kinds(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kind of every byte, and the bytes with plain words in lower case."""
        kind, low = self.kinds[raw], self.low[raw]
        leads = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
        if len(leads):
            follow = raw[leads + 1]
            pair = self.pairs[raw[leads] & 7, follow & 63]
            pair[follow >> 6 != 2] = 0
            low[leads], low[leads + 1] = pair.T
            kind[leads[pair[:, 0] == 0]] = WHOLE
        odd = kind == WHOLE
        if odd.any():
            words = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
            odd = np.repeat(np.logical_or.reduceat(odd, words), np.diff(words, append=len(raw)))
            rest = kind[words[0] :]
            rest[odd & (rest != SPACE)] = WHOLE
            low = np.where(kind == WHOLE, raw, low)
        return kind, low


def _byte_tables(cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte, its lower case, and that of the plain letters of two bytes (0: not plain).

    A word with any byte of kind `WHOLE` is not cut; without `cut` none is.
    """
    kinds = np.full(256, WHOLE, np.uint8)
    if cut:
        kinds[0x21:0x7F] = OTHER
        kinds[ord("'")] = WHOLE  # may begin a contraction
        for first, last in ("az", "AZ", "\x80\xbf", "\xc3\xc5"):
            kinds[ord(first) : ord(last) + 1] = LETTER
        kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[[*b"\t\n\v\f\r "]] = SPACE
    low = np.arange(256, dtype=np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    pairs = np.zeros((8, 64, 2), np.uint8)
    for c in filter(re.compile(f"[{LETTERS}]").match, map(chr, range(0xC0, 0x180))):
        lead, follow = c.encode()
        pairs[lead & 7, follow & 63] = [*c.lower().encode()]
    return kinds, low, pairs


def _check(spec: dict) -> None:
    """Words may be encoded one by one only if nothing in the tokenizer looks past white space."""
    steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
    split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    plain = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and split.get("type") == "Split"
        and (split["behavior"], split["invert"]) == ("Removed", True)
        and [(r["type"], r["use_regex"], r["add_prefix_space"]) for r in rest] == [("ByteLevel", False, False)]
    )
    if not plain:
        raise ValueError("only tokenizers that lower-case, drop white space and split words alike")


class FileWriter:
    """One seekable file."""

    def __init__(self, out, frame_bytes: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.entries: list[tuple] = []
        self.records: list[tuple] = []
        self.plain, self.size = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._frame()
        self.records.append((doc_id or 0, doc_id is None, len(self.entries), self.size // 4, len(ids) // 4))
        self.plain.append(ids)
        self.size += len(ids)

    def _frame(self) -> None:
        plain = b"".join(self.plain)
        packed = self.compressor.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.plain, self.size = [], 0

    def close(self) -> None:
        if self.plain:
            self._frame()
        records = self.compressor.compress(np.array(self.records, RECORD).tobytes())
        self.out.write(np.array([SKIPPABLE_DOCUMENTS, len(records)], "<u4").tobytes() + records)
        self.entries.append((len(records) + 8, 0, 0))
        table = np.array(self.entries, _ENTRY).tobytes()
        table += np.array([len(self.entries)], "<u4").tobytes() + bytes([CHECKSUM_FLAG])
        table += np.array([SEEKABLE_MAGIC], "<u4").tobytes()
        self.out.write(np.array([SKIPPABLE_TABLE, len(table)], "<u4").tobytes() + table)


class FileReader:
    """Random access to one file: the seek table, the documents, and single frames."""

    def __init__(self, file):
        self.file = file
        foot = self._at(file.size() - 9, 9)
        frames, flag, magic = np.frombuffer(foot, [("n", "<u4"), ("flag", "u1"), ("magic", "<u4")])[0]
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        size = int(frames) * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(file.size() - 9 - size, size), _ENTRY)
        self.begins = offsets(self.entries["packed"])
        packed = self._at(int(self.begins[-2]) + 8, int(self.entries["packed"][-1]) - 8)
        self.records = np.frombuffer(zstandard.decompress(packed), RECORD)

    def _at(self, begin: int, size: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        packed = self._at(int(self.begins[i]), int(self.entries["packed"][i]))
        plain = zstandard.decompress(packed)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["checksum"][i]:
            raise ValueError(f"frame {i} is damaged")
        return plain

    def documents(self, only: np.ndarray | None = None) -> Iterator[tuple]:
        """(id, ids before it in the file, ids as bytes) of the documents, or of those whose id is in `only`."""
        starts = offsets(self.records["n"])
        chosen = np.arange(len(self.records))
        if only is not None:
            chosen = np.flatnonzero(np.isin(self.records["id"], only) & (self.records["null"] == 0))
        last, plain = -1, b""
        for i in chosen:
            doc_id, null, frame, at, n = self.records[i].tolist()
            if frame != last:
                last, plain = frame, self.frame(frame)
            yield None if null else doc_id, int(starts[i]), plain[4 * at : 4 * (at + n)]


def _open(path: str):
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _write(folder: str, tokenizer_json: str, end_id: int, frame_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(tokenizer_json)
        end = np.array([end_id], "<u4").tobytes()
        system, path = _open(folder)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.zst"
        writer = out = None
        low = high = None
        rows = (
            row
            for batch in pieces(batches, 256)
            for row in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)
        )
        for doc_id, tokens in ids.of(rows):
            if writer is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
                writer = FileWriter(out, frame_bytes)
            writer.add(doc_id, tokens + end)
            if doc_id is not None:
                low, high = doc_id if low is None else low, doc_id
        if writer is None:
            return
        writer.close()
        out.close()
        total = sum(r[4] for r in writer.records)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId()], pa.int32()),
                pa.array([name]),
                pa.array([len(writer.records)], pa.int64()),
                pa.array([total], pa.int64()),
                pa.array([low], pa.int64()),
                pa.array([high], pa.int64()),
            ],
            names=["part", "name", "n_docs", "n_ids", "low", "high"],
        )

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_json: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    frame_bytes: int = FRAME_BYTES,
) -> None:
    """Encode every row, append `end_id`, and write files and their manifest into a new folder.

    Rows without an id come first; rows that share an id follow each other in an
    order of their texts. Null and empty texts have `end_id` alone. A text of any
    length is one document and lies in one frame. An empty table gives a manifest
    without files. Ids are integers; other columns are left out. Special strings
    inside texts are their token, as is the library's default.
    """
    bounded_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The hash also splits rows that share an id between neighbouring files.
    ordered = (
        chosen.withColumn("mark", F.xxhash64("text"))
        .repartitionByRange(n, "id", "mark")
        .sortWithinPartitions("id", "mark", "text")
    )
    written = ordered.select("id", "text").mapInArrow(
        _write(folder, tokenizer_json, end_id, frame_bytes),
        "part int, name string, n_docs long, n_ids long, low long, high long",
    )
    written.write.parquet(f"{folder}/manifest")


def _read(folder: str, only: np.ndarray | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                with system.open_input_file(f"{path}/{name}") as file:
                    for row in FileReader(file).documents(only):
                        rows.append(row)
                        if len(rows) == 512:
                            yield _batch(rows, before)
                            rows = []
                if rows:
                    yield _batch(rows, before)

    return read


def _batch(rows: list[tuple], before: int) -> pa.RecordBatch:
    ids, starts, tokens = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([before + s for s in starts], pa.int64()),
            pa.array([len(t) // 4 for t in tokens], pa.int64()),
            pa.array(tokens, pa.binary()),
        ],
        names=["id", "start", "n_tokens", "tokens"],
    )


def read_token_files(
    spark: SparkSession, folder: str, id_col: str = "doc_id", only: list[int] | None = None
) -> DataFrame:
    """(id_col, start, n_tokens, tokens) of all documents, or of those with the ids `only`.

    `start` counts the ids of all documents before, over all files; `tokens` are
    the ids as little-endian unsigned 32-bit numbers. With `only`, files without
    any of the ids are not opened and frames without any not decompressed.
    """
    schema = "part int, name string, n_docs long, n_ids long, low long, high long"
    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    # One row per file.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    wanted = None
    if only is not None:
        wanted = np.array(sorted(set(only)), np.int64)
        placed = placed.filter(
            F.exists(F.array(*map(F.lit, wanted.tolist())).cast("array<bigint>"), lambda x: (x >= F.col("low")) & (x <= F.col("high")))
        )
    files = placed.repartition(shuffle_partitions(spark), "name").select("name", "before")
    found = files.mapInArrow(_read(folder, wanted), "id long, start long, n_tokens long, tokens binary")
    return found.withColumnRenamed("id", id_col)
