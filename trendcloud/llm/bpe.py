"""Byte-level BPE over a corpus: every distinct word of it is merged once.

Three shuffles, none of them of the texts:

1. Each task cuts its texts into pre-tokens and packs documents into *blocks* of
   bounded size. A block keeps the position of every pre-token as a number into
   the block's own list of distinct words, so a position costs a byte or two.
2. The distinct words of all blocks are dealt out by their hash. A word has one
   row per block, however often the corpus repeats it, so no word is hot. The
   task that owns a word merges it once and answers every block that asked.
3. The ids of a block's words meet its documents again, and every document is
   put together by position.

Decoding joins the token-byte table: the distinct ids of a block are rows that meet
their rows of the table, and the bytes found go back to the block, whose ids keep
their positions. `encode` with `decoded` does so along the blocks it has anyway, so
the documents are shuffled once; `decode` packs blocks of its own.

All of it follows from the rows of a partition alone: a lost task can run again. A
block is named by its contents, so if the input gives its rows in another order when
it is run again, the job fails instead of mixing two runs up. Store such an input first.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trendcloud.llm.common import bounded_batches, offsets, pieces, ranges, shuffle_partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in a block: what one task holds when it puts documents together.
BLOCK_BYTES = 8 << 20

#: Ids in a block of `decode`.
BLOCK_IDS = 2 << 20

#: Token-byte tables up to this size (with 64 bytes a row) are broadcast.
TABLE_BYTES = 32 << 20

#: In place of the part, in rows that bring a block the bytes of its tokens.
TOKENS = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 and id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merger(ranks: dict[bytes, int]):
    """A function from one pre-token to its ids, merged by rank."""
    whole = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return whole.encode_ordinary


class Distinct(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32; their bytes of equal weight lie together and compress well."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.compress(len(words).to_bytes(4, "little") + lengths + b"".join(words), 1)


def unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def block_name(made: int, contents: list[bytes]) -> int:
    """Of the task's block number `made`; another if the block holds anything else."""
    name = xxhash.xxh3_64(b"%d %d" % (TaskContext.get().partitionId(), made))
    for part in contents:
        name.update(part)
    return name.intdigest() - (1 << 63)


def _blocks_of(pattern: str, parts: int, block_bytes: int, schema: pa.Schema):
    """Texts to blocks; a block's words are ordered by the part that will merge them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        made = 0

        def block(ids: list, counts: list[int], codes: list[np.ndarray], words: Distinct):
            nonlocal made
            flat = np.concatenate(codes)
            # Frequent words get small numbers, which compress best.
            common = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            number = np.empty(len(common), np.int64)
            number[common] = np.arange(len(common))
            names = sorted((xxhash.xxh3_64_intdigest(w := x.encode()) % parts, w, i) for x, i in words.items())
            place = np.empty(len(names), np.int64)
            place[number[[i for _, _, i in names]]] = np.arange(len(names))
            part = np.fromiter((p for p, _, _ in names), np.int64, len(names))
            used, first = np.unique(part, return_index=True)
            at = [*first.tolist(), len(names)]
            asked = [pack_words([w for _, w, _ in names[a:b]]) for a, b in zip(at, at[1:], strict=False)]
            made += 1
            packed = pack_numbers(number[flat])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block_name(made, [packed, *asked])], pa.int64()),
                    pa.array([pa.concat_arrays(ids)], schema.field("ids").type),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([packed], pa.binary()),
                    pa.array([pack_numbers(place)], pa.binary()),
                    pa.array([asked], pa.list_(pa.binary())),
                    pa.array([used.tolist()], pa.list_(pa.int32())),
                ],
                schema=schema,
            )

        ids, counts, codes, words, size = [], [], [], Distinct(), 0
        for batch in pieces(batches, 128):
            keys, texts = batch.column(0), batch.column(1)
            ids.append(keys)
            for text in texts.to_pylist():
                tokens = find(text or "")
                counts.append(len(tokens))
                codes.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
            size += texts.nbytes
            if size >= block_bytes:
                yield block(ids, counts, codes, words)
                ids, counts, codes, words, size = [], [], [], Distinct(), 0
        if counts:
            yield block(ids, counts, codes, words)

    return blocks


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's words as one row for each part."""
    for batch in pieces(batches, 1):
        parts, asked = batch.column("parts").flatten(), batch.column("asked").flatten()
        block = pa.array([batch.column("block")[0].as_py()] * len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([parts, block, asked], names=["part", "block", "words"])


def _merge(ranks: dict[bytes, int]):
    """Answer the rows of whole parts: every distinct word among them is merged once."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(ranks)
        known: dict[bytes, bytes] = {}
        for batch in pieces(batches, 16):
            lengths, ids = [], []
            for packed in batch.column("words").to_pylist():
                own = []
                for word in unpack_words(packed):
                    merged = known.get(word)
                    if merged is None:
                        merged = known[word] = np.array(merge(word.decode()), "<u4").tobytes()
                    own.append(merged)
                lengths.append(pack_numbers(np.fromiter(map(len, own), np.int64, len(own)) // 4))
                ids.append(pack_numbers(np.frombuffer(b"".join(own), "<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("block"), pa.array(lengths), pa.array(ids)],
                names=["part", "block", "lengths", "merged"],
            )

    return answer


def _ids_of(answers: pa.Table) -> pa.Table:
    """The distinct ids of a block, as rows."""
    ids = [np.unique(unpack_numbers(x)) for x in answers["merged"].to_pylist()]
    ids = np.unique(np.concatenate(ids)).astype(np.int32)
    block = np.full(len(ids), answers["block"][0].as_py(), np.int64)
    return pa.table({"block": block, "id": ids})


def _pack_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (block, id, token) packed, a row for each block of a batch."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks).tolist():
            own = batch.filter(pa.array(blocks == block))
            ids, tokens = own.column("id").to_numpy(), own.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TOKENS], pa.int32()),
                    pa.array([block], pa.int64()),
                    pa.array([pack_numbers(ids)], pa.binary()),
                    pa.array([pack_words(tokens)], pa.binary()),
                ],
                names=["part", "block", "lengths", "merged"],
            )


def _join_tokens(wanted: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, id) with the token-byte table, which is broadcast if its size is within `TABLE_BYTES`."""
    rows = pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks.keys(), pa.binary())})
    tokens = wanted.sparkSession.createDataFrame(rows)
    if rows.nbytes + 64 * len(ranks) <= TABLE_BYTES:
        tokens = F.broadcast(tokens)
    found = wanted.join(tokens, "id").select("block", "id", "token")
    return found.mapInArrow(_pack_tokens, "part int, block long, lengths binary, merged binary")


def _bytes_of(flat: np.ndarray, sizes: np.ndarray, packed: pa.Table) -> pa.Array:
    """What ids decode to, row after row: `sizes` are the offsets of rows, `packed` the tokens found."""
    tokens = [w for x in packed["merged"].to_pylist() for w in unpack_words(x)]
    ids = np.concatenate([np.zeros(0, np.int64), *map(unpack_numbers, packed["lengths"].to_pylist())])
    order = np.argsort(ids)
    ids = ids[order]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    first, lengths = offsets(lengths)[:-1][order], lengths[order]
    data = np.frombuffer(b"".join(tokens), np.uint8)
    out, ends = [], [np.zeros(1, np.int64)]
    for at in range(0, len(flat), 1 << 18):
        some = flat[at : at + (1 << 18)]
        where = np.searchsorted(ids, some)
        if not len(ids) or (ids[np.minimum(where, len(ids) - 1)] != some).any():
            raise ValueError("an id has no bytes in the table")
        out.append(data[ranges(first[where], lengths[where])])
        ends.append(ends[-1][-1] + np.cumsum(lengths[where]))
    bounds = np.concatenate(ends)[sizes].astype(np.int32)
    decoded = np.concatenate([np.zeros(0, np.uint8), *out])
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(decoded)])


def _assemble(id_type: pa.DataType, decoded: bool):
    def assemble(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if blocks.num_rows != 1:
            raise RuntimeError("the input gave other rows when it was run again: store it first")
        is_token = pc.equal(answers["part"], TOKENS)
        tokens = answers.filter(is_token)
        answers = answers.filter(pc.invert(is_token)).sort_by("part")  # as the block's words are ordered
        none = np.zeros(0, np.int64)
        lengths = np.concatenate([none, *map(unpack_numbers, answers["lengths"].to_pylist())])
        merged = [unpack_numbers(x).astype(np.int32) for x in answers["merged"].to_pylist()]
        merged = np.concatenate([none.astype(np.int32), *merged])
        place = unpack_numbers(blocks["place"][0].as_py())
        if len(lengths) != len(place):
            raise RuntimeError("the input gave other rows when it was run again: store it first")
        starts, lengths = offsets(lengths)[:-1][place], lengths[place]
        ids = blocks["ids"].combine_chunks().flatten()
        counts = blocks["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        codes = unpack_numbers(blocks["codes"][0].as_py()).astype(np.int32)
        sizes = offsets(lengths[codes])[offsets(counts)]
        flat, filled = np.empty(sizes[-1], np.int32), 0
        for at in range(0, len(codes), 1 << 18):  # a slice at a time: the gather takes 16 bytes an id
            some = codes[at : at + (1 << 18)]
            got = merged[ranges(starts[some], lengths[some])]
            flat[filled : filled + len(got)] = got
            filled += len(got)
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
        out = pa.table([ids.cast(id_type), lists], names=["id", "ids"])
        return out.append_column("decoded", _bytes_of(flat, sizes, tokens)) if decoded else out

    return assemble


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    decoded: bool = False,
) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row, merged by `ranks` inside each match of `pattern`.

    With `decoded`, a third column has the bytes that the ids decode to.

    Special tokens are ordinary text. A null or empty text has no ids, a null id
    is kept, repeated rows give repeated rows, an empty table an empty one.
    Columns other than the two are left out, whatever their names. A very long
    text is a block of its own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = shuffle_partitions(spark)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = chosen.schema["id"].dataType
    blocks_schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("codes", T.BinaryType()),
            T.StructField("place", T.BinaryType()),
            T.StructField("asked", T.ArrayType(T.BinaryType())),
            T.StructField("parts", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow = to_arrow_schema(blocks_schema)
    blocks = chosen.mapInArrow(_blocks_of(pattern, 3 * n, block_bytes, arrow), blocks_schema)
    # Both uses below need every column of it, so Spark finds one and the same exchange.
    blocks = blocks.repartition(n, "block")
    asked = blocks.mapInArrow(_ask, "part int, block long, words binary")
    answered = asked.repartition(n, "part").mapInArrow(
        _merge(ranks), "part int, block long, lengths binary, merged binary"
    )
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    if decoded:
        schema = schema.add("decoded", T.BinaryType())
        answered = answered.repartition(n, "block")
        wanted = answered.groupBy("block").applyInArrow(_ids_of, "block long, id int")
        # Both sides lie by block, so the union does and its rows are not shuffled again.
        answered = answered.unionByName(_join_tokens(wanted, ranks).repartition(n, "block"))
    encoded = (
        blocks.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(_assemble(arrow.field("ids").type.value_type, decoded), schema)
    )
    return encoded.withColumnRenamed("id", id_col)


def _rows_of(field: str, block_ids: int, schema: pa.Schema):
    """Rows to blocks, each with its distinct ids."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def block(rows: list, ids: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            flat = pa.concat_arrays(ids)
            if flat.null_count:
                raise ValueError("an id has no bytes in the table")
            flat = flat.to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block_name(made, [np.ascontiguousarray(flat)])], pa.int64()),
                    pa.ListArray.from_arrays([0, sum(map(len, rows))], pa.concat_arrays(rows), schema.field("rows").type),
                    pa.array([np.unique(flat)], schema.field("wanted").type),
                ],
                schema=schema,
            )

        rows, ids, size = [], [], 0
        for batch in pieces(batches, 128):
            rows.append(batch.column("row"))
            ids.append(pc.struct_field(rows[-1], field).flatten())
            size += len(ids[-1])
            if size >= block_ids:
                yield block(rows, ids)
                rows, ids, size = [], [], 0
        if rows:
            yield block(rows, ids)

    return blocks


def _decoded(field: str):
    def decoded(key: tuple, blocks: pa.Table, tokens: pa.Table) -> pa.Table:
        if blocks.num_rows != 1:
            raise RuntimeError("the input gave other rows when it was run again: store it first")
        rows = blocks["rows"].combine_chunks().flatten()
        lists = pc.struct_field(rows, field)
        sizes = offsets(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        found = _bytes_of(lists.flatten().to_numpy(zero_copy_only=False), sizes, tokens)
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(rows)]).append_column("decoded", found)

    return decoded


def decode(
    encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Add `decoded` BINARY: the distinct ids of blocks of rows join the token-byte table.

    All columns are kept; one named `decoded` is replaced. Bytes need not be valid
    UTF-8, as an id may be part of a character. Null or empty ids decode to no bytes;
    an id that is null or outside the table fails the job. Repeated rows stay, an
    empty table gives an empty one, and a very long row is a block of its own.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    kept = [c for c in encoded.columns if c.lower() != "decoded" or c == ids_col]
    rows = encoded.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    row_type = rows.schema["row"].dataType
    id_type = row_type[ids_col].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("rows", T.ArrayType(row_type)),
            T.StructField("wanted", T.ArrayType(id_type)),
        ]
    )
    blocks = rows.mapInArrow(_rows_of(ids_col, block_ids, to_arrow_schema(schema)), schema)
    blocks = blocks.repartition(shuffle_partitions(spark), "block")
    tokens = _join_tokens(blocks.select("block", F.explode("wanted").alias("id")), ranks)
    out = T.StructType([*row_type.fields, T.StructField("decoded", T.BinaryType())])
    return blocks.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(_decoded(ids_col), out)


def bpe_report(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of what they decode to."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return encode(docs, ranks, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
