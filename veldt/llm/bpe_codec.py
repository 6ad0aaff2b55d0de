"""BPE encoding and decoding by a distinct-word table.

A word here is what stands between ASCII white space. The tokenizer never joins characters across white space and white space
itself yields no token, so the ids of a text are the ids of its words in order.

1. Spark's ``split`` cuts the texts into words. Each task numbers the distinct words of a block of texts (some tens of MB) in
   their order and keeps the texts as those numbers: words and numbered texts are written once, in buckets by block.
2. The words are dealt and sorted by themselves: the word table, a row for each word and block that holds it. Each distinct
   word is encoded once, and its ids go back to the blocks under the word's number there, many in a row. So a word costs a
   row a block and not a row an occurrence, and texts are never shuffled.
3. The ids of a block's words are joined with the block's texts by position.

Decoding is a join too: distinct ids, with the blocks that hold them, are rows that Spark joins with the id-to-piece table. The
pieces go to the blocks with the ids of their words, or meet a bucket of id lists, and texts are put together from them there. The
table has the vocabulary's size, which bounds its broadcast; no id of a text is moved for it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import Tables, stored

#: Blocks end at so many bytes of words.
BLOCK_BYTES = 48 << 20
#: Ids go back to the blocks by so many words at a time.
WORDS_BACK = 1 << 18
#: An id asks for its piece on behalf of up to so many blocks at once.
BLOCKS_ASKING = 1000
#: Words are given to the tokenizer together, up to so many letters.
LETTERS_AT_ONCE = 200_000
#: A worker that encodes whole texts keeps words of so many letters together, and as many that it met before.
KEPT_LETTERS = 800_000
WORDS_AT_ONCE = 1 << 20
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of this process; truncation and padding are switched off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=2)
def separator(path: str) -> tuple[str, int] | None:
    """(a control sign that is one token by itself between blanks, its id), or None if there is none."""
    tok = tokenizer(path)
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    for sign in "\x01\x02\x03\x04":
        if len(ids(sign)) == 1 and ids(f"a {sign} b") == ids("a") + ids(sign) + ids("b"):
            return sign, ids(sign)[0]
    return None


@functools.lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """For each id whether its piece ends a word, by the suffix that the tokenizer's model declares; all false if it has none."""
    suffix = json.loads(tokenizer(path).to_str())["model"].get("end_of_word_suffix")
    return np.array([bool(suffix) and (p or "").endswith(suffix) for p in vocabulary(path)])


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers.

    Many words go to the tokenizer as one text. Words of letters come back with at least one word end each: if there are as
    many ends as words, each end closes one. Other words, and these where it isn't so, have a separator between them; words
    that hold the separator go alone.
    """
    out = [b""] * len(words)
    letters, others = [], []
    for i, w in enumerate(words):
        (letters if w.isalpha() else others).append(i)
    for run in _runs(words, letters):
        ids = _ids(path, " ".join([words[i] for i in run]))
        cut = np.flatnonzero(word_ends(path)[ids]) + 1
        if len(cut) != len(run):
            others += run
            continue
        _share(out, run, ids, np.concatenate(([0], cut[:-1])), cut)
    sign, sign_id = separator(path) or ("", -1)  # every word holds the empty sign
    alone = [i for i in others if words[i] and sign in words[i]]
    for run in _runs(words, [i for i in others if sign not in words[i]]):
        ids = _ids(path, f" {sign} ".join([words[i] for i in run]))
        cut = np.flatnonzero(ids == sign_id)
        if len(cut) + 1 != len(run):
            alone += run
            continue
        _share(out, run, ids, np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ids)])))
    for at in range(0, len(alone), 1000):
        some = alone[at : at + 1000]
        for i, e in zip(some, tokenizer(path).encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
    return out


def _ids(path: str, text: str) -> np.ndarray:
    return np.array(tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


def _runs(words: list[str], which: list[int]) -> Iterator[list[int]]:
    if which:
        sizes = np.cumsum([len(words[i]) + 3 for i in which]) // LETTERS_AT_ONCE
        edges = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(which)]
        yield from (which[a:b] for a, b in zip(edges, edges[1:]))


def _share(out: list[bytes], run: list[int], ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
    flat = ids.tobytes()
    for i, a, b in zip(run, (4 * begin).tolist(), (4 * end).tolist()):
        out[i] = flat[a:b]


def gather(codes: np.ndarray, ends: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids joined back by position: (ids of all texts one after another, where each text's ids end).

    ``codes`` are the word numbers of all texts, ``ends`` where each text's words end; word k has the ids
    flat[starts[k] : starts[k] + sizes[k]].
    """
    made, stop = [np.zeros(0, "<u4")], np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes[codes], out=stop[1:])
    for a in range(0, len(codes), WORDS_AT_ONCE):
        part = codes[a : a + WORDS_AT_ONCE]
        size, first, begin = sizes[part], starts[part], stop[a]
        shift = np.repeat(first - (stop[a : a + len(part)] - begin), size)
        made.append(flat[np.arange(len(shift)) + shift].astype("<u4"))
    return np.concatenate(made), stop[ends]


class Encoder:
    """Encodes whole texts in one task; keeps the ids of words it has met, up to a bound."""

    def __init__(self, path: str):
        self.path, self.ids, self.old, self.letters = path, {}, {}, 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids end); a null text has none."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.letters > KEPT_LETTERS:  # the words of late become the old ones
            self.old, self.ids, self.letters = self.ids, {}, 0
        bags = list(map(self.ids.get, distinct))
        new = [i for i, bag in enumerate(bags) if bag is None]
        lacking = []
        for i in new:
            bags[i] = self.old.get(distinct[i])
            if bags[i] is None:
                lacking.append(i)
        for i, bag in zip(lacking, encode_words(self.path, [distinct[i] for i in lacking])):
            bags[i] = bag
        self.ids.update([(distinct[i], bags[i]) for i in new])
        self.letters += sum([len(distinct[i]) for i in new])
        sizes = np.fromiter(map(len, bags), np.int64, len(bags)) // 4
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
        return gather(coded.indices.to_numpy(), ends, np.frombuffer(b"".join(bags), "<u4"), np.cumsum(sizes) - sizes, sizes)


def _split(docs: DataFrame, keep: list[str], text: str, tables: Tables) -> DataFrame:
    """Written rows of two kinds: numbered texts (block, rows, ends, codes) and the words of each block (block, code, word).

    ``rows`` holds the columns ``keep`` of some texts; codes are the numbers of their words in the block, as compressed
    32-bit integers.
    """
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("c"))
    words = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, -1)
    cut = docs.select(carried.alias("row"), words.alias("words"))
    kind = cut.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, size = TaskContext.get().partitionId() << 24, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            numbered = pa.chunked_array([coded for _, _, coded in part]).unify_dictionaries()
            order = pc.sort_indices(numbered.chunk(0).dictionary).to_numpy()
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            for (rows, ends, _), coded in zip(part, numbered.chunks):
                codes = packed(rank[coded.indices.to_numpy()])
                yield batch_of(
                    1, rows=pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), ends=pa.array([ends], pa.list_(pa.int64())), codes=pa.array([codes], pa.binary())
                )
            found = numbered.chunk(0).dictionary.take(pa.array(order))
            for at in range(0, len(found), 1 << 16):
                some = found.slice(at, 1 << 16)
                yield batch_of(len(some), code=pa.array(np.arange(at, at + len(some)), pa.int32()), word=some)

        def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
            empty = {"rows": pa.list_(row_type), "ends": pa.list_(pa.int64()), "codes": pa.binary(), "code": pa.int32(), "word": pa.string()}
            made = [columns[c] if c in columns else pa.nulls(n, t) for c, t in empty.items()]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), *made], ["block", *empty])

        for batch in batches:
            row_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                rows, words = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
                ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
                flat = words.flatten()
                part.append((rows, ends, flat.dictionary_encode()))
                size += flat.nbytes
                if size >= BLOCK_BYTES:
                    yield from done()
                    block, part, size = block + 1, [], 0
        if part:
            yield from done()
        part.clear()
        pa.default_memory_pool().release_unused()

    return tables.write(cut.mapInArrow(run, f"block long, rows array<{kind}>, ends array<long>, codes binary, code int, word string"), "split")


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, the lowest bytes of all first and the highest last, which compresses better than number by number."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", compression_level=3).compress(planes, asbytes=True) if len(numbers) else b""


def unpacked(numbers: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<i4")
    planes = np.frombuffer(pa.decompress(numbers, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(n)


def _word_ids(split: DataFrame, path: str, distinct_ids: bool) -> DataFrame:
    """Rows (block, n, total, codes, sizes, ids, nulls) of many words of a block each.

    Every distinct word is encoded once, where its rows of all blocks stand together. With ``distinct_ids`` there are rows
    (nulls, id, asking) besides: each id of those words, with the blocks that they stand in.
    """
    columns = ["block", "n", "total", "codes", "sizes", "ids", "id", "asking"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, bytes] = {}  # the word that the batch before ended with
        waiting, rows = [], 0

        def back() -> Iterator[pa.RecordBatch]:
            block, code = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            bags = pa.concat_arrays([w[2] for w in waiting])
            order = np.lexsort((code, block))
            block, code = block[order], code[order]
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))).tolist()
            made, seen = [], []
            for a, b in zip(edges, [*edges[1:], len(block)]):
                some = bags.take(pa.array(order[a:b]))
                ids = np.frombuffer(b"".join(some.to_pylist()), "<u4")
                sizes = pc.binary_length(some).to_numpy(zero_copy_only=False) // 4
                made.append((int(block[a]), b - a, len(ids), packed(np.diff(code[a:b], prepend=0)), packed(sizes), packed(ids), None, None))
                seen.append(np.unique(ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], columns)
            if distinct_ids:
                asked, asking = np.concatenate(seen), np.repeat(block[edges], [len(x) for x in seen])
                order = np.argsort(asked, kind="stable")
                asked, asking = asked[order], asking[order]
                inside = np.arange(len(asked)) - np.searchsorted(asked, asked)
                starts = np.flatnonzero(inside % BLOCKS_ASKING == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(asked)), pa.int32()), pa.array(asking, pa.int64()))
                lacking = [pa.nulls(len(starts), k) for k in kinds[:-2]]
                yield pa.RecordBatch.from_arrays([*lacking, pa.array(asked[starts], pa.int64()), lists], columns)

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            lacking = [w for w in distinct if w not in last]
            ids = dict(zip(lacking, encode_words(path, lacking))) | last
            last = {w: ids[w] for w in distinct[-1:]}
            bags = pa.array([ids[w] for w in distinct], pa.binary())
            waiting.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), bags.take(coded.indices)))
            rows += batch.num_rows
            if rows >= WORDS_BACK:
                yield from back()
                waiting, rows = [], 0
        if rows:
            yield from back()
        waiting.clear()
        pa.default_memory_pool().release_unused()

    words = split.where("word IS NOT NULL").select("word", "block", "code")
    # neighbours share their beginnings, which the shuffle's compression finds; a word has a row a block at most
    words = words.repartitionByRange("word").sortWithinPartitions("word")
    return words.mapInArrow(run, "block long, n long, total long, codes binary, sizes binary, ids binary, id long, asking array<long>")


def _with_pieces(words: DataFrame, path: str) -> DataFrame:
    """``_word_ids`` joined with the id-to-piece table: rows (block, nulls, known, pieces) of many ids of a block each replace those of ids."""
    columns = ["block", "n", "total", "codes", "sizes", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.is_valid(batch.column("codes")))
            lists = pa.nulls(len(some), pa.list_(pa.int64())), pa.nulls(len(some), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), *lists], [*columns, "known", "pieces"])
            found = batch.filter(pc.is_valid(batch.column("piece")))
            asking = found.column("asking")
            blocks = asking.flatten().to_numpy()
            order = np.argsort(blocks, kind="stable")
            row = pa.array(np.repeat(np.arange(len(found)), asking.value_lengths().to_numpy(zero_copy_only=False))[order], pa.int64())
            each, starts = np.unique(blocks[order], return_index=True)
            ends = pa.array(np.append(starts, len(blocks)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, found.column(c).take(row)) for c in ("id", "piece")]
            lacking = [pa.nulls(len(each), batch.column(c).type) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), *lacking, *lists], [*columns, "known", "pieces"])
        pa.default_memory_pool().release_unused()

    joined = words.join(F.broadcast(pieces(words.sparkSession, path)), "id", "left").select(*columns, "id", "asking", "piece")
    return joined.mapInArrow(run, "block long, n long, total long, codes binary, sizes binary, ids binary, known array<long>, pieces array<string>")


def _joined_back(docs: DataFrame, keep: list[str], path: str, text: str, make, schema: T.StructType, decoding: bool) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those that ``make`` gives for (ids of some texts, where each text's ids end, pieces).

    The pieces are those of the block's ids, as ``by_place`` gives them, or none if not ``decoding``.
    """
    tables = Tables(docs.sparkSession, "block")
    split = _split(docs, keep, text, tables)
    texts = split.where("codes IS NOT NULL").select("block", "rows", "ends", "codes")

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        known = by_place(words.column("known").combine_chunks().flatten(), words.column("pieces").combine_chunks().flatten()) if decoding else None
        words = words.filter(pc.is_valid(words.column("codes")))
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for n, total, *parts in zip(*(words.column(c).to_pylist() for c in ("n", "total", "codes", "sizes", "ids"))):
            numbers = unpacked(parts[0], n), unpacked(parts[1], n), unpacked(parts[2], total).view("<u4")
            for column, more in zip(found, (np.cumsum(numbers[0]), numbers[1].astype(np.int64), numbers[2])):
                column.append(more)
        codes_of, size_of, flat = map(np.concatenate, found)
        starts, sizes = np.empty(len(codes_of), np.int64), np.empty(len(codes_of), np.int64)
        starts[codes_of], sizes[codes_of] = np.cumsum(size_of) - size_of, size_of
        made = []
        for k in range(texts.num_rows):
            rows, ends = texts.column("rows")[k].values, texts.column("ends")[k].values.to_numpy()
            codes = unpacked(texts.column("codes")[k].as_py(), int(ends[-1]))
            ids, stop = gather(codes, ends, flat, starts, sizes)
            made.append(pa.Table.from_arrays([*(rows.field(i) for i in range(len(keep))), *make(ids, stop, known)], names=names))
        return pa.concat_tables(made)  # no block is without texts

    # inside, columns have numbers: names of docs may clash with each other
    names = [f"c{i}" for i in range(len(schema))]
    inner = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)])
    words = _word_ids(split, path, decoding)
    if decoding:
        words = _with_pieces(words, path)
    done = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, inner)
    out = stored(done, "joined").toDF(*schema.names)
    tables.drop()
    return out


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids (array of int) of ``text`` added as ``ids``.

    Equals the tokenizers library's encode(text, add_special_tokens=False) on every whole text, for a tokenizer that drops
    white space, as this one. A null or empty text has no ids. Rows are neither compared nor merged, so repeated rows and null
    keys keep their rows. A column named as ``ids`` is replaced. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != ids]

    def make(found: np.ndarray, stop: np.ndarray, _) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop)), pa.int32()), pa.array(found.astype(np.int32)))]

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return _joined_back(docs, keep, path or default_tokenizer(), text, make, schema, False)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str | None]:
    """The piece of every id, 49,408 of them; null where an id has none."""
    tok = tokenizer(path)
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The id-to-piece table: rows (id, piece), one for each id of the vocabulary."""
    found = [x for x in enumerate(vocabulary(path or default_tokenizer())) if x[1] is not None]
    return spark.createDataFrame(found, "id long, piece string")


def by_place(ids: pa.Array, found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(place of each id among the pieces, or -1; pieces) of ids and their pieces; ids may repeat."""
    ids = ids.to_numpy(zero_copy_only=False)
    place = np.full(ids.max(initial=-1) + 1, -1, np.int64)
    place[ids] = np.arange(len(ids))
    return place, found


def join_pieces(known: tuple[np.ndarray, pa.Array], ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The decoded text of each list of ids: its pieces with one blank between. Ids without a piece give nothing."""
    place, found = known
    at = np.append(place, -1)[np.where((ids >= 0) & (ids < len(place)), ids, len(place))]
    inside = at >= 0
    if not inside.all():
        ends, at = np.concatenate(([0], np.cumsum(inside)))[ends], at[inside]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), found.take(pa.array(at)))
    return pc.binary_join(lists, " ")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of ``ids`` added: distinct ids a block joined with the id-to-piece table.

    Equals the library's decode(ids, skip_special_tokens=False) for a tokenizer without a decoder part, as this one. Rows are
    written once in buckets by block, and the pieces of a block's ids meet its rows there, so no row is shuffled. The table is
    broadcast; its size is the vocabulary's. Null or empty ids give an empty text; null ids in a list and ids outside the
    vocabulary give nothing, as in the library. Repeated rows and null keys keep their rows; a column named as ``out`` is replaced.
    """
    spark = encoded.sparkSession
    keep = [c for c in encoded.columns if c != out]
    at = keep.index(ids)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    dealt = encoded.select(row.alias("row"))
    kind = dealt.schema["row"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, seen = TaskContext.get().partitionId() << 24, 0, np.zeros(0, np.int64)

        def batch_of(n: int, rows: pa.Array, found: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), rows, found], ["block", "rows", "id"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for first in range(0, batch.num_rows, 256):
                rows = batch.column(0).slice(first, 256)
                found = rows.field(at).flatten().drop_null().to_numpy(zero_copy_only=False)
                seen, size = np.union1d(seen, found), size + found.nbytes
                yield batch_of(1, pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.nulls(1, pa.int64()))
                if size >= BLOCK_BYTES:
                    yield batch_of(len(seen), pa.nulls(len(seen), pa.list_(kind)), pa.array(seen, pa.int64()))
                    block, size, seen = block + 1, 0, np.zeros(0, np.int64)
        if len(seen):
            yield batch_of(len(seen), pa.nulls(len(seen), pa.list_(kind)), pa.array(seen, pa.int64()))

    names = [f"c{i}" for i in range(len(keep) + 1)]

    def put_together(texts: pa.Table, found: pa.Table) -> pa.Table:
        known, made = by_place(*(found.column(c).combine_chunks() for c in ("id", "piece"))), []
        for k in range(texts.num_rows):
            rows = texts.column("rows")[k].values
            lists = rows.field(at)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            decoded = join_pieces(known, lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.cumsum(sizes))
            made.append(pa.Table.from_arrays([*(rows.field(i) for i in range(len(keep))), decoded.cast(pa.string())], names=names))
        return pa.concat_tables(made)  # no block is without rows

    tables = Tables(spark, "block")
    blocks = tables.write(dealt.mapInArrow(deal, f"block long, rows array<{kind}>, id long"), "dealt")
    found = blocks.where("id IS NOT NULL").select(F.col("block").alias("asking"), "id").join(F.broadcast(pieces(spark, path)), "id")
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out, T.StringType())])
    inner = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema)])
    texts = blocks.where("rows IS NOT NULL").select("block", "rows")
    done = stored(texts.groupBy("block").cogroup(found.groupBy("asking")).applyInArrow(put_together, inner), "decoded").toDF(*schema.names)
    tables.drop()
    return done


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again.

    The same steps as ``encode`` and ``decode``; only digests leave the task. ids_sha256 is over the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text in UTF-8.
    """
    path = path or default_tokenizer()

    def make(ids: np.ndarray, stop: np.ndarray, known: tuple[np.ndarray, pa.Array]) -> list[pa.Array]:
        edges = [0, *stop.tolist()]
        whole = memoryview(ids.view(np.uint8))
        shas = [hashlib.sha256(whole[4 * a : 4 * b]).hexdigest() for a, b in zip(edges, edges[1:])]
        decoded = join_pieces(known, ids, stop)
        return [pa.array(np.diff(edges), pa.int64()), pa.array(shas, pa.string()), pa.array([hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in decoded], pa.string())]

    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _joined_back(docs, [key], path, text, make, schema, True)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
