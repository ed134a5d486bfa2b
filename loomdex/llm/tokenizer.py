"""Encoding and decoding of a whole corpus with a public byte-level tokenizer.

Encoding never runs the merge procedure on a text. Texts are cut into pre-tokens once and held as blocks: the distinct words of
the block and, for each text, the codes of its words in order (words exploded with their positions, grouped within the block
before anything is shuffled). The words of all blocks are shuffled, each distinct word is encoded once, its ids are joined back
to the blocks that hold it, and each block puts the ids in place by position. A word that is in every text is shuffled once per
block, not once per occurrence.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.session import written

#: Where the public vocabulary files lie, unless an argument or the session's setting says otherwise.
TOKENIZERS, SETTING = "/opt/tokenizers", "spark.loomdex.tokenizers"


def vocabulary_folder(spark: SparkSession, folder: str | None = None) -> str:
    return folder or spark.conf.get(SETTING, None) or TOKENIZERS


#: How the vocabulary cuts a text into pre-tokens (fixed value, published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A block ends with the text in which it passes so many tokens: bounds its memory and the number of times a word is shuffled.
BLOCK_WORDS = 400_000


class Vocabulary:
    """Ranks of a .tiktoken file, of a fixed size (about 50,000 entries), read on the driver and sent to the workers."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            self.raw = f.read()
        self.name = name

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines()) if a}

    def encoder(self):
        """A function from the UTF-8 bytes of one pre-token to its ids."""
        import tiktoken

        return tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=self.ranks(), special_tokens={})._encode_single_piece

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens one after another, and where each begins."""
        ranks = self.ranks()
        by_id = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            by_id[i] = b
        return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in by_id])])


def cutter():
    """A function from a text to its pre-tokens; joined they are the text."""
    return regex.compile(PATTERN).findall


def gather_lists(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number `codes` one after another, and the length of each. List i is flat[starts[i]:starts[i + 1]]."""
    n = (starts[1:] - starts[:-1])[codes]
    if not len(codes):
        return flat[:0], n
    ends = np.cumsum(n)
    at = np.repeat(starts[:-1][codes] - (ends - n), n) + np.arange(ends[-1])
    return flat[at], n


def _blocks(block_words: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, seq = cutter(), TaskContext.get().partitionId(), 0
        ids, sizes, codes, held = [], [], [], 0
        words: defaultdict = defaultdict()
        words.default_factory = words.__len__

        def out() -> pa.RecordBatch:
            kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
            c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 33 | seq], pa.int64()),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([c.astype(kind).tobytes()], pa.binary()),
                    pa.array([list(words)], pa.list_(pa.string())),
                ],
                ["block", "ids", "sizes", "codes", "words"],
            )

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                w = cut(text) if text else []
                ids.append(i)
                sizes.append(len(w))
                if w:
                    codes.append(np.fromiter(map(words.__getitem__, w), np.uint32, len(w)))
                held += len(w) + 1
                if held >= block_words:
                    yield out()
                    seq += 1
                    ids, sizes, codes, held = [], [], [], 0
                    words = defaultdict()
                    words.default_factory = words.__len__
        if ids:
            yield out()

    return run


def _encode_words(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.value.encoder()
        for b in batches:
            ids = [encode(w.encode()) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "word_ids"])

    return run


def _reassemble(id_type: pa.DataType, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                sizes = b.column("sizes")[r].values.to_numpy(zero_copy_only=False)
                table, raw = b.column("dictionary")[r].values, b.column("codes")[r].as_py()
                if table is None or not len(table):
                    flat, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
                else:
                    lists = table.field("word_ids") if table.offset == 0 and len(table.field("word_ids")) == len(table) else table.flatten()[1]
                    flat = lists.flatten().to_numpy(zero_copy_only=False)
                    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                codes = np.frombuffer(raw, np.uint16 if len(starts) - 1 <= 1 << 16 else np.uint32)
                values, n = gather_lists(flat, starts, codes)
                before = np.concatenate([[0], np.cumsum(n)])  # ids before each word
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                ids = b.column("ids")[r].values.cast(id_type)
                # a block is a batch: its size is bounded by `block_words` and one text
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), pa.array(values.astype(np.int32)))], [id_name, "ids"])

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, name: str = "byte_bpe_50k", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; their strings in a text are ordinary text.

    The blocks are written when this is called. Null and empty texts have an empty list. Repeated ids and texts give a row each; a null id stays null. Other columns aren't read,
    so their names don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_sql = d.schema["id"].dataType.simpleString()
    id_type = pa.int64() if id_sql in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if id_type == pa.int64():
        d = d.withColumn("id", F.col("id").cast("bigint"))
    else:
        d = d.withColumn("id", F.col("id").cast("string"))
    sql = "bigint" if id_type == pa.int64() else "string"
    blocks = written(d.mapInArrow(_blocks(block_words, id_type), f"block long, ids array<{sql}>, sizes array<int>, codes binary, words array<string>"), "blocks")
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_folder(spark, folder), name))  # about 1 MB whatever the corpus
    held = blocks.select("block", F.posexplode("words").alias("at", "word"))
    dictionary = held.select("word").distinct().mapInArrow(_encode_words(vocabulary), "word string, word_ids array<int>")
    joined = held.join(dictionary, "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "word_ids"))).alias("dictionary"))
    whole = blocks.select("block", "ids", "sizes", "codes").join(joined, "block", "left").select("ids", "sizes", "codes", "dictionary")
    return whole.mapInArrow(_reassemble(id_type, id_col), f"`{id_col}` {sql}, ids array<int>").withColumn(id_col, F.col(id_col).cast(id_sql))


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str | None = None, name: str = "byte_bpe_50k", text_col: str = "text") -> DataFrame:
    """(id, text) of lists of ids: each id is joined with the token-byte table, about 1 MB, which every worker holds as an array by id. An empty
    list gives an empty text, null gives null."""
    spark = encoded.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_folder(spark, folder), name))
    id_sql = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts = vocabulary.value.pieces()
        for b in batches:
            lists = b.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            data, n = gather_lists(flat, starts, values)
            before = np.concatenate([[0], np.cumsum(n)])
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = before[np.concatenate([[0], np.cumsum(lengths)])]
            raw = data.tobytes()
            nulls = lists.is_null().to_pylist()
            texts = [None if nulls[i] else raw[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i in range(len(nulls))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, text_col])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_sql}, `{text_col}` string")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", folder: str | None = None, name: str = "byte_bpe_50k", memo: int = 500_000) -> DataFrame:
    """The columns `keep` and n_tokens of each row; null and empty texts have none. Each worker keeps the sizes of words it has met."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_folder(spark, folder), name))
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut = vocabulary.value.encoder(), cutter()

        class Sizes(dict):
            def __missing__(self, w):
                if len(self) > memo:
                    self.clear()
                self[w] = n = len(encode(w.encode()))
                return n

        sizes = Sizes()
        for b in batches:
            n = [sum(map(sizes.__getitem__, cut(t))) if t else 0 for t in (x.as_py() for x in b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, F.col(text_col).alias("_text_")).mapInArrow(run, f"{types}, n_tokens bigint")
