"""Token-ID output: tokenise documents, write their ids as a Parquet table, read it selectively.

File format: one Parquet table of rows in ascending doc_id order, `part`-th file first to last, with
  doc_id long, part int, local_start long (ids of the rows before it in its part), n_tokens long,
  ids list<int>.
Ids are dictionary-encoded (a 49k vocabulary needs 16 bits an id), the ascending long columns are
delta-encoded (data pages of format 2, no dictionary), row groups and pages have set sizes, and the page
index lets a reader take the metadata columns, or the ids of some documents, without the other pages.
A document's start in the whole stream is the sum of the parts before plus local_start.

Tokenising: white space never stands inside a token of this kind of tokenizer and no token depends on
what is beyond white space, so each distinct chunk between white space is encoded once for a batch and
kept in a bounded memo. A text of plain Latin letters, digits and marks is lower-cased and its marks are
set apart beforehand, as the tokenizer does it, so that fewer chunks differ; a plain chunk is cut into the
tokenizer's own pre-tokens, which go to its model; every other chunk (apostrophes, special-token strings, other
scripts, combining marks) goes through the whole tokenizer. If the tokenizer is of another kind, whole
texts are encoded.

Defined cases: null and empty texts hold the end id alone; repeated rows and equal doc_ids stay, ordered
by doc_id (null first), then by text; an empty table writes an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import give_back, in_arrow, kept, scratch_path

END_ID = 1
MEMO, MEMO_CHARS = 400_000, 64
SLAB_BYTES = 1 << 22
_LETTERS = "a-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
#: Fixed value: the pre-token pattern for which chunks are cut here; other patterns take the slow way.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(rf"(?!.*<\|)[!-&(-~{_LETTERS}{_DIGITS}]*", re.S)
#: The same for whole texts, in RE2's spelling, and the marks that part such a text's words.
_PLAIN_TEXT = rf"^[\t\n\v\f\r !-&(-~{_LETTERS}{_DIGITS}]*$"
_MARKS = r"([!-/:-@\[-`{-~]+)"
_PIECE = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts, by chunks where the tokenizer allows it."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = (
            (steps[0].get("pattern") or {}).get("Regex") == WORD_PATTERN
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and spec.get("post_processor") is None
        )
        # two generations of half the memo each: when the new one is full it becomes the old one, whose chunks come back
        # as they are asked for, so that frequent ones stay
        self.limit = max(1, memo // 2)
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.alphabet = _byte_characters()
        self.spelled = [k.to_bytes(4, "little") for k in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        code = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        spelled = self.spelled
        return b"".join([spelled[t.id] for t in self.model.tokenize(code)])

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. One loop without calls of its own: most of the time goes into rare words."""
        found = list(map(self.chunks.get, chunks))
        tokenize, spelled, join, older = self.model.tokenize, self.spelled, b"".join, self.older.get
        for k, chunk in enumerate(chunks):
            if found[k] is not None:
                continue
            ids = older(chunk)
            if ids is None:
                if chunk.isascii() and chunk.isalpha():
                    ids = join([spelled[t.id] for t in tokenize(chunk.lower())])
                elif _PLAIN.fullmatch(chunk):
                    ids = join(map(self._piece, _PIECE.findall(chunk.lower())))
                else:
                    ids = self._whole(chunk)
            if len(chunk) <= MEMO_CHARS:
                if len(self.chunks) >= self.limit:
                    self.older, self.chunks = self.chunks, {}
                    older = self.older.get
                self.chunks[chunk] = ids
            found[k] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids in each text)."""
        if not self.by_chunk:
            each = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64)
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN_TEXT), pc.invert(pc.match_substring(texts, "<|")))
        parts = pc.ascii_split_whitespace(pc.if_else(plain, pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, r" \1 "), texts))
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        found = self._look_up(chunks)
        pool = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        per = sizes[which]
        until = np.concatenate([[0], np.cumsum(per)])
        at = np.repeat((begins[which] - until[:-1]).astype(np.int32), per)  # a slab's ids are fewer than 2^31
        at += np.arange(len(at), dtype=np.int32)
        return pool[at], until[edges[1:]] - until[edges[:-1]]


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process: its memo serves one task after another, until another operator's task comes."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end_id` after each document's."""
    out = np.empty(len(ids) + len(sizes), np.int32)
    ends = np.cumsum(sizes + 1) - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[ends] = end_id
    out[mask] = ids
    return out, sizes + 1


def slabs(column: pa.Array, size: int = SLAB_BYTES):
    """(from, to) row ranges of about `size` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for k, n in enumerate(lengths):
        total += int(n)
        if total >= size:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Rows of SCHEMA, dealt and sorted in ascending doc_id order."""

    def run(batches):
        from pyspark import TaskContext

        encoder, part, start = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in slabs(texts):
                ids, sizes = with_end(*encoder.encode(texts.slice(a, b - a)), end_id)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(edges[:-1] + start), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)
                start += int(edges[-1])
                del ids, sizes, lists, columns
            give_back()  # else allocators hold as much as the memo itself

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    return in_arrow(rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text")), run, SCHEMA, keeps=True)


def write_tokens(tokens: DataFrame, path: str, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    writer = tokens.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    for c in ("doc_id", "local_start"):
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(stored: DataFrame) -> DataFrame:
    """part, part_start: one row for each file part, that is at most one for each writing task."""
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            edges, values = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            sizes = np.diff(edges).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    read = in_arrow(stored.select("doc_id", "part", "local_start", "n_tokens", "ids"), run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    placed = read.join(F.broadcast(starts(stored)), "part")
    return placed.select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of `docs` to `path` (the shared folder by default) and return the stored rows."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(tokenize(docs, tokenizer_path, end_id), path)
    return read_tokens(spark, path)
