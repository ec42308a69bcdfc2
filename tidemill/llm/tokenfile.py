"""Operator 8: token ids in binary files with Elias-Fano document boundaries.

A file holds a stretch of documents in ascending id: a header, the document ids and the
document ends as Elias-Fano sequences, then one array of token ids. An Elias-Fano sequence
keeps the low bits of each number as they are and the high bits in unary, about
2 + log2(u / n) bits a number; a small select table over the unary part finds the i-th
number, or a run of numbers from there, without decoding the others.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import arrow_batches, pieces

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC = b"TIDEIDS1"
SELECT_STEP = 256
CACHE_WORDS = 300_000
#: Letters that the library's normaliser lower-cases at most, wherever they stand: printable ASCII and the letters of Latin-1.
PLAIN = "".join(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]))
PLAIN_WORD = "^[!-~\u00c0-\u00ff]+$"
#: Stands between new words that go to the library together, so many in a text.
MARK, TOGETHER = "\0", 200
#: Bytes of text that a range of documents has, about, and bytes of ids at which a file is closed.
RANGE_BYTES, FILE_BYTES = 64 << 20, 64 << 20
#: Bytes of text whose words are told apart at a time: the more, the fewer.
WORDS_BYTES = 4 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, jumps: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.jumps = n, low_bits, low, high, jumps

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits and n:
            low = np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SELECT_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.jumps)) + self.low.tobytes() + self.high.tobytes() + self.jumps.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``data``, and its length in bytes."""
        n, bits, low, high, jumps = struct.unpack_from("<QIIII", data)
        at = 24
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (jumps, "<u4")):
            width = np.dtype(kind).itemsize * size
            parts.append(np.frombuffer(data[at : at + width], kind))
            at += width
        return cls(n, bits, *parts), at

    def select(self, i: int) -> int:
        """The i-th number: the jump table gives a one near it, the bits from there are counted."""
        at, left = int(self.jumps[i // SELECT_STEP]), i % SELECT_STEP
        byte = at // 8
        chunk = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        chunk[: at % 8] = 0
        while (ones := np.flatnonzero(chunk)).size <= left:
            left -= ones.size
            byte += 64
            chunk = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        one = byte * 8 + int(ones[left])
        low = 0
        for b in range(self.low_bits):
            bit = i * self.low_bits + b
            low |= (int(self.low[bit // 8]) >> bit % 8 & 1) << b
        return (one - i) << self.low_bits | low

    def run(self, start: int, stop: int) -> np.ndarray:
        """The numbers from ``start`` up to ``stop``, read between two entries of the jump table."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first, behind = start // SELECT_STEP, (stop - 1) // SELECT_STEP + 1
        at = int(self.jumps[first])
        end = int(self.jumps[behind]) if behind < len(self.jumps) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8 : -(-end // 8)], bitorder="little")
        bits[: at % 8] = 0
        skip = start - first * SELECT_STEP
        ones = np.flatnonzero(bits)[skip : skip + stop - start] + at // 8 * 8
        high = (ones - np.arange(start, stop)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        first_bit = start * self.low_bits
        low = np.unpackbits(self.low[first_bit // 8 : -(-stop * self.low_bits // 8)], bitorder="little")[first_bit % 8 :]
        low = low[: (stop - start) * self.low_bits].reshape(stop - start, self.low_bits)
        return high | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def all(self) -> np.ndarray:
        """All numbers."""
        return self.run(0, self.n)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """One file: documents in ascending id with their numbers of tokens, and all token ids of ``width`` bytes each."""
    first = int(doc_ids[0]) if len(doc_ids) else 0
    parts = [EliasFano.of(np.asarray(doc_ids, np.int64) - first).to_bytes(), EliasFano.of(np.cumsum(lengths)).to_bytes()]
    return MAGIC + struct.pack("<qIQQ", first, width, len(parts[0]), len(parts[1])) + b"".join(parts) + ids


class TokenFile:
    """A file that has been read: ``docs``, ``ends`` and ``ids``."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.first, width, a, b = struct.unpack_from("<qIQQ", data, 8)
        at = 8 + struct.calcsize("<qIQQ")
        view = memoryview(data)
        self.docs, self.ends = EliasFano.from_bytes(view[at : at + a])[0], EliasFano.from_bytes(view[at + a : at + a + b])[0]
        self.ids = np.frombuffer(view[at + a + b :], f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        """Token ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


@lru_cache(maxsize=2)
def word_ids(path: str, width: int) -> WordIds:
    """One for all tasks of a Python worker, which meet the same words."""
    return WordIds(path, width)


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    """The library's tokenizer, once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def plain_words(path: str) -> tuple[str, Tokenizer, np.ndarray] | None:
    """For words of ``PLAIN``: the file's pattern of pre-tokens, the library without its normaliser, and which ids end a pre-token.

    None if the file's normaliser does more to these letters than lower-case them, or its pattern cuts otherwise here than in the library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole, suffix, split = library(path), spec["model"].get("end_of_word_suffix"), (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    pattern, probe = split.get("pattern", {}).get("Regex"), PLAIN.lower() + "'s'lla'd12ab--\u00e97'\u00f7'very'"
    if not suffix or not pattern or whole.normalizer is None or whole.normalizer.normalize_str(PLAIN) != PLAIN.lower():
        return None
    try:
        cut = pc.split_pattern(pc.replace_substring_regex(pa.array([probe]), pattern, r"\0 "), " ")[0].as_py()
    except pa.ArrowInvalid:
        return None
    if [x for x in cut if x] != [probe[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(probe)]:
        return None
    bare = type(whole)(whole.model)  # the same model, kept once
    bare.pre_tokenizer = whole.pre_tokenizer
    ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
    ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
    return pattern, bare, ends


def listed(words: pa.StringArray) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # as to_pylist(), which takes ten times as long


def joined(values: pa.LargeBinaryArray, offsets: pa.Array) -> pa.LargeBinaryArray:
    """The values of each list in one; ``values`` are those of all lists, newly made, and ``offsets`` tell where lists end."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)[np.asarray(offsets)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), values.buffers()[2]])


class WordIds:
    """Ids of whole texts. ASCII white space always separates words, and is dropped.

    Plain words are lower-cased and cut into their pre-tokens, of which there are far fewer, and the library encodes each
    pre-token that is new; other words go to the library whole. What it gave is kept in two generations: what is met again moves
    to the recent one, so common words are never encoded twice. Both go to the library many in a text, as a call for each costs more
    than the word: pre-tokens are told apart by their last ids, words by a mark between them.
    """

    def __init__(self, vocabulary: str, width: int) -> None:
        self.encode, self.width, self.recent, self.older = library(vocabulary).encode_batch_fast, width, {}, {}
        self.added = [t.content for t in library(vocabulary).get_added_tokens_decoder().values()]
        self.plain = plain_words(vocabulary)
        mark = self.ids([MARK])[0]
        self.mark = int.from_bytes(mark, "little") if len(mark) == width else None

    def packed(self, encodings: list) -> list[bytes]:
        return [array("H" if self.width == 2 else "I", e.ids).tobytes() for e in encodings]

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.packed(self.encode(texts, add_special_tokens=False))

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words in a text that the mark does not cut into just these words are encoded one by one."""
        if self.mark is None:
            return self.ids(words)
        out, step = [], self.width
        cuts = range(0, len(words), TOGETHER)
        for at, ids in zip(cuts, self.ids([f" {MARK} ".join(words[k : k + TOGETHER]) for k in cuts]), strict=True):
            marks = (np.flatnonzero(np.frombuffer(ids, f"<u{step}") == self.mark) * step).tolist()
            some = words[at : at + TOGETHER]
            if len(marks) == len(some) - 1 and not any(MARK in w for w in some):
                out += [ids[a:b] for a, b in zip([0, *(m + step for m in marks)], [*marks, len(ids)], strict=True)]
            else:
                out += self.ids(some)
        return out

    def of_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token of plain words; those in a text whose ids do not end as many pre-tokens are encoded one by one."""
        _, bare, ends = self.plain
        out, cuts = [], range(0, len(tokens), TOGETHER)
        for at, ids in zip(cuts, self.packed(bare.encode_batch_fast([" ".join(tokens[k : k + TOGETHER]) for k in cuts], add_special_tokens=False)), strict=True):
            stops = ((np.flatnonzero(ends[np.frombuffer(ids, f"<u{self.width}")]) + 1) * self.width).tolist()
            some = tokens[at : at + TOGETHER]
            if len(stops) == len(some) and stops[-1] == len(ids):
                out += [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            else:
                out += self.ids(some)
        return out

    def learn(self, tokens: list[str], words: list[str]) -> None:
        """Has ids for these pre-tokens and words in ``recent``."""
        met = {*tokens, *words}
        new = met.difference(self.recent)
        if len(self.recent) + len(new) > CACHE_WORDS:
            self.older, self.recent = self.recent, {}
            new = met
        kept = new.intersection(self.older)
        self.recent.update((w, self.older[w]) for w in kept)
        self.recent[""] = b""
        for encode, units in ((self.of_tokens, tokens), (self.of_words, words)):
            rest = [w for w in units if w not in self.recent]
            for at in range(0, len(rest), 20_000):
                some = rest[at : at + 20_000]
                self.recent.update(zip(some, encode(some), strict=True))

    def is_plain(self, words: pa.StringArray) -> pa.BooleanArray:
        """Whether a word has letters of ``PLAIN`` only, and no added token in either case."""
        if self.plain is None:
            return pa.array(np.zeros(len(words), bool))
        found = pc.match_substring_regex(words, PLAIN_WORD)
        if self.added:
            found = pc.and_not(found, pc.match_substring_regex(words, "|".join(map(re.escape, self.added)), ignore_case=True))
        return found

    def batch(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        plain = self.is_plain(words)
        lower = pc.utf8_lower(words.filter(plain))
        cut = pc.split_pattern(pc.replace_substring_regex(lower, self.plain[0], r"\0 ") if self.plain else lower, " ")
        parts = cut.flatten().dictionary_encode()
        tokens, others = listed(parts.dictionary), listed(words.filter(pc.invert(plain)))
        self.learn(tokens, others)
        known = lambda units: pa.array(list(map(self.recent.__getitem__, units)), pa.large_binary())
        ids = pa.concat_arrays([joined(known(tokens).take(parts.indices), cut.offsets), known(others)])
        first = plain.to_numpy(zero_copy_only=False)
        place = np.where(first, np.cumsum(first) - 1, len(lower) + np.cumsum(~first) - 1)
        return joined(ids.take(pa.array(place[np.asarray(coded.indices)], pa.int64())), lists.offsets).to_pylist()


def id_width(vocabulary: str) -> int:
    """Bytes that an id of this vocabulary takes."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return 2 if top < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes files of documents in ascending id.

    Returns a row for each file: ``file`` (its name), ``documents``, ``tokens``, ``first_doc``.
    Null texts count as empty and hold the end id only; rows without an id are left out, as they
    have no place in the order; repeated ids follow one another. The size of all texts gives the
    number of ranges (or ``files`` does), and a range that grows beyond ``FILE_BYTES`` goes on in a further
    file, so a task never holds more. An empty table leaves an empty folder.
    A task that is run again writes the same files anew; each takes its final name when complete.
    """
    width, spark = id_width(vocabulary), docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    spark.createDataFrame([], "nothing int").write.mode("append").parquet(path)  # the folder is there, whatever comes
    schema = pa.schema([("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(vocabulary, width), np.array([end_id], f"<u{width}").tobytes()
        doc_ids, lengths, parts, held, files = [], [], [], 0, 0

        def save() -> pa.RecordBatch:
            nonlocal held, files
            store, folder = fs.FileSystem.from_uri(path)
            name = f"ids-{doc_ids[0] + (1 << 63):020d}-{doc_ids[-1] + (1 << 63):020d}-{files:06d}.bin"
            partial = f"{folder}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(partial) as out:
                out.write(pack(np.array(doc_ids), np.array(lengths), b"".join(parts), width))
            store.move(partial, f"{folder}/{name}")
            made = pa.RecordBatch.from_pydict({"file": [name], "documents": [len(doc_ids)], "tokens": [int(sum(lengths))], "first_doc": [doc_ids[0]]}, schema=schema)
            for held_list in (doc_ids, lengths, parts):
                held_list.clear()
            held, files = 0, files + 1
            return made

        for batch in pieces(batches, WORDS_BYTES):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.batch(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                parts += [ids, end]
                lengths.append(len(ids) // width + 1)
                held += len(ids) + width
                if held >= FILE_BYTES:
                    yield save()
        if doc_ids:
            yield save()

    return arrow_batches(ordered).mapInArrow(run, "file string, documents bigint, tokens bigint, first_doc bigint")


def read_token_files(spark: SparkSession, path: str, block: int = 1000) -> DataFrame:
    """Reads the files of a folder: ``file``, ``doc_id``, ``local_start`` (ids before it in its file), ``n_tokens``, ``ids`` and ``ids_crc32``.

    The boundaries of ``block`` documents at a time come from the select structure.
    """
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(data.as_py())
                for at in range(0, file.docs.n, block):
                    stop = min(at + block, file.docs.n)
                    ends = file.ends.run(at, stop)
                    starts = np.concatenate(([file.ends.select(at - 1) if at else 0], ends[:-1]))
                    ids = [file.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(ids), "doc_id": file.docs.run(at, stop) + file.first, "local_start": starts, "n_tokens": ends - starts, "ids": ids, "ids_crc32": [zlib.crc32(x) for x in ids]}, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, doc_id bigint, local_start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def with_starts(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds to each document ``start``, the ids of all documents before it. ``files`` has one row for each file.

    Ranges of the files do not overlap, so their names sort them; a running sum over that short list is all.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("before"))
    return docs.join(starts, "file").withColumn("start", F.col("before") + F.col("local_start"))
