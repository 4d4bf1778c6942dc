"""Token files: encoded documents in Parquet with selective reads (operator 13).

``write`` encodes every whole text with the tokenizers library, appends an end id to
each document and writes the ids in ascending document order:

* ``tokens/``: one row a document ``(doc, n_tokens, part, part_start, ids)``.  Each
  file is one range of documents, sorted.  ``ids`` is a list column with dictionary
  encoding (a vocabulary of 50,000 ids needs at most 16 bits an id); the other
  columns, which ascend, are delta-packed.  Row groups (``ROW_GROUP`` bytes) and
  pages (``PAGE`` bytes, ``PAGE_ROWS`` rows) are small, and the page index is written,
  so a range of documents reads the pages it needs, and a reader of the metadata
  skips the ids altogether.
* ``manifest/``: one row a file: its documents, ids and the number of ids before it.

Starts are sums within a file, which its task knows as it writes, plus the file's
offset in the manifest; so nothing is counted over the whole table in one place.  The
driver sees one row of totals a file.

Texts are encoded part by part (``Encoder``): the split into pre-tokens has a border
before every run of white space, so the ids are those of the whole text.  A text longer
than ``LONG`` characters goes in pieces that end at such a border; so memory is bounded.

Cases: a null text is empty (its only id is the end id); rows of one id keep one row
each, in the order of a hash of their texts, null ids come first; an empty table gives
empty files and results; only the named columns are read, others of any name do no
harm.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

END = 0
LONG = 1_000_000  # characters of a text encoded at once
CHUNK = 2_500_000  # bytes of texts whose parts are looked up at once
KNOWN = 400_000  # parts remembered
JOINED = 200
ROW_GROUP = 16 << 20
PAGE = 64 << 10
PAGE_ROWS = 1_000
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": ROW_GROUP,
    "parquet.page.size": PAGE,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "snappy",
}

_BLANK = "\u0120"  # a blank at the start of a token, in byte-level alphabets
_LINE = "\u010a"
#: White space besides blanks and line breaks.
_OTHER = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """The library's ids of whole texts, by way of the parts between blanks.

    The split into pre-tokens has a border wherever white space follows anything else, so
    a text's ids are those of its parts, each white space with the word after it.  Parts
    are encoded by the library once and remembered (``KNOWN`` of them, as Arrow strings
    and a flat array of ids); new parts go to it ``JOINED`` at a time as one text, whose
    tokens that begin with a blank (or line break) tell where each part begins.  Texts
    with other white space than single blanks and line breaks are encoded as they are.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True  # the strings of special tokens are ordinary text
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        first = np.zeros(max(vocabulary.values()) + 1, bool)
        first[[i for t, i in vocabulary.items() if t.startswith(_BLANK)]] = True
        line = np.zeros_like(first)
        if _LINE in vocabulary:
            line[vocabulary[_LINE]] = True
        self.starts = {" ": first, "\n": line}
        self._forget()

    def _forget(self) -> None:
        self.parts = pa.array([], pa.string())  # behind a blank, or beginning with a line break
        self.size = np.empty(0, np.int64)  # ids of a part; -1: there is no border behind it
        self.ids = np.empty(0, np.int32)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.StringArray) -> None:
        line = pc.starts_with(new, "\n")
        loose = pc.or_(pc.or_(pc.equal(new, ""), pc.ends_with(new, "\n")), pc.match_substring_regex(new, _OTHER))
        parts, size, ids = [new.filter(loose)], [np.full(pc.sum(loose).as_py() or 0, -1)], []
        for sep, mine in (("\n", line), (" ", pc.invert(line))):
            words = new.filter(pc.and_not(mine, loose))
            cut = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), words), sep.replace("\n", "")).to_pylist()
            coded = self._plain([(" " if sep == " " else "") + t for t in joined])
            for lo, hi, got in zip(cut.tolist(), cut[1:].tolist(), coded):
                begin = np.flatnonzero(self.starts[sep][got])
                if len(begin) != hi - lo or begin[0]:  # not as expected: one by one
                    each = self._plain([p if sep == "\n" else " " + p for p in words[lo:hi].to_pylist()])
                    begin, got = np.cumsum([0, *map(len, each)])[:-1], np.concatenate(each)
                size.append(np.diff(begin, append=len(got)))
                ids.append(got)
            parts.append(words)
        self.parts = pa.concat_arrays([self.parts, *parts])
        self.size, self.ids = np.concatenate([self.size, *size]).astype(np.int64), np.concatenate([self.ids, *ids])

    def _codes(self, parts: pa.StringArray) -> np.ndarray:
        """Places of ``parts`` among the known ones, which come to hold them all."""
        coded = parts.dictionary_encode()
        different = coded.dictionary
        at = pc.fill_null(pc.index_in(different, value_set=self.parts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = at < 0
        if missing.any():
            new = different.filter(pa.array(missing))
            known = len(self.parts)
            if known and known + len(new) > KNOWN:
                self._forget()
                return self._codes(parts)
            self._learn(new)
            at[missing] = known + pc.index_in(new, value_set=self.parts.slice(known)).to_numpy(zero_copy_only=False)
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, in a row, and their numbers."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        upto = lists.offsets.to_numpy().astype(np.int64)
        parts, upto = lists.values.slice(upto[0], upto[-1] - upto[0]), upto - upto[0]
        heads = upto[:-1]
        codes = self._codes(parts)
        # a text begins without a blank, and its first part may be empty
        first = parts.take(pa.array(heads)).to_pylist()
        bad = (self.size < 0)[codes]
        bad[heads] = [p[-1:].isspace() for p in first]
        odd = np.add.reduceat(bad, heads) > 0
        begin = {p: i for i, p in enumerate(dict.fromkeys(p for p, o in zip(first, odd) if not o))}
        whole = [np.concatenate([np.empty(0, np.int32), *(self._plain([p])[0] for p in pieces(texts[i].as_py(), LONG))]) for i in np.flatnonzero(odd).tolist()]
        extra = [*self._plain(list(begin)), *whole, np.array([end], np.int32)]
        known = len(self.size)
        codes[heads] = [known + begin.get(p, 0) for p in first]
        codes[heads[odd]] = known + len(begin) + np.arange(len(whole))  # an odd text is one part
        keep = ~np.repeat(odd, np.diff(upto))
        keep[heads] = True
        ends = np.cumsum(np.where(odd, 1, np.diff(upto)))
        codes = np.insert(codes[keep], ends, known + len(extra) - 1)
        size = np.concatenate([np.maximum(self.size, 0), [len(x) for x in extra]])
        ids, offset = np.concatenate([self.ids, *extra]), np.cumsum(size) - size
        each = size[codes]
        past = np.cumsum(each)
        out = ids[np.repeat(offset[codes] - (past - each), each) + np.arange(past[-1])]
        return out, np.diff(past[ends + np.arange(len(ends))], prepend=0)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """The encoder of a tokenizer's JSON, made once a worker."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def pieces(text: str, most: int = LONG) -> list[str]:
    """``text`` cut before blanks that follow a word, into pieces of about ``most`` characters."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def spans(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts of about ``CHUNK`` bytes."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // CHUNK
    at = np.flatnonzero(np.diff(group, prepend=-1))
    yield from zip(at.tolist(), np.diff(np.append(at, len(texts))).tolist())


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Token files of ``docs`` under the folder ``path`` (``files`` of them; else as many as the session shuffles into).

    ``tokenizer`` is a file of the tokenizers library.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    d = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    d = (d.repartitionByRange(files, "doc", "h") if files else d.repartitionByRange("doc", "h")).sortWithinPartitions("doc", "h").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = _encoder(spec), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, n_rows in spans(b.column(1)):
                ids, n = enc.encode(b.column(1).slice(lo, n_rows), end)
                upto = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(n)), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(start + upto[:-1]), lists],
                    names=["doc", "n_tokens", "part", "part_start", "ids"])
                start += int(upto[-1])

    kind = d.schema["doc"].dataType.simpleString()
    d.mapInArrow(run, f"doc {kind}, n_tokens bigint, part int, part_start bigint, ids array<int>") \
        .write.mode("overwrite").options(**WRITER).parquet(f"{path}/tokens")
    # one row a file
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).collect()
    rows, start = [], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        rows.append((r["part"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    spark.createDataFrame(rows, "part int, n_docs long, n_tokens long, start long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def _placed(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """With the global start in place of the file's; the manifest has one row a file."""
    starts = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("file_start"))
    return files.join(starts, "part").withColumn("start", F.col("file_start") + F.col("part_start")).drop("part", "part_start", "file_start")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, n_tokens, start)`` of every document; the ids are not read."""
    return _placed(spark, path, spark.read.parquet(f"{path}/tokens").drop("ids"))


def read_tokens(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """``(doc, n_tokens, ids, start)`` of the documents ``first`` to ``last`` (all of them by default).

    The bounds reach the scan, which skips files, row groups and pages by their statistics.
    """
    files = spark.read.parquet(f"{path}/tokens")
    if first is not None:
        files = files.where(F.col("doc") >= F.lit(first))
    if last is not None:
        files = files.where(F.col("doc") <= F.lit(last))
    return _placed(spark, path, files)


def digests(tokens: DataFrame) -> DataFrame:
    """``(doc, start, n_tokens, ids_crc32)`` of ``tokens(doc, start, ids)``: counts and checksums of the ids themselves."""
    kind = tokens.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            upto, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(upto[:-1], upto[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(upto).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc", "start", "ids").mapInArrow(run, f"doc {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
