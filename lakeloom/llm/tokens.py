"""Encoding of a corpus with a public tokenizer through a distinct-word table.

The text is split into the tokenizer's words in the JVM.  Every distinct word is
encoded once; its ids come back to the positions by a join.  The word table
grows with the corpus (slowly), so only its most frequent part, of a bounded
size, is broadcast; words beyond it come back by a shuffled join.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import Scratch

TOKENIZERS = os.environ.get("LAKELOOM_TOKENIZERS", "/opt/tokenizers")

#: White space as the tokenizer's pattern understands it (fixed values).
SPACE = r"\t-\r \x85\xA0  -     　"
#: The tokenizer's word pattern in the JVM's notation (fixed values), with the classes of letters and of numbers left open.
WORDS = (
    r"'(?:s|t|re|ve|m|ll|d)| ?+{letters}++| ?+{numbers}++| ?+[^" + SPACE + r"{other}]++|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]++"
)

#: Bounds of the broadcast part of the word table: words, and bytes of one word.  A word has at most as many ids as
#: bytes, so the table is below 400,000 x (48 + 4 x 48 + 8) bytes, 100 MB, for a corpus of any size.
BROADCAST_WORDS = 400_000
BROADCAST_WORD_BYTES = 48


def _ranges(chars: set[str]) -> str:
    """A set of characters as ranges of a JVM character class."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


@functools.lru_cache(maxsize=4)
def _members(kind: str) -> str:
    """All characters that the tokenizer's own pattern engine counts to a class."""
    import tiktoken

    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    bytes_only = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(bytes_only.encode_ordinary(every)).decode()


def _pattern(letters: str, numbers: str, other: str) -> str:
    return WORDS.replace("{letters}", letters).replace("{numbers}", numbers).replace("{other}", other)


#: The word pattern of a JVM whose Unicode version is the tokenizer's.  A class of one property is matched faster
#: than a union; where it is negated, the common ranges come first.
PLAIN_WORDS = _pattern(r"\p{L}", r"\p{N}", r"A-Za-z0-9\p{L}\p{N}")
_PATTERNS: dict[str, tuple[str, str, str]] = {}


def word_patterns(spark: SparkSession) -> tuple[str, str, str]:
    """(pattern, odd, above) for what this JVM's Unicode version knows differently from the tokenizer's.

    ``odd``: the class of those characters, ``above``: that of all from the first
    of them on, a cheap first look; ``pattern`` puts them right.  One call sends
    the tokenizer's letters (numbers) to the JVM's matcher, which gives back those
    it doesn't know; a second finds those that only the JVM knows.
    """
    jvm = spark._jvm
    version = jvm.java.lang.System.getProperty("java.version")
    if version not in _PATTERNS:
        parts, more, less, odd = {}, "", "", set()
        every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
        for name, kind, plain in (("letters", r"\p{L}", r"A-Za-z\p{L}"), ("numbers", r"\p{N}", r"0-9\p{N}")):
            own = _members(kind)
            unknown = set(jvm.java.util.regex.Pattern.compile(kind).matcher(own).replaceAll(""))
            others = every.translate(dict.fromkeys(map(ord, own)))
            beyond = set(jvm.java.util.regex.Pattern.compile(kind.replace("p", "P", 1)).matcher(others).replaceAll(""))
            add, cut = _ranges(unknown), _ranges(beyond)
            parts[name] = f"[{plain}{add}]" if not cut else f"[{plain}{add}&&[^{cut}]]"
            more, less, odd = more + plain + add, less + cut, odd | unknown | beyond
        pattern = _pattern(parts["letters"], parts["numbers"], more)
        if less:
            pattern = pattern.replace(f"[^{SPACE}{more}]", f"(?:[^{SPACE}{more}]|[{less}])")
        first = min(map(ord, odd), default=0x10FFFF)
        _PATTERNS[version] = (pattern, f"[{_ranges(odd)}]" if odd else "", rf"[\x{{{first:X}}}-\x{{10FFFF}}]")
    return _PATTERNS[version]


def words(text: Column, spark: SparkSession | None = None) -> Column:
    """The words of a text in order; together they are the text.  Null gives null.

    Only a text with a character that the JVM knows differently takes the longer pattern.
    """
    pattern, odd, above = word_patterns(spark or SparkSession.active())
    plain = F.regexp_extract_all(text, F.lit(PLAIN_WORDS), F.lit(0))
    if not odd:
        return plain
    wide = F.octet_length(text) != F.length(text)
    # The range is looked at first; the class, of hundreds of ranges, only for a character within it.
    return F.when(wide & text.rlike(f"[{above[1:-1]}&&{odd}]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(plain)


@functools.lru_cache(maxsize=4)
def encoding(name: str, folder: str):
    """A byte-level BPE by its rank file, without special tokens."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=r"\p{L}+|[^\p{L}]+", mergeable_ranks=ranks, special_tokens={})


def encode_words(df: DataFrame, name: str, folder: str) -> DataFrame:
    """(word, n) with the ids of each word; a word is merged as one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        one = enc._encode_single_piece
        for b in batches:
            ids = [one(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"]
            )

    return df.mapInArrow(run, "word string, n long, ids array<int>")


def word_table(docs: DataFrame, scratch: Scratch, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Saved table (word, n, ids) of all distinct words of all texts."""
    counted = docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return scratch.save(encode_words(counted, name, folder), "words")


def split_table(table: DataFrame, limit: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame | None]:
    """(frequent, rest): the frequent part is bounded in rows and in bytes of a row.

    ``rest`` is None when the bound holds for the whole table.
    """
    short = table.where(F.octet_length("word") <= BROADCAST_WORD_BYTES)
    total, n_short = table.agg(F.count(F.lit(1)), F.count(F.when(F.octet_length("word") <= BROADCAST_WORD_BYTES, 1))).first()
    if n_short > limit:
        # The least count that keeps the frequent part within the bound, by a histogram of counts.
        bins = short.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).collect()
        kept, least = 0, None
        for b in bins:
            if kept + b["k"] > limit:
                break
            kept, least = kept + b["k"], b["bin"]
        frequent = F.floor(F.log2("n") * 4).cast("int") >= F.lit(least if least is not None else 1 << 20)
        frequent &= F.octet_length("word") <= BROADCAST_WORD_BYTES
        return table.where(frequent), table.where(~frequent)
    if n_short < total:
        return short, table.where(F.octet_length("word") > BROADCAST_WORD_BYTES)
    return table, None


@functools.lru_cache(maxsize=2)
def _lookup(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(words, first id's place, number of ids, ids) of a broadcast table."""
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    ids = t.column("ids").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks)
    words_ = pa.concat_arrays(t.column("word").chunks) if t.num_rows else pa.array([], pa.string())
    offsets = ids.offsets.to_numpy()
    return words_, offsets[:-1], np.diff(offsets), ids.values


def _broadcast(spark: SparkSession, frequent: DataFrame):
    t = frequent.select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _near(docs: DataFrame, key: str, text: str, shared, count_only: bool) -> DataFrame:
    """The join of every text's words with the broadcast table, in columns.

    Runs of words that the table has come out as fragments (key, start, whole,
    ids), ``whole`` where the text is one fragment.  With ``count_only``, one row
    (key, n) per text counts the ids.  No row of a single word leaves the task.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, begin, size, values = _lookup(shared.value)
        values = values.to_numpy(zero_copy_only=False)
        for b in batches:
            col = b.column("ws")
            flat = col.flatten()
            idx = pc.index_in(flat, value_set=vocabulary)
            known = idx.is_valid().to_numpy(zero_copy_only=False)
            idx = idx.fill_null(0).to_numpy()
            lens = np.diff(col.offsets.to_numpy())
            first = np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else np.array([], dtype=np.int64)
            of = np.repeat(np.arange(len(lens)), lens)
            n_ids = np.where(known, size[idx] if len(size) else 0, 0)
            if count_only:
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.bincount(of, weights=n_ids, minlength=len(lens)).astype(np.int64))], [key, "n"])
                continue
            place = np.arange(len(of)) - first[of]
            before = np.concatenate(([False], known[:-1])) & (place > 0)
            start = known & ~before
            found, at = idx[known], np.flatnonzero(start)
            n_found = size[found] if len(size) else np.array([], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(n_found)))
            # The ids of the found words, one after the other.
            take = np.repeat(begin[found] - ends[:-1], n_found) + np.arange(int(ends[-1])) if len(found) else np.array([], dtype=np.int64)
            rank = np.cumsum(known)[at] - 1
            offsets = np.concatenate((ends[rank], [ends[-1]])).astype(np.int32)
            missing = np.bincount(of[~known], minlength=len(lens)) if len(lens) else np.array([], dtype=np.int64)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[take].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(of[at])), pa.array(place[at].astype(np.int32)), pa.array(missing[of[at]] == 0), ids], [key, "start", "whole", "ids"])

    schema = f"`{key}` {kind}, n long" if count_only else f"`{key}` {kind}, start int, whole boolean, ids array<int>"
    return docs.where(F.length(text) > 0).select(key, words(F.col(text)).alias("ws")).mapInArrow(run, schema)


def _far(docs: DataFrame, key: str, text: str, frequent: DataFrame, rest: DataFrame) -> DataFrame:
    """(key, start, ids) of the words beyond the broadcast table, by a shuffled join."""
    at = docs.select(key, F.posexplode(words(F.col(text))).alias("start", "word"))
    return at.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(rest.select("word", "ids"), "word").select(key, "start", "ids")


def encode(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(key, ids) of every row; null and empty texts have an empty list.

    ``key`` must be unique.  Strings that look like special tokens are ordinary
    text.  Other columns of ``docs`` play no part.
    """
    docs = docs.select(key, text)
    table = word_table(docs, Scratch(spark, "tokens"), text, name, folder)
    frequent, rest = split_table(table, limit)
    near = _near(docs, key, text, _broadcast(spark, frequent), False)
    empty = docs.where(F.coalesce(F.col(text), F.lit("")) == "").select(key, F.array().cast("array<int>").alias("ids"))
    if rest is None:
        return near.select(key, "ids").unionByName(empty)
    parts = near.where("not whole").select(key, "start", "ids").unionByName(_far(docs, key, text, frequent, rest))
    joined = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("parts"))
    joined = joined.select(key, F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    return near.where("whole").select(key, "ids").unionByName(joined).unionByName(empty)


def token_counts(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(key, n_tokens) of the rows with a non-empty text."""
    docs = docs.select(key, text)
    table = word_table(docs, Scratch(spark, "tokens"), text, name, folder)
    frequent, rest = split_table(table, limit)
    near = _near(docs, key, text, _broadcast(spark, frequent), True)
    if rest is None:
        return near.withColumnRenamed("n", "n_tokens")
    far = _far(docs, key, text, frequent, rest).select(key, F.size("ids").cast("long").alias("n"))
    return near.unionByName(far).groupBy(key).agg(F.sum("n").alias("n_tokens"))


def decode(ids: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bytes) of id lists through a join with (id, piece) rows."""
    at = ids.select(F.col(key).alias("_key"), F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    parts = at.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return parts.select(F.col("_key").alias(key), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")).alias("bytes"))


def piece_table(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece) of a rank file: one line per piece, its bytes in base64 and its id."""
    lines = spark.read.text(f"{folder}/{name}.tiktoken").where(F.length("value") > 0)
    return lines.select(F.split_part("value", F.lit(" "), F.lit(2)).cast("int").alias("id"), F.unbase64(F.split_part("value", F.lit(" "), F.lit(1))).alias("piece"))
