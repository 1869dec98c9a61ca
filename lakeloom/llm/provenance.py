"""Generated, minified, vendored and pasted source files.

Every file becomes a stream of code tokens whose identifiers, numbers and
strings are masked.  Its five-token shingles, and those of its text as it
stands, are reduced to MinHash signatures; bands of the signatures find
candidates, the candidates of a bucket are joined to a forest of the most
similar pairs, and every pair of the forest is verified on the two shingle sets.
The verified pairs make clusters, and the clusters' own figures decide:

* copies (the text agrees too) over several repositories, or with a member that
  lies in a package folder or has the head of a library, are third-party code;
* a family within a repository, or a cluster of copies, of which at least half
  is marked as a tool's output is generated, the other half included; likewise
  families of minified files and of lock files;
* a family of which at least half is nothing but literals is pasted data.

Marks (a generator's notice in the head of a file, a path by a tool's
convention, the density of a minifier's output, the share of literals) are taken
from every file, and only their sums over a cluster decide.  A file without a
twin is a cluster of one; README tells how many rows those are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.components import components
from lakeloom.sources.tables import Scratch

WORDS, SIMILAR = 5, 0.8
#: Signature places of the masked and of the plain text.
PLACES, PLAIN = 192, 96
#: Bands over repositories join 6 masked and 3 plain places; bands within one repository 8 masked places.
#: A pair that is 0.8 similar in both shares one of the 32 (24) bands with 99 % (98 %), at 0.9 always.
BANDS, KIN_BANDS = 32, 24
#: Shingles from which equal texts in two repositories are no coincidence.  Shorter files are clustered all the same.
LEAST_SHINGLES = 24
#: What an estimate may be too low by; exact similarities decide.
SLACK = 0.08

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\s\w]")
#: Words of programming languages that stay as they are (fixed values).
KEYWORDS = frozenset(
    "abstract as assert async await bool break byte case catch char class const continue def default defer del do double elif else enum except export extends false final finally float "
    "fn for from func function go goto if impl implements import in instanceof int interface is let long match mod module mut namespace new nil none not null or package pass private "
    "protected pub public raise return select self short static string struct super switch this throw throws trait true try type typedef unsafe use using var virtual void volatile where while with yield".split()
)

#: What a generator, or a build that rewrites the file, says of itself (fixed values, several languages).
NOTICE = re.compile(
    r"(?i)@generated\b|<auto-?generated|code generated (?:by|from)|(?:this|the) (?:file|code|source|module|class) (?:is|was|has been|were)?\s*(?:automatically |auto-?|machine[- ])?(?:generated|created|produced|built) (?:by|from|automatically|with|using)|"
    r"auto-?generated (?:file|code|by|from|on|with)|machine[- ]?(?:made|generated) (?:output|file|code)|generated (?:by|from) (?:the |a )?[\w.\- ]*(?:compiler|generator|protoc|tool|schema|template|grammar|spec|\.proto|\.g4|swagger|openapi|thrift|version)|"
    r"do not (?:edit|modify|change|touch)\b.*(?:generat|regenerat|overwrit|built|build|compil)|(?:generat|regenerat|overwrit|built from|compil)\w*.*do not (?:edit|modify|change|touch)|do not modify:? regenerated|changes (?:will be|are) (?:lost|overwritten)|"
    r"automatisch (?:erzeugt|generiert|erstellt)|nicht von hand (?:ändern|bearbeiten)|(?:produit|généré|créé)e? automatiquement|ne pas modifier|(?:generado|producido|creado) autom[áa]ticamente|no (?:modificar|editar)|"
    r"gerado automaticamente|generato automaticamente|автоматически (?:сгенерирован|создан)|сгенерирован|自动生成|自動生成|请勿(?:编辑|修改)|編集しないで"
)
#: Sentences that only speak of generators (fixed values).
ABOUT_NOTICE = re.compile(r"(?i)prints? |writes? |emits? |looks? for|searches|greps?|the words|the marker|the line|strips?|removes? the|unlike|instead of generat|not generated|no longer generated|hand[- ]?written")
#: File names and folders that tools give to what they write (fixed values).
TOOL_PATH = re.compile(
    r"(?:^|/)(?:zz_generated[._]|__generated__/|generated-sources/|\.generated/|autogen/)|(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h)|_grpc\.pb\.go|\.g\.(?:cs|dart)|\.freezed\.dart|\.designer\.(?:cs|vb)|\.generated\.\w+|_generated\.\w+|\.gen\.\w+|\.g4\.\w+)$", re.I
)
LOCK_PATH = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum|flake\.lock|mix\.lock|podfile\.lock|packages\.lock\.json|uv\.lock|deno\.lock|bun\.lockb?)$")
#: Folders in which package managers and people put third-party code (fixed values).
PACKAGE_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|vendor|vendors|vendored|third[_-]?party|3rdparty|external|externals|extern|pods|site-packages|dist-packages|carthage|jspm_packages|deps|_vendor|assets/libs|libs?)/(.+)$")
STRONG_DIR = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|site-packages|dist-packages|jspm_packages|pods)/")
VERSION = re.compile(r"(?:^|[/_@\-])v?\d+\.\d+(?:\.\d+)*(?=[/\-_]|$)")
#: The head of a library: its name and version, and whose it is.
LIBRARY = re.compile(r"(?is)^\W*(?:/\*+!?|//|#|--|<!--)?\W*[\w.\- ]{2,40}\bv\d+\.\d+(?:\.\d+)?\b.{0,200}?(?:\(c\)|copyright|licen[cs]e|contributors)")
MIN_NAME = re.compile(r"(?i)(?:[.\-_]min\.(?:m?js|css|cjs)|\.bundle\.(?:m?js|css)|\.[0-9a-f]{8,20}\.(?:chunk\.)?(?:m?js|css))$")
WEB = re.compile(r"(?i)\.(?:m?js|cjs|css|jsx|ts)$")
SOURCE = re.compile(r"(?i)\.(?:py|pyi|m?js|cjs|jsx|tsx?|java|go|rs|cs|c|cc|cpp|cxx|h|hh|hpp|rb|php|kt|swift|scala|lua|dart|m|sh|pl|r)$")
DOCUMENT = re.compile(r"(?i)\.(?:md|rst|txt|adoc|markdown|html?)$")

_COMMENT_HEAD = re.compile(r"^(?:\s*(?:#(?!include|define|!|\[)|//|/\*|\*|--|;|<!--|\"\"\"|'''|%).*\n?|\s*#!.*\n|\s*\n|\s*(?:<\?xml|<\?php|'use strict'|\"use strict\").*\n?)+")


#: Codes of the masked classes; keywords and signs have codes of their own above them.
NAME, NUMBER, STRING = 1, 2, 3
_CODES: dict[str, int] = {}


def _code(t: str) -> int:
    c = t[0]
    if c.isalpha() or c in "_$":
        code = zlib.crc32(t.encode()) | 1 << 40 if t.lower() in KEYWORDS else NAME
    elif c.isdigit():
        code = NUMBER
    elif c in "\"'`" and len(t) > 1:
        code = STRING
    else:
        code = zlib.crc32(t.encode()) | 1 << 41
    if len(_CODES) > 500_000:
        _CODES.clear()
    if len(t) < 40:
        _CODES[t] = code
    return code


def mask(text: str) -> np.ndarray:
    """Codes of the code tokens of a text; identifiers, numbers and strings have one code each."""
    known = _CODES
    return np.array([known.get(t) or _code(t) for t in _TOKEN.findall(text)], dtype=np.uint64)


#: Keywords that declare data without computing (fixed values).
_DATA_WORDS = frozenset("const static char int unsigned export default null true false byte long float double string new var let public private final module package class".split())
_LOGIC = np.array(sorted(zlib.crc32(k.encode()) | 1 << 40 for k in KEYWORDS - _DATA_WORDS), dtype=np.uint64)
_SIGNS = np.array(sorted(zlib.crc32(k.encode()) | 1 << 41 for k in "{}[](),;:="), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(codes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of all runs of ``words`` token codes; a shorter text is one run."""
    if not len(codes):
        return np.array([], dtype=np.uint64)
    n = max(1, len(codes) - words + 1)
    run = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(codes))):
            run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(run)


def plain_codes(text: str) -> np.ndarray:
    """Codes of the blank-separated words as they stand."""
    return np.array([zlib.crc32(t) for t in text.encode().split()], dtype=np.uint64)


def signature(sh: np.ndarray, places: int) -> np.ndarray:
    """One-permutation MinHash with ``places`` places; empty ones borrow from the next filled one.

    Of an empty set, the greatest values.
    """
    full = np.iinfo(np.uint64).max
    sig = np.full(places, full, dtype=np.uint64)
    if not len(sh):
        return sig
    with np.errstate(over="ignore"):
        h = np.sort(_mix(sh * np.uint64(0x9E3779B97F4A7C15)))[::-1]
        sig[(h % np.uint64(places)).astype(np.int64)] = h  # the smallest is written last
        filled = np.flatnonzero(sig != full)
        gaps = np.flatnonzero(sig == full)
        donors = filled[np.searchsorted(filled, gaps) % len(filled)]
        away = ((donors - gaps) % places).astype(np.uint64)
        sig[gaps] = _mix(sig[donors] + away * np.uint64(0xC2B2AE3D27D4EB4F))
    return sig


def band_hashes(sig: np.ndarray, plain: np.ndarray, repo: str) -> tuple[list[int], list[int]]:
    """Bands over all repositories, and bands within the file's own."""
    a, b = PLACES // BANDS, PLAIN // BANDS
    over = [zlib.crc32(sig[i * a : i * a + a].tobytes() + plain[i * b : i * b + b].tobytes()) | (i << 32) for i in range(BANDS)]
    k, own = PLACES // KIN_BANDS, repo.encode()
    return over, [zlib.crc32(own + sig[i * k : i * k + k].tobytes()) | ((BANDS + i) << 32) for i in range(KIN_BANDS)]


def short_set(sh: np.ndarray) -> bytes:
    """A shingle set as sorted 32-bit hashes."""
    return np.unique((sh >> np.uint64(16)).astype(np.uint32)).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def marks(path: str, text: str, masked: np.ndarray) -> dict[str, bool]:
    """What a file says of itself."""
    head = _COMMENT_HEAD.match(text)
    notice = bool(head) and any(NOTICE.search(line) and not ABOUT_NOTICE.search(line) for line in head.group().split("\n"))
    longest = max(map(len, text.split("\n")))
    body = re.sub(r"(?s)^\s*/\*.*?\*/", "", text, count=1).strip()
    blank = (body.count(" ") + body.count("\t") + body.count("\n") + body.count("\r")) / max(1, len(body))
    dense = longest > 400 and len(body) / max(1, body.count("\n") + 1) > 200 and blank < 0.12
    n, names = len(masked), int((masked == NAME).sum())
    literal = int(((masked == NUMBER) | (masked == STRING)).sum())
    words = names + int(((masked >> np.uint64(40)) == 1).sum())
    blob = len(text) > 400 and words <= 8 + 0.02 * n and (literal >= 20 or longest > 400)
    if not blob and len(text) > 800:  # literals with the names of their fields, within one string or list
        signs = int(np.isin(masked, _SIGNS).sum())
        blob = not np.isin(masked, _LOGIC).any() and literal + signs > 0.8 * max(1, n) and names <= 0.25 * n
    package = PACKAGE_DIR.search(path)
    vendored = bool(STRONG_DIR.search(path)) or bool(package and VERSION.search(package.group(1)))
    library = bool(head and LIBRARY.match(head.group()))
    lock = bool(LOCK_PATH.search(path)) or (path.endswith((".lock", "lock.json")) and text.count("sha512-") + text.count("sha256") >= 3)
    minified = bool(WEB.search(path)) and (dense or bool(MIN_NAME.search(path)) and longest > 200)
    return {
        "notice": notice, "tool_path": bool(TOOL_PATH.search(path)), "lock": lock, "minified": minified, "blob": bool(blob and SOURCE.search(path) and not minified),
        "vendored": vendored, "library": library, "document": bool(DOCUMENT.search(path)),
    }


MARKS = ("notice", "tool_path", "lock", "minified", "blob", "vendored", "library", "document")
FEATURES = "repo_name string, module_path string, key string, n_shingles int, digest binary, sig binary, over array<long>, kin array<long>, masked binary, plain binary, " + ", ".join(f"{m} boolean" for m in MARKS)


def files(chunks: DataFrame) -> DataFrame:
    """(repo_name, module_path, content): the whole file if it was stored, else its chunks in line order.

    Rows with a null repository or path belong to no file; repeated rows of an
    id count once; a null content is empty.
    """
    rows = chunks.where("repo_name is not null and module_path is not null").select(
        "repo_name", "module_path", F.struct((F.col("chunk_type") != "file").alias("part"), F.coalesce("start_line", F.lit(0)).alias("at"), "id", F.coalesce("content", F.lit("")).alias("text")).alias("c")
    )
    whole = F.exists("cs", lambda c: ~F.coalesce(c["part"], F.lit(True)))
    text = F.transform(F.filter("cs", lambda c: F.lit(True) != F.coalesce(c["part"], F.lit(True))), lambda c: c["text"])
    parts = F.transform("cs", lambda c: c["text"])
    return rows.groupBy("repo_name", "module_path").agg(F.array_sort(F.collect_set("c")).alias("cs")).select(
        "repo_name", "module_path", F.array_join(F.when(whole, text).otherwise(parts), "\n").alias("content")
    )


def features(rows: DataFrame) -> DataFrame:
    """Marks, signatures, bands and shingle sets of every file; a file without a token has no bands."""
    kinds = {"n_shingles": pa.int32(), "over": pa.list_(pa.int64()), "kin": pa.list_(pa.int64())} | dict.fromkeys(("digest", "sig", "masked", "plain"), pa.binary()) | dict.fromkeys(MARKS, pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {k.strip().split()[0]: [] for k in FEATURES.split(",")}
            for repo, path, text in zip(*(b[c].to_pylist() for c in ("repo_name", "module_path", "content"))):
                codes = mask(text)
                sh, words = shingles(codes), shingles(plain_codes(text))
                sig, raw = signature(sh, PLACES), signature(words, PLAIN)
                over, kin = band_hashes(sig, raw, repo) if len(sh) else ([], [])
                masked, plain = short_set(sh), short_set(words)
                # A byte of each place, from bits that don't depend on the place.
                places = (np.concatenate([sig, raw]) >> np.uint64(40)).astype(np.uint8)
                values = marks(path, text, codes) | {
                    "repo_name": repo, "module_path": path, "key": f"{repo}\x00{path}", "n_shingles": len(sh), "digest": hashlib.blake2b(masked + b"|" + plain, digest_size=16).digest(),
                    "sig": places.tobytes(), "over": over, "kin": kin, "masked": masked, "plain": plain,
                }
                for k, v in cols.items():
                    v.append(values[k])
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in cols.items()], list(cols))

    return rows.mapInArrow(run, FEATURES)


#: Files of one block of a bucket.
BLOCK = 4096
#: Estimated similarities at which the forest of a block grows, and that of a centre to those it stands for.
LEVELS, STANDS_FOR = (0.98, 0.94, 0.9, 0.86, 0.82, 0.78, SIMILAR - SLACK), 0.9
LINK = "rid long, other long, band long, sig binary"


def _estimates(m: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Masked and plain similarity of row i to all rows; bytes of different hashes agree once in 256 times."""
    same, plain = (m[:, :PLACES] == m[i, :PLACES]).mean(axis=1), (m[:, PLACES:] == m[i, PLACES:]).mean(axis=1)
    return ((same - 1 / 256) * 256 / 255).astype(np.float32), ((plain - 1 / 256) * 256 / 255).astype(np.float32)


def forest(sim: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join all rows which chains of similar pairs join, the most similar pairs first."""
    label, out = np.arange(len(sim)), []
    for least in LEVELS:
        for i in range(len(sim)):
            row = sim[i]
            while True:
                near = np.where(label != label[i], row, -1.0)
                j = int(near.argmax())
                if near[j] < least:
                    break
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def centres(same: np.ndarray, plain: np.ndarray) -> list[int]:
    """Rows that stand for all others: every row is about equal to one of them."""
    left, out = np.arange(len(same)), []
    while len(left):
        c = left[0]
        out.append(int(c))
        left = left[(np.minimum(same[c], plain[c])[left] < STANDS_FOR) & (left != c)]
    return out


def _block_links(keys: list[int], sigs: list[bytes], band: int, go_on: bool) -> list[tuple]:
    m = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(keys), PLACES + PLAIN)
    same, plain = (np.stack(x) for x in zip(*(_estimates(m, i) for i in range(len(keys)))))
    pairs = set(forest(same)) | set(forest(np.minimum(same, plain)))
    rows = [(keys[i], keys[j], None, None) for i, j in pairs]
    if go_on:
        rows += [(keys[c], keys[c], band, sigs[c]) for c in centres(same, plain)]
    return rows


def _cluster_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the blocks of a sorted partition, and the centres of crowded buckets' blocks."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in LINK.split(", ")]

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.r_[True, (np.diff(t.column("band").to_numpy()) != 0) | (np.diff(t.column("block").to_numpy()) != 0), True])
        keys, sigs, bands, blocks = (t.column(c).to_pylist() for c in ("rid", "sig", "band", "blocks"))
        rows: list[tuple] = []
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo > 1 or blocks[lo] > 1:
                rows += _block_links(keys[lo:hi], sigs[lo:hi], bands[lo], blocks[lo] > 1)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        # The last block may go on in the next batch.
        band, block = t.column("band").to_numpy(), t.column("block").to_numpy()
        cut = int(np.flatnonzero((band != band[-1]) | (block != block[-1]))[-1]) + 1 if ((band != band[-1]) | (block != block[-1])).any() else 0
        yield from out(t.slice(0, cut)) if cut else ()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield from out(rest)


def candidates(feats: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, other) pairs of the buckets of the bands.

    A bucket is worked in blocks of bounded size; the centres of its blocks meet
    in the next round, until a bucket's centres fit one block.  A bucket whose
    centres don't get fewer is worked by pairs of blocks at last, so every
    bucket ends, none is one task's, and none is cut.
    """
    own = feats.where("n_shingles > 0").groupBy("repo_name", "digest").agg(F.min("key").alias("key"))
    first = own.groupBy("digest").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("is_first"))
    rows = feats.select("key", "sig", "over", "kin").join(own.select("key").join(first, "key", "left"), "key")
    # Files go through the bands by a number; their names come back to the pairs.
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "firsts")
    left = rows.where("is_first").select("rid", F.explode("over").alias("band")).unionByName(rows.select("rid", F.explode("kin").alias("band")))
    shared = left.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = left.join(shared, "band").join(rows.select("rid", "sig"), "rid").select("band", "rid", "sig", "n")
    out, before, pairwise = None, None, False
    round_no = 0
    while True:
        left = left.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        block = F.pmod(F.xxhash64("rid", F.lit(round_no)), "blocks").cast("int")
        if pairwise:
            # Every pair of blocks is a group of its own; a row goes to all that its block is in.
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            left = left.withColumn("_b", block).withColumn("_o", other).withColumn("block", F.least("_b", "_o") * F.col("blocks") + F.greatest("_b", "_o")).withColumn("blocks", F.lit(1))
        else:
            left = left.withColumn("block", block)
        done = left.select("band", "block", "blocks", "rid", "sig").repartition("band", "block").sortWithinPartitions("band", "block", "rid").mapInArrow(_cluster_blocks, LINK)
        done = scratch.save(done, "pairs")
        some = done.where("band is null").select(F.least("rid", "other").alias("rid"), F.greatest("rid", "other").alias("other"))
        out = some if out is None else out.unionByName(some)
        again = done.where("band is not null").select("band", "rid", "sig").distinct()
        count = again.count()
        if count == 0:
            names = rows.select("rid", "key")
            return out.distinct().join(names, "rid").select("key", F.col("other").alias("rid")).join(names.withColumnRenamed("key", "other"), "rid").select("key", "other")
        # Without a third fewer centres, further rounds would not end soon.
        pairwise = before is not None and count > before * 2 / 3
        before, round_no = count, round_no + 1
        sizes = again.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
        left = scratch.save(again.join(sizes, "band"), "centres")


def verified(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """(key, other, same, plain) of the pairs whose masked shingle sets are at least ``SIMILAR``."""
    sets = feats.select("key", "masked", "plain")
    a = pairs.join(sets.select("key", F.col("masked").alias("m1"), F.col("plain").alias("p1")), "key")
    both = a.join(sets.select(F.col("key").alias("other"), F.col("masked").alias("m2"), F.col("plain").alias("p2")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m1, m2, p1, p2 = (b.column(c).to_pylist() for c in ("m1", "m2", "p1", "p2"))
            same = np.array([jaccard(x, y) for x, y in zip(m1, m2)])
            plain = np.array([jaccard(x, y) for x, y in zip(p1, p2)])
            out = pa.RecordBatch.from_arrays([b.column("key"), b.column("other"), pa.array(same, pa.float64()), pa.array(plain, pa.float64())], ["key", "other", "same", "plain"])
            yield out.filter(pa.array(same >= SIMILAR))

    return both.select("key", "other", "m1", "m2", "p1", "p2").mapInArrow(run, "key string, other string, same double, plain double")


def links(feats: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified (key, other, same, plain) pairs.

    Files whose sets are equal are linked to the first of their repository, and
    that one to the first of all; only these go on to the bands.
    """
    some = feats.where("n_shingles > 0").select("repo_name", "digest", "key")
    own = some.groupBy("repo_name", "digest").agg(F.min("key").alias("other"))
    first = own.groupBy("digest").agg(F.min("other").alias("first"))
    equal = some.join(own, ["repo_name", "digest"]).where("key <> other").select("key", "other")
    equal = equal.unionByName(own.join(first, "digest").where("other <> first").select(F.col("other").alias("key"), F.col("first").alias("other")))
    equal = equal.withColumns({"same": F.lit(1.0), "plain": F.lit(1.0)})
    return equal.unionByName(verified(candidates(feats, scratch), feats))


def _share(c) -> "F.Column":
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def classify(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """(repo_name, module_path, kind, family, copy, n_kin, n_copies, n_repos) of every file; kind is null for hand-written ones."""
    s = Scratch(spark, "provenance")
    feats = s.save(features(files(chunks)), "features")
    edges = s.save(links(feats, s), "links")
    family = components(spark, edges, "key", "other").withColumnsRenamed({"node": "key", "component": "family"})
    copies = components(spark, edges.where(F.col("plain") >= SIMILAR), "key", "other").withColumnsRenamed({"node": "key", "component": "copy"})
    slim = feats.select("repo_name", "module_path", "key", "n_shingles", *MARKS)
    slim = slim.join(family, "key", "left").join(copies, "key", "left")
    slim = s.save(slim.withColumns({"family": F.coalesce("family", "key"), "copy": F.coalesce("copy", "key")}), "files")
    # Evidence of a family within its repository, and of copies over repositories.
    kin = slim.groupBy("repo_name", "family").agg(
        F.count(F.lit(1)).alias("n_kin"), _share(F.col("notice") | F.col("tool_path")).alias("marked"), _share(F.col("lock")).alias("locks"), _share(F.col("minified")).alias("dense"), _share(F.col("blob")).alias("literal")
    )
    over = slim.groupBy("copy").agg(F.count(F.lit(1)).alias("n_copies"), F.countDistinct("repo_name").alias("n_repos"), F.max("vendored").alias("any_vendored"), F.max("library").alias("any_library"), F.max("n_shingles").alias("most"), _share(F.col("notice") | F.col("tool_path")).alias("marked_copies"))
    out = slim.join(kin, ["repo_name", "family"]).join(over, "copy")
    literal = F.col("literal") >= 0.5
    kind = (
        F.when(F.col("document"), None)
        .when(F.col("locks") >= 0.5, "lock")
        .when(F.col("dense") >= 0.5, "minified")
        .when(F.col("any_vendored") | F.col("any_library") | ((F.col("n_repos") > 1) & ~literal & (F.col("most") >= LEAST_SHINGLES)), "vendored")
        .when((F.col("marked") >= 0.5) | (F.col("marked_copies") >= 0.5), "generated")
        .when(literal, "blob")
    )
    return out.select("repo_name", "module_path", kind.alias("kind"), "family", "copy", "n_kin", "n_copies", "n_repos")


def found(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Files that aren't hand-written source of the project."""
    return classify(spark, chunks).where("kind is not null")
