"""What the operators share: scratch tables, checked broadcasts, byte hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (at most two) longs that may be broadcast: 2 million, about 60 MB in a hash table.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that one vectorised step takes at once; longer texts are taken in pieces.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named (tests), one in the warehouse, which all executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, losing executors loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more (what was made of them is materialised itself)."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (already materialised, narrow) with a broadcast hint if it has few enough rows, else as it is: then the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose doc_id is (left_semi) or isn't (left_anti) in ids, a materialised one-column table."""
    return docs.join(small(ids), "doc_id", how).select(*docs.columns)


#: A key is heavy with more than this many rows and more than 1 / HEAVY_KEYS of all: so at most HEAVY_KEYS are.
HEAVY_ROWS = 256
HEAVY_KEYS = 10_000


def heavy_keys(sizes: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, salts) of the heavy ones among sizes (keys, n), at most HEAVY_KEYS rows; or None."""
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    least = max(HEAVY_ROWS, (total or 0) // HEAVY_KEYS)
    if (most or 0) <= least:
        return None
    rows = sizes.where(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("salts"))
    return sizes.sparkSession.createDataFrame(rows.collect(), rows.schema)


def sizes_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def heavy_join(big: DataFrame, small_side: DataFrame, keys: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """big joined with small_side, which holds a key once; rows of a heavy key are dealt to several tasks by a hash of the whole row."""
    if heavy is None:
        return big.join(small_side, keys, how)
    heavy = F.broadcast(heavy)  # HEAVY_KEYS rows at most
    salts = F.coalesce("salts", F.lit(1))
    left = big.join(heavy, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*big.columns), salts).cast("int")).drop("salts")
    right = small_side.join(heavy, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")


def column_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Rows that a Python step turns into objects at once.
SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small views of Arrow batches: a worker's memory doesn't depend on the batch size of the session."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """work(RecordBatch) -> dict of columns (or None for no rows), for each small slice of df's Arrow batches."""
    from pyspark.sql.types import _parse_datatype_string  # the public DDL parser needs a session in any case
    from pyspark.sql.pandas.types import to_arrow_schema

    names = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in names], schema=names)

    return df.mapInArrow(run, schema)


# --- 64-bit hashing of words and shingles, a chunk of texts at a time ---------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers: the same on every machine and library version."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: White space of the contracts: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE = re.compile(rb"[ \t-\r]")
#: Shingles that are made at once.
BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) runs of texts of about CHUNK bytes together; one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def pieces(text: bytes) -> Iterator[bytes]:
    """text, cut at white space into pieces of about CHUNK bytes: none holds a part of a word."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _SPACE.search(text, at + CHUNK)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at starts: eight bytes at a time are mixed in by a bijection; long words by XXH3."""
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=data + bytes(8), strides=(1,))
    keep = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
    h = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(sizes <= LONG_WORD)
    at = 0
    while len(live):
        lane = lanes[starts[live] + at] & keep[np.minimum(sizes[live] - at, 8)]
        h[live] = mix(h[live] ^ lane) * np.uint64(0xD6E8FEB86659FD93)
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return h


def _words(texts: list[bytes], digests: list | None) -> tuple[np.ndarray, np.ndarray]:
    """words_of for pieces of about CHUNK bytes together; digests holds a hash object for each, which is updated."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    data = (b"\n".join(texts) + b"\n").lower()
    buf = np.frombuffer(data, dtype=np.uint8)
    inside = ~SPACE[buf]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate(([0], change))
    starts, ends = change[0::2], change[1::2]  # the last byte is white space, so every word ends
    if digests is not None:  # each word and one space
        kept = inside.copy()
        kept[ends] = True
        plain = np.where(inside, buf, 32).astype(np.uint8)[kept]
        places = np.concatenate(([0], np.cumsum(kept)))[begins]
        for digest, lo, hi in zip(digests, places[:-1], places[1:], strict=True):
            digest.update(plain[lo:hi])
    return _word_hashes(data, starts, ends - starts), np.searchsorted(starts, begins)


def words_of(texts: list[bytes], digests: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space words of all texts (A-Z lowered), in order, and where each text's words begin (with an end).

    digests gets a 128-bit cryptographic digest of each text's whole word sequence.
    """
    own = None if digests is None else [blake2b(digest_size=16) for _ in texts]
    parts, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for lo, hi in chunks(texts):
        if hi - lo == 1:
            for piece in pieces(texts[lo]):
                h, at = _words([piece], own and own[lo:hi])
                parts.append(h)
                counts[lo] += at[1]
        else:
            h, at = _words(texts[lo:hi], own and own[lo:hi])
            parts.append(h)
            counts[lo:hi] = np.diff(at)
    if digests is not None:
        digests += [d.digest() for d in own]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))


def shingles_of(texts: list[bytes], k: int, short: bool = True, digests: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts and where each text's begin (with an end).

    A text of fewer words is one shingle of all its words if short, else has none.
    """
    h, at = words_of(texts, digests)
    factor = stream(2, k) | np.uint64(1)
    counts = np.diff(at)
    has = np.maximum(counts - k + 1, 0)
    if short:
        has = np.where((counts > 0) & (counts < k), 1, has)
    begins = np.concatenate(([0], np.cumsum(has)))
    out = np.empty(begins[-1], dtype=np.uint64)
    padded = np.concatenate((h, np.zeros(k, dtype=np.uint64)))
    shift = at[:-1] - begins[:-1]
    for lo in range(0, len(out), BLOCK):
        hi = min(lo + BLOCK, len(out))
        text = np.searchsorted(begins, np.arange(lo, hi), side="right") - 1
        first, left = np.arange(lo, hi) + shift[text], at[text + 1]
        acc = np.zeros(hi - lo, dtype=np.uint64)
        for j in range(k):
            acc += np.where(first + j < left, padded[first + j] * factor[j] + np.uint64(j + 1), np.uint64(0))
        out[lo:hi] = mix(acc)
    return out, begins


def minima(h: np.ndarray, begins: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """The least h * a + b of each run of h that begins at begins (none is empty)."""
    if len(h) <= 4 * BLOCK:
        return np.minimum.reduceat(h * a + b, begins)
    ends = np.concatenate((begins[1:], [len(h)]))
    return np.array([min((h[i : min(i + BLOCK, hi)] * a + b).min() for i in range(lo, hi, BLOCK)) for lo, hi in zip(begins, ends, strict=True)], dtype=np.uint64)


def shingle_stream(text: bytes, k: int) -> Iterator[bytes]:
    """The k-word shingles of a text in order, made from a piece at a time; none if it has fewer words."""
    before: list[bytes] = []
    for piece in pieces(text):
        words = before + piece.lower().split()
        for i in range(len(words) - k + 1):
            yield b" ".join(words[i : i + k])
        before = words[max(0, len(words) - k + 1) :] if k > 1 else []


def exact_shingles(text: bytes, k: int, short: bool = True) -> set[bytes]:
    """The k-word shingles themselves: words joined by one space (no word holds one)."""
    words = text.lower().split()
    if len(words) < k:
        return {b" ".join(words)} if words and short else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


#: Bytes of text beyond which sets are compared in parts, so that few shingles are held at once.
LONG_TEXT = 8 << 20


def overlap(x: bytes, y: bytes, k: int) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two texts' sets of shingles; shingles fall into parts by a hash."""
    n = max(1, -(-max(len(x), len(y)) // LONG_TEXT))
    short = [exact_shingles(t, k) if next(shingle_stream(t, k), None) is None else None for t in (x, y)]
    shared = union = 0
    for part in range(n):
        a, b = ({s for s in (shingle_stream(t, k) if few is None else few) if crc32(s) % n == part} for t, few in zip((x, y), short, strict=True))
        shared, union = shared + len(a & b), union + len(a | b)
    return shared, union
