"""Shared helpers: table access, scratch tables in the shared folder, id-set joins, word hashing in numpy."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast (8 bytes each); a larger set is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch; texts may be long, so batches stay short.
BATCH_ROWS = 1000
#: Bytes of text that one numpy step works on: its temporaries stay in the CPU cache.
CHUNK_BYTES = 1 << 17

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0x7FB5D329728EA185), _U(0x81DADEF4BC2DD44D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession) -> SparkSession:
    """Shorten Arrow batches unless the user has chosen a length."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


class Scratch:
    """Tables written to the shared folder named by spark.checkpoint.dir: they cut lineage and survive a lost executor.

    Tables that the returned DataFrame still reads stay until the process ends; the others are dropped at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = "/tmp/halogrid-checkpoints"
        self.top = f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of these frames, or of all."""
        try:
            jvm = self.spark._jvm
            conf = self.spark._jsc.hadoopConfiguration()
            for path in [f._scratch_path for f in frames] or [self.top]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def keep_ids(df: DataFrame, ids: DataFrame, col: str, how: str = "left_semi", bound: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of df with a written table of ids; broadcast only if the counted ids are few."""
    ids = ids.select(col)
    return df.join(F.broadcast(ids) if ids.count() <= bound else ids, col, how)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U(31))
    x = x * _M1
    x = x ^ (x >> _U(27))
    x = x * _M2
    return x ^ (x >> _U(33))


_pow = np.ones(1, _U), np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    global _pow
    if len(_pow[0]) <= n:
        size = 1 << max(18, n.bit_length() + 1)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, _U)
            have, step = 1, b
            while have < size:
                more = min(have, size - have)
                np.multiply(p[:more], _U(step), out=p[have : have + more])
                have += more
                step = step * step % (1 << 64)
            out.append(p)
        _pow = out[0], out[1]
    return _pow


def wrapping_sums(data: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = sum of (byte + 1) * B**i modulo 2**64 for s <= i < e.

    Fast, but words that double by a swap of two letters defeat this modulus: only for choices that any function of the
    bytes may make (buckets of n-grams, anchors), never to tell that two strings are equal.
    """
    n = len(data)
    s = np.zeros(n + 1, _U)
    v = data.astype(_U)
    v += _U(1)
    v *= powers(n)[0][:n]
    np.cumsum(v, out=s[1:])
    return s


#: Two primes under 2**31, each with a base drawn at random once; two different strings of n bytes agree in both hashes
#: for at most n**2 of the 2**62 pairs of bases.
PRIMES, BASES = (2147483647, 2147483629), (1350490027, 894785713)
#: Bytes after which the sums are reduced, so that they stay below 2**62.
_REDUCE = 1 << 22
#: A multiple of each prime above all sums, so that differences stay positive.
_LIFT = tuple(_U(p << 32) for p in PRIMES)
_prime_pow: list[tuple[np.ndarray, np.ndarray]] = []


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """B**i and B**-i modulo each prime for i up to n."""
    global _prime_pow
    if not _prime_pow or len(_prime_pow[0][0]) <= n:
        size = 1 << max(18, n.bit_length() + 1)
        out = []
        for p, base in zip(PRIMES, BASES, strict=True):
            both = []
            for b in (base, pow(base, -1, p)):
                t = np.ones(size, _U)
                have, step = 1, b
                while have < size:
                    more = min(have, size - have)
                    t[have : have + more] = t[:more] * _U(step) % _U(p)
                    have += more
                    step = step * step % p
                both.append(t)
            out.append((both[0], both[1]))
        _prime_pow = out
    return _prime_pow


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each prime, S with S[e] - S[s] = sum of (byte + 1) * B**i for s <= i < e, so that times B**-s it hashes data[s:e]."""
    n = len(data)
    v = data.astype(_U)
    v += _U(1)
    out = []
    for p, (power, _) in zip(PRIMES, prime_powers(n), strict=True):
        s = np.zeros(n + 1, _U)
        for lo in range(0, n, _REDUCE):
            hi = min(n, lo + _REDUCE)
            np.cumsum(v[lo:hi] * power[lo:hi], out=s[lo + 1 : hi + 1])
            if lo:
                s[lo + 1 : hi + 1] += s[lo] % _U(p)
        out.append(s)
    return tuple(out)


def prefix_residues(data: np.ndarray) -> tuple[np.ndarray, np.uint64, np.ndarray]:
    """prefix_sums of the first prime, reduced, with the prime and B**-i."""
    p = _U(PRIMES[0])
    return prefix_sums(data)[0] % p, p, prime_powers(len(data) + 1)[0][1]


def span_values(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Both primes' hashes of data[start:end] in one word."""
    out = None
    for s, p, lift, (_, inv) in zip(sums, PRIMES, _LIFT, prime_powers(len(sums[0])), strict=True):
        h = (s[end] + lift - s[start]) % _U(p) * inv[start] % _U(p)
        out = h if out is None else out << _U(32) | h
    return out


def span_hash(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_values(sums, start, end) ^ (end - start).astype(_U) * _U(_BASE))


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about limit bytes."""
    first = size = 0
    i = -1
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first <= i:
        yield first, i + 1


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
#: For comparison of prose: ASCII signs separate words like white space.
_signs = np.ones(256, bool)
_signs[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(texts: list[bytes], signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words of some texts, each text's first word (one entry more than texts), and the words' byte starts and ends in their text.

    Words are separated by white space (space, \\t to \\r), with signs=True also by ASCII signs.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sep = (_signs if signs else _space)[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sums = prefix_sums(_lower[data])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    first = np.searchsorted(start, at)
    base = np.repeat(at[:-1], np.diff(first))
    return span_hash(sums, start, end), first, start - base, end - base


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 are missing."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = word[:n].copy()
    for i in range(1, k):
        h = mix(h * _U(0xD1342543DE82EF95) + word[i : i + n])
    return h


def utf8(column) -> list[bytes]:
    """An Arrow string or binary column as bytes; null is empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
