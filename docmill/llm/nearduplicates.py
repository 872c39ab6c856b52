"""Near-duplicate records: ProbMinHash of word shingles, banding, verification, pairs and groups.

Copies with one and the same set of shingles are collapsed to a representative first, so that banding, checking and
grouping see each content once. Candidates meet by an equi-join on band keys, are thinned by a one-bit sketch of the
signatures, and what is left is checked exactly on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import cut_lineage

SHINGLE = 3
LEAST_WORDS = 30
THRESHOLD = 0.5
#: Rows in a band and bands: at a similarity of 0.5 a pair meets in some band with probability 0.984, at 0.6 with 0.9999.
ROWS, BANDS = 4, 64
REGISTERS = ROWS * BANDS
#: The sketch agrees in (1 + J) / 2 of its bits; a pair may lack this many standard deviations of the threshold's share.
SLACK = 4.0
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hash a Python worker remembers; beyond it the memory is emptied.
CACHED_WORDS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def words_of(title: str | None, body: str | None) -> list[str]:
    return f"{title or ''} {body or ''}".lower().split()


def shingle_sets(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each list of words, sorted by owner."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.fromiter((h for words in texts for h in map(_WORDS.__getitem__, words)), np.uint64, int(lengths.sum()))
    if len(hashes) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        runs = mix(runs * _A + hashes[i : len(hashes) - size + 1 + i])
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: len(runs)] == owner[size - 1 :]
    owner, runs = owner[: len(runs)][inside], runs[inside]
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])
    return owner[new], runs[new]


def prob_minhash(owner: np.ndarray, items: np.ndarray, n: int, registers: int = REGISTERS, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n x registers, 64-bit) of n weighted sets whose agreement estimates probability Jaccard.

    Every item is a Poisson process of its weight's rate, the same in every set: its arrivals are seeded by the item
    and fall into registers at random, and a register keeps its earliest arrival. All items advance arrival by arrival;
    one drops out as soon as its next arrival is later than every register of its set. An arrival's time names item and
    arrival in every set where weights are equal, and serves as the register's value; the estimate then is that of plain
    Jaccard. Under weights the register keeps the item.
    """
    earliest = np.full(n * registers, np.inf)
    base = owner * registers
    seed, time, rate = mix(items * _A + _B), np.zeros(len(items)), weights
    latest, winner = np.full(n, np.inf), np.zeros(n * registers if weights is not None else 0, np.uint64)
    step = 0
    while len(seed):
        step += 1
        draw = mix(seed + np.uint64(step * int(_C) & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        time = time + (gap if rate is None else gap / rate)
        alive = time < latest[owner]
        owner, base, seed, time, draw = owner[alive], base[alive], seed[alive], time[alive], draw[alive]
        rate = None if rate is None else rate[alive]
        register = (mix(draw ^ _A) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, base + register, time)
        if rate is not None:
            first = earliest[base + register] == time
            winner[(base + register)[first]] = seed[first]
        if step % 4 == 0 or len(seed) > 50_000:
            latest = earliest.reshape(n, registers).max(axis=1)
    return (earliest.view(np.uint64) if weights is None else winner).reshape(n, registers)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands have keys of their own."""
    n, registers = signatures.shape
    keys = np.tile(np.arange(registers // rows, dtype=np.uint64) * _A, (n, 1))
    for i in range(rows):
        keys = mix(keys * _B + signatures[:, i::rows][:, : registers // rows])
    return keys


def sketch_bits(signatures: np.ndarray) -> np.ndarray:
    """One bit of each register, packed into 64-bit words."""
    bits = (mix(signatures) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


WORDS_OF_SKETCH = REGISTERS // 64


def fingerprints(df: DataFrame, key: str, title_col: str, text_col: str, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, signed: bool = True) -> DataFrame:
    """(id, content, bands ARRAY<BIGINT>, sketch ARRAY<BIGINT>) of the rows with enough words; content names the set of
    shingles in 128 bits. Unless signed, only (id, content)."""
    src = df.select(F.col(key).alias("id"), F.col(title_col).cast("string").alias("title"), F.col(text_col).cast("string").alias("body"))
    src = src.where(F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("body"), F.lit(0)) >= 2 * least_words - 2)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [words_of(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        kept = [i for i, words in enumerate(texts) if len(words) >= max(least_words, shingle)]
        owner, items = shingle_sets([texts[i] for i in kept], shingle)
        starts = np.searchsorted(owner, np.arange(len(kept)))
        content = [np.add.reduceat(mix(items * c), starts).astype(">u8") if len(kept) else np.empty(0, ">u8") for c in (_B, _C)]
        names = np.stack(content, axis=1).tobytes()
        ids = batch.column(0).take(pa.array(kept, pa.int32()))
        keys = pa.array([names[i * 16 : i * 16 + 16] for i in range(len(kept))], pa.binary())
        if not signed:
            return pa.RecordBatch.from_arrays([ids, keys], ["id", "content"])
        signatures = prob_minhash(owner, items, len(kept))
        bands, sketch = band_keys(signatures).view(np.int64), sketch_bits(signatures).view(np.int64)

        def lists(values: np.ndarray) -> pa.ListArray:
            ends = np.arange(len(kept) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

        return pa.RecordBatch.from_arrays([ids, keys, lists(bands), lists(sketch)], ["id", "content", "bands", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield some(batch.slice(at, 2000))

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, content binary" + ", bands array<bigint>, sketch array<bigint>" * signed)


def _agreement(a: Column, b: Column) -> Column:
    """Bits in which two sketches agree."""
    parts = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS_OF_SKETCH)]
    return F.lit(REGISTERS) - sum(parts[1:], parts[0])


#: Bytes of band keys in a partition, and of band keys for each byte of stored text, by which partitions are counted.
PARTITION_BYTES, BAND_SHARE = 16 << 20, 4
#: From here on a stated size means that none is known.
UNKNOWN = 1 << 60


def band_partitions(df: DataFrame) -> int:
    """Partitions for the band keys of df: as many as keep each at PARTITION_BYTES by the size the scan states, so that no
    task grows with the input; the session's shuffle partitions at least, and where no size is known."""
    stated = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if stated >= UNKNOWN else max(least, -(-stated * BAND_SHARE // PARTITION_BYTES))


def candidates(reps: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """(a, b), a < b: representatives that share a band and whose sketches don't rule the threshold out. Band keys, the
    most of what is shuffled, go to the given number of partitions."""
    bands = reps.select(F.explode("bands").alias("band"), "id").repartition(partitions, "band")
    banded, other = bands.withColumnRenamed("id", "a"), bands.withColumnRenamed("id", "b")
    met = banded.join(other, "band").where("a < b").select("a", "b").distinct()
    left = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    right = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    share = (1 + threshold) / 2
    least = REGISTERS * share - SLACK * (REGISTERS * share * (1 - share)) ** 0.5
    both = met.join(left, "a").join(right, "b")
    return both.where(_agreement(F.col("sketch_a"), F.col("sketch_b")) >= least).select("a", "b")


def verified(pairs: DataFrame, df: DataFrame, key: str, title_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact similarity, on whole texts, reaches the threshold."""
    texts = df.select(F.col(key).alias("id"), F.concat(F.coalesce(F.col(title_col), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def runs(text: str) -> set[tuple[str, ...]]:
        words = text.lower().split()
        return set(zip(*(words[i:] for i in range(shingle))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = runs(x), runs(y)
                shared = len(p & q)
                values.append(shared / (len(p) + len(q) - shared))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(pa.array([v >= threshold for v in values], pa.bool_()))

    kind = joined.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


class NearDuplicates:
    """members (rep, id): the representative of each row; links (a, b, similarity): pairs of representatives."""

    def __init__(self, df: DataFrame, key: str, title_col: str, text_col: str, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, threshold: float = THRESHOLD) -> None:
        contents = cut_lineage(fingerprints(df, key, title_col, text_col, shingle, least_words, signed=False))
        first = contents.groupBy("content").agg(F.min("id").alias("rep"))
        self.members = contents.join(first, "content").select("rep", "id")
        prints = fingerprints(df, key, title_col, text_col, shingle, least_words)
        of_first = F.min_by(F.struct("id", "bands", "sketch"), "id").alias("p")
        reps = prints.groupBy("content").agg(of_first).select("p.*")
        self.links = verified(candidates(reps, threshold, band_partitions(df)), df, key, title_col, text_col, shingle, threshold)

    def pairs(self) -> DataFrame:
        """(id_a, id_b, similarity): every two rows at or above the threshold, copies included."""
        a = self.members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
        b = self.members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links.join(a, "a").join(b, "b").select("x", "y", "similarity")
        copies = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
        return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")

    def groups(self) -> DataFrame:
        """(id, rep, group_id): each row with its representative and the least id of all it is linked with, directly or
        through others. Labels fall each round, or the rounds end; chains halve."""
        links = cut_lineage(self.links.select("a", "b"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = cut_lineage(self.members.select(F.col("rep").alias("node"), F.col("rep").alias("label")).distinct())
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", "near").alias("new"), "label")
            # a label is itself a node: follow it to where that node has come by now, which halves long chains
            jump = labels.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
            new = cut_lineage(spread.join(jump, "new").select("node", F.least("new", "beyond").alias("now"), "label"))
            labels, moved = new.select("node", F.col("now").alias("label")), new.where("now <> label").limit(1).count()
            if not moved:
                break
        return self.members.join(labels.withColumnRenamed("node", "rep"), "rep").select("id", "rep", F.col("label").alias("group_id"))
