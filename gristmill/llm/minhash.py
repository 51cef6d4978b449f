"""Near-duplicate detection with min-max hashing.

Every permutation yields two signature values, the minimum and the maximum of the
hashed shingles, so 100 permutations give 200 values for 100 hash evaluations.
Values of five different permutations form a band; 20 bands come from minima and
20 from maxima.  A pair at the threshold of 0.75 misses all 40 bands with a
probability of about 2e-5, and one at 0.8 with about 1e-7.

Plan: texts are read once for signatures; documents with equal shingle sets become
one class by a map-side combined aggregation; each band bucket links its members to
its smallest member; links are confirmed on full shingle sets; components join them;
and only buckets that still hold several components are compared further, across
components.  A bucket of near copies therefore costs links in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ._store import Scratch, frugal, ship
from ._text import LOWER, SMALL_BLOCK, U64, blocks, mix, windows, word_hashes

WORDS = 5
PERMUTATIONS = 100
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Sketches hold two bits of every signature value, 32 to a long.  Two sets of similarity 0.75 agree in 0.8125 of them
#: on average; a bound 5.3 deviations below that loses 6e-8 of such pairs.
SKETCH = [f"b{k}" for k in range(-(-2 * PERMUTATIONS // 32))]
#: Members of buckets that hold several components get 1,024 values of other permutations, which tell 0.6 from 0.75.
WIDE_PERMUTATIONS = 512
WIDE = [f"w{k}" for k in range(WIDE_PERMUTATIONS // 16)]


_rng = np.random.default_rng(7_402_113)
_A = _rng.integers(1, 2**32, PERMUTATIONS, dtype=np.int64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.int64).astype(np.uint32)
_WIDE_A = _rng.integers(1, 2**32, WIDE_PERMUTATIONS, dtype=np.int64).astype(np.uint32) | np.uint32(1)
_WIDE_B = _rng.integers(0, 2**32, WIDE_PERMUTATIONS, dtype=np.int64).astype(np.uint32)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.int64).astype(U64) | U64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, A-Z lower-cased first."""
    for a, b, raw, at in blocks(column, SMALL_BLOCK):
        hashes, first = word_hashes(LOWER[raw], at)
        every = windows(hashes, words)
        for k in range(b - a):
            lo, hi = int(first[k]), int(first[k + 1])
            if hi - lo >= words:
                yield np.unique(every[lo:hi - words + 1])
            elif hi > lo:
                yield windows(hashes[lo:hi], hi - lo)
            else:
                yield hashes[:0]


def signature(items: np.ndarray, times: np.ndarray = _A, plus: np.ndarray = _B) -> np.ndarray:
    """Minima, then maxima, of the permuted 32-bit shingle hashes."""
    x = (items >> U64(32)).astype(np.uint32)
    low = high = None
    for k in range(0, len(x), 2048):
        h = x[None, k:k + 2048] * times[:, None]
        h += plus[:, None]
        lo, hi = h.min(axis=1), h.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate([low, high])


def sketch(values: np.ndarray) -> np.ndarray:
    two = np.zeros(-(-len(values) // 32) * 32, U64)
    two[:len(values)] = (values * np.uint32(0x85EBCA6B)) >> np.uint32(30)
    return (two.reshape(-1, 32) << np.arange(0, 64, 2, dtype=U64)).sum(axis=1, dtype=U64)


def _sums(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return int(np.add.reduce(mix(items ^ U64(0x5851F42D4C957F2D)))), int(np.add.reduce(mix(items ^ U64(0x14057B7EF767814F))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, sums, bands, bits = batch.column(0), [], [], [], []
        for items in shingle_sets(batch.column(2)):
            sizes.append(len(items))
            sums.append(_sums(items))
            if not len(items):
                bands.append(np.zeros(BANDS, U64))
                bits.append(np.zeros(len(SKETCH), U64))
                continue
            values = signature(items)
            wide = values.astype(U64).reshape(BANDS, ROWS)
            bands.append(mix((wide * _BAND).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64)))
            bits.append(sketch(values))
        n = len(sizes)
        if not n:
            continue
        sums_ = np.array(sums, dtype=U64).reshape(n, 2).view(np.int64)
        bits_ = np.array(bits, dtype=U64).reshape(n, len(SKETCH)).view(np.int64)
        bands_ = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (n + 1), BANDS, dtype=np.int32)), pa.array(np.array(bands, dtype=U64).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(sums_[:, k].copy()) for k in range(2)), *(pa.array(bits_[:, k].copy()) for k in range(len(SKETCH))), bands_],
            ["doc_id", "crc", "n_shingles", "s0", "s1", *SKETCH, "bands"],
        )


SIGNED = ", ".join(f"{name} long" for name in ("doc_id", "crc", "n_shingles", "s0", "s1", *SKETCH)) + ", bands array<long>"


def _chosen(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(id, set) of the rows (id, s0, s1, text) whose text has the set that its sums ask for."""
    asked = [batch.column(k).to_numpy().view(U64).tolist() for k in (1, 2)]
    for k, items in enumerate(shingle_sets(batch.column(3))):
        if _sums(items) == (asked[0][k], asked[1][k]):
            yield batch.column(0)[k].as_py(), items


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int64)))], ["id", "items"])

    for batch in batches:
        ids, held, size = [], [], 0
        for id_, items in _chosen(batch):
            ids.append(id_)
            held.append(items)
            size += len(items)
            if size > 1 << 17 or len(held) >= 256:
                yield made(ids, held)
                ids, held, size = [], [], 0
        if held:
            yield made(ids, held)


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(id_, sketch(signature(items, _WIDE_A, _WIDE_B))) for id_, items in _chosen(batch)]
        if rows:
            table = np.array([r for _, r in rows], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), *(pa.array(table[:, k].copy()) for k in range(len(WIDE)))], ["id", *WIDE])


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s0, s1, text) of the classes ``ids``, from the document that stands for each.  Their number has no bound: merge joins at every size."""
    asked = classes.select("id", F.col("rep").alias("doc_id"), "crc", "s0", "s1").join(ids.hint("merge"), "id", "left_semi")
    found = docs.join(asked.hint("merge"), ["doc_id", "crc"]).withColumn("same", F.xxhash64("text"))
    return found.dropDuplicates(["id", "same"]).select("id", "s0", "s1", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full shingle sets reach the threshold.  Only texts that occur in a pair are shingled again."""
    needed = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    sets = _texts(docs, classes, needed).mapInArrow(frugal(_sets), "id long, items array<long>")
    left, right = sets.withColumnsRenamed({"id": "u", "items": "left_items"}), sets.withColumnsRenamed({"id": "v", "items": "right_items"})
    both = pairs.hint("merge").join(left, "u").hint("merge").join(right, "v").withColumn("n", F.size(F.array_intersect("left_items", "right_items")))
    return both.filter(100 * F.col("n") >= percent * (F.size("left_items") + F.size("right_items") - F.col("n"))).select("u", "v")


def _alike(a: str, b: str, percent: int, columns: list[str], values: int):
    """Sizes that can reach the threshold, and enough values whose two bits agree."""
    differing = F.lit(0)
    for name in columns:
        x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
        differing = differing + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    agree = (1 + 3 * percent / 100) / 4
    most = int(values * (1 - agree) + 5.3 * (values * agree * (1 - agree)) ** 0.5) + 1
    sizes = F.least(f"{a}.n_shingles", f"{b}.n_shingles") * 100 >= F.greatest(f"{a}.n_shingles", f"{b}.n_shingles") * percent
    return sizes & (differing <= most)


_CRCS = 1 << 32


def near_duplicates(spark: SparkSession, documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``documents(doc_id, text)``.

    Two documents are linked if 100 * |A n B| >= percent * |A u B| for their sets of
    distinct five-word shingles; component_id is the smallest doc_id that links reach.
    Null and empty texts, and texts of white space, have an empty set: they link with
    nothing and are kept.  Texts under five words have their whole word sequence as one
    shingle.  Rows without a doc_id come back with a null component_id and are kept.
    Rows that repeat a doc_id are linked by it, whatever their texts, so an id has one
    component.  Other columns of the input are ignored, and an empty input gives an empty
    result.
    """
    ship(spark)
    scratch = Scratch(spark, "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.crc32("text").alias("crc"), "text")
    signed = scratch.table(docs.mapInArrow(frugal(_signed), SIGNED), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # One document of a class stands for all its copies: that of the smallest doc_id, and checksum where rows repeat that.
    row = (F.col("doc_id").cast("decimal(20,0)") * F.lit(_CRCS).cast("decimal(11,0)") + F.col("crc").cast("decimal(11,0)")).cast("decimal(31,0)")
    crc = F.pmod("row", F.lit(_CRCS).cast("decimal(31,0)"))
    equal = usable.groupBy("s0", "s1").agg(F.min(row).alias("row"), F.min("n_shingles").alias("n_shingles"), *(F.min(b).alias(b) for b in SKETCH))
    rep = ((F.col("row") - crc) / F.lit(_CRCS).cast("decimal(11,0)")).cast("long")
    # Classes are numbered in the order of their documents, so that a bucket's hub is the earliest, of which near copies are
    # mostly made; and written, so that the numbers, which depend on the partition, are made once.
    equal = equal.repartitionByRange("row").sortWithinPartitions("row")
    classes = scratch.table(equal.select(F.monotonically_increasing_id().alias("id"), "s0", "s1", rep.alias("rep"), crc.cast("long").alias("crc"), "n_shingles", *SKETCH), "classes")
    reps = usable.select("s0", "s1", "doc_id", "crc", "bands").join(classes.select("id", "s0", "s1", F.col("rep").alias("doc_id"), "crc"), ["s0", "s1", "doc_id", "crc"]).select("id", "bands")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key")).distinct()
    shared = rows.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("band", "key", "hub")
    members = scratch.table(rows.join(shared, ["band", "key"]), "members")
    scratch.release()
    info = classes.select("id", "n_shingles", *SKETCH)

    spokes = members.filter("id <> hub").select("id", "hub").distinct()
    near = (
        spokes.join(info.alias("a"), "id").select("id", "hub", F.struct("n_shingles", *SKETCH).alias("a"))
        .join(info.withColumnRenamed("id", "hub").select("hub", F.struct("n_shingles", *SKETCH).alias("b")), "hub")
        .filter(_alike("a", "b", percent, SKETCH, 2 * PERMUTATIONS))
    )
    pairs = scratch.table(near.select(F.col("id").alias("u"), F.col("hub").alias("v")), "pairs")
    links = scratch.table(confirmed(pairs, docs, classes, percent), "links")
    scratch.release()
    first = scratch.table(components(links, scratch, "first"), "first")

    # Buckets that still hold several components: compare across components, the hub's pairs being settled.
    # A pair is taken in the first bucket that it shares, so that no later one repeats it.
    placed = members.join(first, "id", "left").select("band", "key", "id", "hub", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "key")
    rest = scratch.table(placed.filter("id <> hub").join(mixed, ["band", "key"], "left_semi").select("band", "key", "id", "component"), "rest")
    ids = rest.select("id").distinct()
    wide = _texts(docs, classes, ids).mapInArrow(frugal(_widened), "id long, " + ", ".join(f"{w} long" for w in WIDE))
    bands = reps.join(ids, "id", "left_semi").dropDuplicates(["id"])
    known = scratch.table(info.join(wide, "id").join(bands, "id"), "known")
    rest = rest.join(known, "id")
    first_shared = F.array_position(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), True) == F.col("a.band") + 1
    more = (
        rest.alias("a").join(
            rest.alias("b"),
            (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") > F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
            & _alike("a", "b", percent, SKETCH, 2 * PERMUTATIONS) & _alike("a", "b", percent, WIDE, 2 * WIDE_PERMUTATIONS) & first_shared,
        )
        .select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    )
    more = scratch.table(more, "more")
    scratch.drop("members", "pairs", "links", "rest", "known")
    scratch.release()
    across = confirmed(more, docs, classes, percent)
    # Classes of rows that repeat one doc_id are linked by it.
    placed = usable.select("doc_id", "n_shingles", "s0", "s1").join(classes.select("id", "s0", "s1"), ["s0", "s1"]).select("doc_id", "n_shingles", "id")
    placed = scratch.table(placed, "placed")
    hubs = placed.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("last")).filter("v < last").select("doc_id", "v")
    same = placed.select("doc_id", "id").join(hubs, "doc_id").select(F.col("id").alias("u"), "v").filter("u <> v")
    joined = scratch.table(first.select(F.col("id").alias("u"), F.col("component").alias("v")).filter("u <> v").unionByName(across).unionByName(same), "joined")
    final = scratch.table(components(joined, scratch, "final"), "final")

    whole = classes.select("id", "rep").join(final, "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = scratch.table(whole.join(least, "component").select("id", "component_id"), "component")
    with_set = placed.join(of, "id").select("doc_id", "n_shingles", "component_id")
    # A row without words has the component of another row of its doc_id, if there is one.
    without = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles")
    others = with_set.join(without.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    without = without.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    scratch.drop("classes", "first", "more", "joined", "final")
    scratch.release()
    return with_set.unionByName(without).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, documents: DataFrame, percent: int = 75) -> DataFrame:
    """``documents`` with one row of each group of near copies, that of the smallest doc_id; rows without a doc_id stay.

    Of several rows with that doc_id the one stays whose text has the smallest hash, and
    any of those with equal texts.  Columns of any name are handed through.
    """
    kept = near_duplicates(spark, documents, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    packed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.struct("*").alias("row"))
    ties = packed.groupBy("doc_id").agg(F.min("tie").alias("tie"), F.count("*").alias("n")).join(kept, "doc_id", "left_semi")
    found = packed.join(ties, ["doc_id", "tie"])
    once = found.filter("n = 1").select("doc_id", "row").unionByName(found.filter("n > 1").select("doc_id", "row").dropDuplicates(["doc_id"]))
    return once.select("row.*").unionByName(documents.filter(F.col("doc_id").cast("long").isNull()))
