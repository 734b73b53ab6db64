"""Exact set-similarity joins: what the joins of lines and of documents share.

Units (lines or documents) are sets of 64-bit token hashes.  Each join makes *postings* (sig, unit columns, shape) in its own way,
such that two units of Jaccard similarity 0.75 or more share a signature.  Here units that share one are paired and verified
against their whole sets:

1. Signatures of one unit only are dropped.  Each unit is paired with the first unit of the signature and with the one
   before it, which is linear in the postings; these pairs are verified.
2. What is still open after that is paired in full, so that no link is lost: signatures of a few units by a join.  Units
   of larger signatures come together in clusters (the components that these signatures make), and a cluster is verified
   tile by tile in memory, from the overlaps of all its sets at once; a tile gives back one row per unit, never its pairs.

Sets are fetched by a second pass over the texts, from those units only that occur in a pair.  A bit map of fixed size
leaves out the others before anything is shuffled.

``shape`` packs the size of the set (high 32 bits), the position of the token in the unit's order, and in the lowest bit
whether the signature is a combination.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.components import components
from changeloom.session import durable

# Token frequencies are counted in this many buckets (2**16 rows at most reach the driver, 512 KB are broadcast).
SKETCH_BITS = 16
# Bits of the map of units whose texts are fetched (512 KB; more bits let fewer needless texts through).  It is collected as words
# of 64 bits, 2**16 rows at most.
MAP_BITS = 22
# Similarity 3/4: overlap / (a + b - overlap) >= 3/4 is the same as 7 * overlap >= 3 * (a + b).
SHARE, OF_SUM = 7, 3
# Signatures of more open units than this are verified by clusters, in tiles of so many units.
HEAVY, TILE = 128, 512
# Within a tile, tokens of more units than this are counted by a matrix product, others one by one.
DENSE = 12
# Frequent tokens fall into so many groups.
GROUPS = 8
# So many sets are remembered by a task, to leave out equal ones early; then it forgets them, and the shuffle finds the rest.
REMEMBERED = 100_000


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch_of(counts: DataFrame) -> np.ndarray:
    """Sum (bucket, n) rows; at most 2**SKETCH_BITS rows reach the driver."""
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row[0]] = row[1]
    return out


def errors_allowed(n: int) -> int:
    """Most tokens of a set of size n that a similar set can lack."""
    return n - -(-3 * n // 4)


def size_of(shape: str) -> Column:
    return F.shiftright(F.col(shape), 32)


def place_of(shape: str) -> Column:
    return F.shiftright(F.col(shape).bitwiseAND(F.lit(0xFFFFFFFF)), 1)


def may_match(a: str, b: str) -> Column:
    """Length and positional filter for the shapes of two postings of one signature.

    If the shared token is the first that both have, the overlap is at most 1 plus what follows in the shorter rest.  If it isn't,
    the pair also meets in the signature of the first.  A combination may be preceded by one shared token of each other group.
    """
    rest = F.least(size_of(a) - place_of(a), size_of(b) - place_of(b))
    before = F.when(F.col(a).bitwiseAND(F.lit(1)) == 1, F.least(F.lit(GROUPS - 1), place_of(a), place_of(b))).otherwise(0)
    return F.lit(SHARE) * (rest + before) >= F.lit(OF_SUM) * (size_of(a) + size_of(b))


def shared(postings: DataFrame, unit: Sequence[str], copies: DataFrame) -> DataFrame:
    """Postings of signatures that more units than one have, without the units in ``copies``."""
    by = Window.partitionBy("sig").orderBy(*unit)
    marked = postings.select("sig", *unit, "shape", F.lag("shape").over(by).alias("_before"), F.lead("shape").over(by).alias("_after"))
    found = marked.where("_before IS NOT NULL OR _after IS NOT NULL").drop("_before", "_after")
    return durable(found.join(copies, list(unit), "left_anti"))


def first_pairs(found: DataFrame, unit: Sequence[str]) -> DataFrame:
    """One pair (a, b), a < b, for each unit b at most: the earlier unit that is most often first in b's signatures or just
    before b in them."""
    by = Window.partitionBy("sig").orderBy(*unit)
    row = F.struct(F.struct(*unit).alias("a"), "shape")
    near = found.select(F.struct(*unit).alias("b"), "shape", F.lag(row).over(by).alias("before"), F.first(row).over(
        by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first"))
    both = near.where("before IS NOT NULL").select("b", "shape", F.explode(F.array_distinct(F.array("first", "before"))).alias("other"))
    pairs = both.where("other.a < b").where(may_match("other.shape", "shape")).groupBy(F.col("other.a").alias("a"), "b").count()
    return pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("count"), "a")).alias("a")).select("a", "b")


def bit_map(units: DataFrame) -> np.ndarray:
    """Bits of the units (struct column u), of fixed size."""
    place = F.pmod(F.xxhash64("u"), F.lit(1 << MAP_BITS))
    words = units.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
    bits = np.zeros(1 << MAP_BITS - 6, np.int64)
    for word, value in words.collect():
        bits[word] = value
    return bits.view(np.uint64)


def split_by(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be in ``ids`` (column doc_id), rows whose doc_id is not), by a bit map: only the former need a join."""
    bits = bit_map(ids.select(F.struct("doc_id").alias("u")))
    wanted = F.arrow_udf(lambda column: pa.array(in_map(bits, np.asarray(column))), "boolean")
    key = F.col("doc_id").cast("bigint")
    maybe = key.isNotNull() & wanted(F.coalesce(key, F.lit(0).cast("bigint")))
    return documents.where(maybe), documents.where(~maybe)


def fetched(units: DataFrame, texts: Callable[[np.ndarray], DataFrame], unit: Sequence[str]) -> DataFrame:
    """(u, text) of the distinct units u, and of a few others that the bit map lets through.  A unit that several rows share
    has all their texts."""
    # Dealt by unit, which serves both the distinct rows and the join that follows.
    return texts(bit_map(units)).select(F.struct(*unit).alias("u"), "text").repartition("u").distinct()


def bits_of(tokens: np.ndarray) -> bytes:
    """Map of the lowest bits of a set's tokens; it has two to four bits per token, so it is small beside the text."""
    size = max(64, 2 << int(len(tokens) - 1).bit_length()) if len(tokens) else 64
    found = np.zeros(size, bool)
    found[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(found, bitorder="little").tobytes()


def may_be_similar(n: int, one: bytes, m: int, two: bytes) -> bool:
    """Whether sets of n and m tokens with these maps can have a similarity of 0.75.

    Each bit that differs comes from a token of only one of the sets, so they share (n + m - differing) / 2 tokens at most.  The
    longer map is folded to the length of the shorter, whose bits are the lower ones of the same hash.
    """
    a, b = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    long, short = len(one), len(two)
    if long < short:
        a, b, long, short = b, a, short, long
    while long > short:
        long //= 2
        a = (a >> 8 * long) | (a & ((1 << 8 * long) - 1))
    return SHARE * (n + m - (a ^ b).bit_count()) >= 2 * OF_SUM * (n + m)


def promising(pairs: DataFrame, maps: Callable[[np.ndarray], DataFrame], unit: Sequence[str]) -> DataFrame:
    """The pairs that the maps of their sets leave open; maps are moved instead of texts, and no similar pair is lost.
    ``maps(bit map)`` gives (unit, n, bits) of all units in the map at least."""
    near = maps(bit_map(pairs.select(F.explode(F.array("a", "b")).alias("u"))))
    maps = near.select(F.struct(*unit).alias("u"), F.struct("n", "bits").alias("map")).repartition("u")
    both = pairs.join(maps.select(F.col("u").alias("a"), F.col("map").alias("map_a")), "a").join(
        maps.select(F.col("u").alias("b"), F.col("map").alias("map_b")), "b")

    @F.arrow_udf("boolean")
    def open_(n: pa.Array, one: pa.Array, m: pa.Array, two: pa.Array) -> pa.Array:
        columns = (x.to_pylist() for x in (n, one, m, two))
        return pa.array([may_be_similar(*x) for x in zip(*columns)], pa.bool_())

    return durable(both.where(open_("map_a.n", "map_a.bits", "map_b.n", "map_b.bits")).select("a", "b").distinct())


def maps_from(texts: Callable[[np.ndarray], DataFrame], unit: Sequence[str],
              sets: Callable[[pa.Array], Iterator[np.ndarray]]) -> Callable[[np.ndarray], DataFrame]:
    """(unit, n, bits) of the units in a bit map, made from their texts."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sets(batch.column(len(unit))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(unit)], pa.array([len(x) for x in found], pa.int64()), pa.array(map(bits_of, found), pa.binary())],
                names=[*unit, "n", "bits"])

    return lambda bits: texts(bits).select(*unit, "text").mapInArrow(
        sketch, ", ".join(f"{c} bigint" for c in unit) + ", n bigint, bits binary")


def verified(pairs: DataFrame, texts: Callable[[np.ndarray], DataFrame], unit: Sequence[str],
             sets: Callable[[pa.Array], Iterator[np.ndarray]], maps: Callable[[np.ndarray], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) whose sets have a similarity of 0.75 or more.

    ``texts(bit map)`` gives (unit, text) of all units in the map at least; ``sets`` the sorted tokens of each text.  Texts, which take
    less room in a shuffle than their hashes, are moved for promising pairs only.  ``maps`` gives the units' maps where they are
    at hand; n may count repeated tokens, which only lets more pairs through.
    """
    pairs = promising(pairs, maps or maps_from(texts, unit, sets), unit)
    found = fetched(pairs.select(F.explode(F.array("a", "b")).alias("u")), texts, unit)
    with_a = pairs.join(found.select(F.col("u").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(found.select(F.col("u").alias("b"), F.col("text").alias("text_b")), "b")

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([SHARE * len(np.intersect1d(x, y, assume_unique=True)) >= OF_SUM * (len(x) + len(y))
                         for x, y in zip(sets(a), sets(b))], pa.bool_())

    return durable(with_b.where(similar("text_a", "text_b")).select("a", "b").distinct())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    tokens = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    owner, tokens = owner[order], tokens[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(tokens)))
    dense = np.flatnonzero(size > DENSE)
    for part in np.array_split(dense, len(dense) // 2048 + 1):
        member = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), size[part])
        rows = np.repeat(at[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        member[owner[rows], column] = 1
        out += member @ member.T
    for k in range(2, DENSE + 1):
        group = owner[at[size == k][:, None] + np.arange(k)]
        for part in np.array_split(group, len(group) * k * k // 2_000_000 + 1):
            both = part[:, :, None] * n + part[:, None, :]
            out += np.bincount(both.ravel(), minlength=n * n).reshape(n, n)
    out[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return out


def _tile(table: pa.Table, sets: Callable[[pa.Array], Iterator[np.ndarray]]) -> pa.Table:
    """Links of two tiles (or within one): per unit the first earlier unit it links with, and the first of its component."""
    table = table.take(pa.array(np.lexsort([np.asarray(table[c]) for c in reversed(table.column_names) if c.startswith("u_")])))
    kept = list(sets(table["text"].combine_chunks()))
    size = np.array([len(x) for x in kept])
    linked = SHARE * overlaps(kept) >= OF_SUM * (size[:, None] + size[None, :])
    linked &= (size > 0)[:, None] & (size > 0)[None, :]
    # Texts of one unit don't link with each other.
    unit = np.unique(np.stack([np.asarray(table[c]) for c in table.column_names if c.startswith("u_")]), axis=1, return_inverse=True)[1]
    linked &= unit[:, None] != unit[None, :]
    n = len(size)
    earlier = np.where(np.tril(linked).any(axis=1), np.tril(linked).argmax(axis=1), -1)
    root = np.arange(n)
    while n:
        new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = np.flatnonzero((earlier >= 0) | (root < np.arange(n)))
    names = [c for c in table.column_names if c.startswith("u_")]
    columns = {f"b_{c[2:]}": np.asarray(table[c])[keep] for c in names}
    columns |= {f"r_{c[2:]}": np.asarray(table[c])[root[keep]] for c in names}
    return pa.table(columns | {"links": earlier[keep] >= 0})


def cluster_links(heavy: DataFrame, texts: Callable[[np.ndarray], DataFrame], unit: Sequence[str],
                  sets: Callable[[pa.Array], Iterator[np.ndarray]]) -> DataFrame:
    """(b, root, links) from the postings (sig, unit, shape) of heavy signatures: units of each cluster that link with others,
    an earlier unit that b is connected with, and whether b itself links with an earlier one."""
    node = F.xxhash64(*unit)
    # Clusters are named by hashes of units; two that share a name are verified together, which changes nothing.
    first = heavy.groupBy("sig").agg(F.min(node).alias("a"))
    edges = heavy.select("sig", node.alias("b")).join(first, "sig").select("a", "b")
    named = components(edges).withColumnRenamed("u", "c")
    # Similar sets have sizes within 4 : 3, so they are at most two size classes apart.
    size = F.floor(F.log(size_of("shape")) / F.lit(float(np.log(1.16)))).cast("bigint")
    units = durable(heavy.select(F.struct(*unit).alias("u"), node.alias("v"), size.alias("class")).distinct().join(
        named, "v", "left").select("u", F.coalesce("c", "v").alias("cluster"), "class"))
    tiles = units.groupBy("cluster", "class").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("bigint").alias("k"))
    own = F.pmod(F.xxhash64("u", F.lit(1)), F.col("k"))
    placed = units.join(tiles, ["cluster", "class"]).select("u", "cluster", "class", (F.col("class") * (1 << 32) + own).alias("own"))
    near = tiles.select("cluster", F.explode(F.sequence(F.col("class") - 2, F.col("class") + 2)).alias("class"),
                        (F.col("class") * (1 << 32)).alias("start"), "k")
    spread = placed.join(near, ["cluster", "class"]).withColumn(
        "other", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)))
    rows = spread.join(fetched(units, texts, unit), "u").select(
        "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        *[F.col(f"u.{c}").alias(f"u_{c}") for c in unit], "text")
    fields = [f"{p}_{c} bigint" for p in "br" for c in unit]
    found = rows.groupBy("cluster", "low", "high").applyInArrow(lambda table: _tile(table, sets), ", ".join([*fields, "links boolean"]))
    return durable(found.select(*[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in unit]).alias(name)
                                  for p, name in (("b", "b"), ("r", "root"))], "links").distinct())


def in_map(bits: np.ndarray, *unit: np.ndarray) -> np.ndarray:
    """Whether the units are in the bit map; hashes as Spark's xxhash64 does over the 64-bit unit columns."""
    seed = np.full(len(unit[0]), 42, np.uint64)
    for column in unit:
        seed = _xxhash64_long(column.astype(np.int64).view(np.uint64), seed)
    place = seed.view(np.int64) % np.int64(64 * len(bits))
    return (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _xxhash64_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The published 64-bit xxHash of one 8-byte value.  Fixed values: its five primes."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = seed + p5 + np.uint64(8)
    h = h ^ (_rotate(value * p2, 31) * p1)
    h = _rotate(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))
