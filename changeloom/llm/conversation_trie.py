"""Prefix trie of rebuilt conversations, from fingerprints that compose.

A rebuilt conversation is the head of one stored conversation followed by the tail of another.  Neither is ever joined into
a text.  Each stored turn is a letter, a hash of its role and text in four fields of prime size; a sequence of letters
has the product

    value(x_0 ... x_n-1) = x_0 + x_1 B + ... + x_n-1 B**(n-1)  (mod p),   value(uv) = value(u) + B**|u| value(v)

so one running sum per stored conversation gives the value of any of its stretches, and the value of a rebuilt prefix is
put together from the head's and the tail's.  Taking the last letter off gives the parent's value.

Equal values make one node.  That they stand for equal turns is verified through the stored turns that the members refer
to: turns of one letter must agree in role and text, and the members of a node in their last letter; as their parents are
one node as well, whole prefixes are equal by induction.  If a letter or a node fails, all is done again with other letters.

Sums over subtrees follow paths: the nodes with the same smallest member form one path down, and paths form a tree that is
summed by pointer doubling, in a number of rounds that grows with the logarithm of its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scale import numbered, position_block, sums_before
from changeloom.session import durable

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525, 134_775_813, 214_013)
LANES = range(len(BASES))
# Powers of the bases are products of table entries: a position has up to three digits to the base DIGIT.
DIGIT = 2048
# Ids are put in order in blocks of this many.
ID_BLOCK = 65_536
MAX_ROUNDS = 64


def _power(lane: int, exponent: Column) -> Column:
    """BASES[lane] ** exponent modulo PRIME, for exponents from 0 to DIGIT ** 3 - 1."""
    product = None
    for place in range(3):
        unit = pow(BASES[lane], DIGIT ** place, PRIME)
        table = F.split(F.lit(",".join(map(str, _powers(unit)))), ",").cast("array<bigint>")
        digit = F.pmod(F.floor(exponent / F.lit(DIGIT ** place)), F.lit(DIGIT)).cast("int")
        factor = F.get(table, digit)
        product = factor if product is None else F.pmod(product * factor, F.lit(PRIME))
    return product


def _powers(unit: int) -> list[int]:
    out = [1]
    for _ in range(DIGIT - 1):
        out.append(out[-1] * unit % PRIME)
    return out


def _mod(value: Column) -> Column:
    return F.pmod(value, F.lit(PRIME))


def head_base(conv: Column) -> Column:
    return conv - conv % 5


def head_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 9


def stored_turns(conversations: DataFrame, salt: int = 0) -> DataFrame:
    """(conv_id, ix, bytes, x0 .. x3, v0 .. v3): the turns of each conversation, numbered from 0 by turn number (NULL first),
    with their letter and the value of the conversation up to and including the turn.

    NULL roles and texts are empty.  Turns of the same number are ordered by a hash of role and text; rows that agree in
    everything are turns of their own.  Rows without conv_id belong to no conversation and are left out.  Whole texts are
    hashed where they are read, and aren't moved.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    letters = [_mod(F.xxhash64(F.lit(f"{salt}/{lane}"), role, text)).alias(f"x{lane}") for lane in LANES]
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.octet_length(text).cast("bigint").alias("bytes"), *letters)
    order = [F.asc_nulls_first("turn"), *[F.col(f"x{lane}") for lane in LANES]]
    block = position_block("turn")
    placed = numbered(narrow, ["conv_id"], block, order, "_no").withColumn("ix", F.col("_no") - 1)
    letters_in_place = {f"t{i}": _mod(F.col(f"x{i}") * _power(i, F.col("ix"))) for i in LANES}
    placed = placed.select("conv_id", "ix", "bytes", *[f"x{i}" for i in LANES]).withColumns(letters_in_place)
    placed = sums_before(placed, ["conv_id"], position_block("ix"), [F.col("ix")], {f"v{i}": F.col(f"t{i}") for i in LANES})
    placed = placed.withColumns({f"v{i}": _mod(F.col(f"v{i}") + F.col(f"t{i}")) for i in LANES})
    return placed.select("conv_id", "ix", "bytes", *[f"x{i}" for i in LANES], *[f"v{i}" for i in LANES])


def letters_differ(conversations: DataFrame, salt: int = 0) -> bool:
    """Whether two turns of equal letter differ in role or text.  Copies are reduced where they are read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    letters = [_mod(F.xxhash64(F.lit(f"{salt}/{lane}"), role, text)).alias(f"x{lane}") for lane in LANES]
    turns = conversations.where("conv_id IS NOT NULL").select(*letters, role.alias("role"), text.alias("text")).groupBy(
        *[f"x{i}" for i in LANES]).agg(F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"),
                                       F.max("text").alias("t1"))
    return not turns.where("r0 <> r1 OR t0 <> t1").isEmpty()


def rebuilt_turns(turns: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """(conv_id, depth, f0 .. f3, x0 .. x3, bytes, turn_conv_id, turn_ix, ends): every prefix of every rebuilt conversation with
    its value, last letter and a reference to the stored turn at its end; depth 0 is the empty prefix.

    ``base`` and ``head`` are expressions of ``conv_id``: whose first turns come first, and how many, at most ``longest_head``.
    """
    ix = F.col("ix")
    # The last turn before the tail is the one at head - 1, or the last of all.
    before = F.when(ix < F.col("head"), F.struct("ix", *[f"v{i}" for i in LANES]))
    convs = turns.withColumn("head", head).withColumn("base", base).groupBy("conv_id").agg(
        F.max("head").alias("head"), F.max("base").alias("base"), F.count(F.lit(1)).alias("n"), F.max(before).alias("own"))
    heads = turns.where(ix < longest_head).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(
        F.struct("ix", "bytes", *[f"x{i}" for i in LANES], *[f"v{i}" for i in LANES]))).alias("stored"))
    convs = convs.join(heads, "base", "left").withColumn("stored", F.slice(F.coalesce(
        "stored", F.array().cast(heads.schema["stored"].dataType)), F.lit(1), F.col("head").cast("int")))
    convs = convs.withColumn("n_head", F.size("stored").cast("bigint")).withColumn(
        "length", F.col("n_head") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    last = F.get(F.col("stored"), (F.col("n_head") - 1).cast("int"))
    missing = F.col("head") - F.col("n_head")
    # What a tail's value must be raised by: the head's value less the own first turns', in their new place.
    shifts = []
    for lane in LANES:
        back = F.get(F.array(*[F.lit(pow(BASES[lane], -j, PRIME)).cast("bigint") for j in range(longest_head + 1)]),
                     missing.cast("int"))
        shifts += [back.alias(f"back{lane}"), _mod(F.coalesce(last[f"v{lane}"], F.lit(0)) - _mod(
            back * F.coalesce(F.col("own")[f"v{lane}"], F.lit(0)))).alias(f"add{lane}")]
    from_head = convs.select("conv_id", "base", "length", F.explode("stored").alias("s")).select(
        "conv_id", (F.col("s.ix") + 1).alias("depth"), *[F.col(f"s.v{i}").alias(f"f{i}") for i in LANES],
        *[F.col(f"s.x{i}").alias(f"x{i}") for i in LANES], F.col("s.bytes").alias("bytes"), F.col("base").alias("turn_conv_id"),
        F.col("s.ix").alias("turn_ix"), (F.col("s.ix") + 1 == F.col("length")).alias("ends"))
    tails = convs.where("n > head").select("conv_id", "head", "n_head", "length", *shifts)
    depth = F.col("n_head") + F.col("ix") - F.col("head") + 1
    from_tail = turns.join(tails, "conv_id").where(ix >= F.col("head")).select(
        "conv_id", depth.alias("depth"),
        *[_mod(F.col(f"add{i}") + _mod(F.col(f"back{i}") * F.col(f"v{i}"))).alias(f"f{i}") for i in LANES],
        *[f"x{i}" for i in LANES], "bytes", F.col("conv_id").alias("turn_conv_id"), F.col("ix").alias("turn_ix"),
        (depth == F.col("length")).alias("ends"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(f"f{i}") for i in LANES], *[zero.alias(f"x{i}") for i in LANES],
                         zero.alias("bytes"), none.alias("turn_conv_id"), none.alias("turn_ix"), (F.col("length") == 0).alias("ends"))
    return reduce(DataFrame.unionByName, [from_head, from_tail, roots])


KEY = ["depth", *[f"f{i}" for i in LANES]]


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """One row per node: key, smallest member, members, the turn at its end, the parent's key, and whether it failed."""
    same = reduce(lambda a, b: a & b, [F.min(f"x{i}") == F.max(f"x{i}") for i in LANES])
    nodes = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min(F.struct("turn_conv_id", "turn_ix")).alias("turn"), (~same).alias("mixed"),
        *[F.min(f"x{i}").alias(f"x{i}") for i in LANES])
    up = F.col("depth") - 1
    parents = [F.when(up >= 0, _mod(F.col(f"f{i}") - _mod(F.col(f"x{i}") * _power(i, F.greatest(up, F.lit(0)))))).alias(f"p{i}")
               for i in LANES]
    return nodes.select(*KEY, "conv_id", "n_convs", "bytes", "turn", "mixed", up.alias("up"), *parents)


def ends_digests(prefixes: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are sorted and joined in blocks; blocks are hashed one after the other, as SHA-256 asks for, and not collected.
    """
    block = F.floor(F.col("conv_id") / F.lit(ID_BLOCK))
    texts = prefixes.where("ends").groupBy(*KEY, block.alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            keys, digests = [], []
            ids = batch.column(len(KEY) + 1)
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(KEY))), strict=True)):
                if key == node:
                    state.update(b"," + ids[i].as_py().encode())
                    continue
                if node is not None:
                    keys.append(node)
                    digests.append(state.hexdigest())
                node, state = key, hashlib.sha256(ids[i].as_py().encode())
            yield result(keys, digests)
        if node is not None:
            yield result([node], [state.hexdigest()])

    def result(keys: list[tuple], digests: list[str]) -> pa.RecordBatch:
        columns = zip(*keys, strict=True) if keys else [[] for _ in KEY]
        return pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.int64()) for c in columns], pa.array(digests, pa.string())],
                                          names=[*KEY, "ends_sha256"])

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in KEY) + ", ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id and values) with each value summed over the node's subtree.

    Path c has the nodes of smallest member c, one per depth, and hangs on a node of path ``parent_conv_id``.
    """
    sums = [F.sum(v).alias(v) for v in values]
    paths = durable(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.min(F.struct("depth", "parent_conv_id"))["parent_conv_id"].alias("above"), *sums))
    where = paths.select("conv_id", "top", F.col("above").alias("hangs_on"))
    paths = paths.select("conv_id", "above", *values)
    trunk = paths.where("above IS NULL").agg(F.min("conv_id")).first()[0]
    # Round k adds what lies 2**k paths further down at most; ``above`` is the path 2**k further up.
    for _ in range(MAX_ROUNDS):
        hanging = paths.where("above IS NOT NULL")
        if hanging.isEmpty():
            break
        lower = hanging.groupBy(F.col("above").alias("conv_id")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        # Paths on the trunk are done with after this round, and needn't ask the trunk where it hangs.
        jumps = hanging.where(F.col("above") != F.lit(trunk)).select("conv_id", "above").join(
            paths.select(F.col("conv_id").alias("above"), F.col("above").alias("_further")), "above").select("conv_id", "_further")
        paths = durable(paths.join(lower, "conv_id", "left").join(jumps, "conv_id", "left").select(
            "conv_id", F.col("_further").alias("above"),
            *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).cast("bigint").alias(v) for v in values]))
    else:
        raise RuntimeError("paths hang too deep")
    hung = paths.join(where, "conv_id").where("hangs_on IS NOT NULL").groupBy(
        F.col("hangs_on").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    out = nodes.join(hung, ["conv_id", "depth"], "left")
    for v in values:
        out = out.withColumn(v, (F.col(v) + F.coalesce(f"_{v}", F.lit(0))).cast("bigint")).drop(f"_{v}")
    # Sums along each path, from its end up to the node.
    below = sums_before(out, ["conv_id"], -position_block("depth"), [F.desc("depth")], {f"_{v}": F.col(v) for v in values})
    return below.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, longest_head: int = 8) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (NULL at the root), n_convs, n_children, n_leaves, saved_tokens (bytes
    of last texts in the subtree that repeat), ends_sha256, and the stored turn at the node's end as turn_conv_id and turn_ix.

    Conversation c is rebuilt from the first ``head`` turns of conversation ``base`` (none if it isn't stored) and its own turns
    after as many; both are expressions of ``conv_id``.  By default these are the groups of five and CRC-32 modulo 9.
    NULLs, ties and repeated rows are treated as in ``stored_turns``; a table without conversations has no nodes.  Other columns
    than conv_id, turn, role and text aren't read.
    """
    conv = F.col("conv_id")
    base = head_base(conv) if base is None else base
    head = head_turns(conv) if head is None else head
    for salt in range(8):
        if letters_differ(conversations, salt):
            continue
        turns = durable(stored_turns(conversations, salt))
        prefixes = durable(rebuilt_turns(turns, base, head, longest_head))
        nodes = durable(trie_nodes(prefixes))
        if nodes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("no letters tell the turns apart")
    above = ["up", *[f"p{i}" for i in LANES]]
    renamed = dict(zip(KEY, above, strict=True))
    children = nodes.where("up >= 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed(
        {v: k for k, v in renamed.items()})
    parents = nodes.select(*[F.col(k).alias(v) for k, v in renamed.items()], F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.drop("mixed").join(children, KEY, "left").join(parents, above, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    linked = durable(linked.join(ends_digests(prefixes), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast(
            "bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "turn.turn_conv_id", "turn.turn_ix"))
    return subtree_sums(linked, ["n_leaves", "saved_tokens"])
