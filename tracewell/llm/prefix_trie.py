"""Trie of conversation prefixes, named by prefix doubling.

A node is a distinct sequence of first d turns. Turns get dense names (integers from 1 on, equal for equal turns). Blocks of
2^k turns are named by the pairs of names of their halves, so the blocks of all sizes take about as many rows as there are
turns and as many rounds as the longest conversation has binary digits. A prefix of d turns is named by the pair of the
prefix without its last binary block and that block; prefixes with long last blocks come first, so again each round is one
join on (conversation, depth) and one naming. Names come from exact grouping, never from hashes of names; a turn is told by the
SHA-256 of its role and text.

Sums over subtrees don't walk the trie. A node belongs to its smallest member, so a conversation owns the nodes of its own
path from some depth on. What hangs below a node is, for each of its members, what that member owns from the node's depth on:
all of it, unless the member owns the node itself. So a sum over a subtree is one suffix sum along the owner's path, plus one
sum over the other members, grouped by node.

At scale: conversations of any length are split over tasks (turns are placed within ranges of the sorted table and counted
over the ranges; paths are summed in stretches of `STRETCH` turns). Names that many rows share are joined back through a table of
at most `common.HOT_KEYS` rows, all others by a shuffle. Groupings are plain aggregates, combined before their exchange. The
ids that end at a node are put together in sorted pieces; where a node has several, they pass through one digest in order, piece
by piece, as SHA-256 demands, without being held.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then by role and text, so ties and
repeated rows count each and give the same on every run; rows with a null conv_id take no part; an empty table gives no rows, not
even a root; other columns are ignored, whatever their names. `c - c % 20` and its remainder have the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_names, materialize, numbered, release

STRETCH = 4096
PIECE_IDS = 4000
WORD = r"[^\x20\x09-\x0D]+"


def rebuilt_head(conv: Column) -> Column:
    """How many turns of the family's first conversation replace a conversation's own: crc32 of its number, modulo 4."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("long")


def placed_turns(conversations: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, turn, words) of rebuilt conversations, pos from 1, and (conv, n): all conversations, the turnless too."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv is not null")
    rows = rows.select("conv", "at", "role", "text", F.monotonically_increasing_id().alias("row"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of the whole order: a conversation of any length lies in as many of them as it fills
    order = ("conv", F.asc_nulls_first("at"), "role", "text", "row")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    turn = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    own = materialize(dealt.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("g"), turn.alias("turn"), words.alias("words")), "turns")

    ranges = own.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("g0"))
    before = Window.partitionBy("conv").orderBy("part")
    ranges = ranges.withColumn("before", F.sum("n").over(before) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("conv")))
    first = F.col("conv") - F.col("conv") % family
    convs = ranges.select("conv", "part", (F.col("before") + 1 - F.col("g0")).alias("shift"), "total", first.alias("first"), rebuilt_head(F.col("conv")).alias("h"))
    totals = ranges.select(F.col("conv").alias("first"), F.col("total").alias("first_total")).distinct()
    convs = convs.join(totals, "first", "left").withColumn("taken", F.least("h", F.coalesce("first_total", F.lit(0)))).drop("first_total")
    convs = materialize(convs, "ranges")

    kept = own.join(convs.hint("merge"), ["conv", "part"]).withColumn("pos", F.col("g") + F.col("shift")).filter("pos > h")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "words")
    one = convs.select("conv", "first", "h", "taken", "total").distinct()
    heads = own.filter(F.col("conv") % family == 0).join(convs.select("conv", "part", "shift").hint("merge"), ["conv", "part"])
    heads = heads.withColumn("pos", F.col("g") + F.col("shift")).filter("pos <= 3").select(F.col("conv").alias("first"), "pos", "turn", "words")
    heads = one.filter("taken > 0").join(heads, "first").filter("pos <= taken").select("conv", "pos", "turn", "words")
    turns = materialize(kept.unionByName(heads), "rebuilt")
    lengths = materialize(one.select("conv", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("n")), "lengths")
    discard(own, convs)
    return turns, lengths


def _named(pairs: DataFrame, keys: list[str], label: str, keep: list[str]) -> DataFrame:
    """Rows with a dense name of their keys: equal keys, equal names."""
    stored = materialize(pairs, f"{label}-pairs")
    counted = materialize(stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), f"{label}-distinct")
    out = materialize(join_names(stored, numbered(counted, "name"), keys).select(*keep, "name"), label)
    discard(stored, counted)
    return out


def named_prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, name, words) of every prefix of every conversation, the empty one named 0; words are the last turn's."""
    longest = lengths.agg(F.max("n")).first()[0] or 0
    blocks = [_named(turns.select("conv", (F.col("pos") - 1).alias("j"), "turn"), ["turn"], "block-0", ["conv", "j"])]
    while 2 << len(blocks) - 1 <= longest:
        half = blocks[-1]
        pairs = half.groupBy("conv", F.shiftright("j", 1).alias("i")).agg(F.max(F.expr("if(j % 2 = 0, name, null)")).alias("left"), F.max(F.expr("if(j % 2 = 1, name, null)")).alias("right"))
        pairs = pairs.filter("left is not null and right is not null").select("conv", F.col("i").alias("j"), "left", "right")
        blocks.append(_named(pairs, ["left", "right"], f"block-{len(blocks)}", ["conv", "j"]))
    found = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))
    levels, first = [], 1
    for k in range(len(blocks) - 1, -1, -1):
        size = 1 << k
        # prefixes whose last binary block has `size` turns: one found before, and the block after it
        after = blocks[k].filter("j % 2 = 0").select("conv", (F.col("j") * size).alias("depth"), F.col("name").alias("block"))
        pairs = found.join(after.hint("merge"), ["conv", "depth"]).select("conv", (F.col("depth") + size).alias("depth"), "name", "block")
        named = _named(pairs.withColumnRenamed("name", "prefix"), ["prefix", "block"], f"prefix-{k}", ["conv", "depth"])
        levels.append(named)
        most = named.agg(F.max("name")).first()[0]
        found = found.unionByName(named.withColumn("name", F.col("name") + F.lit(first)))  # apart from other rounds' names
        first += 0 if most is None else most + 1
    words = turns.select("conv", F.col("pos").alias("depth"), "words").unionByName(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words")))
    out = materialize(found.join(words.hint("merge"), ["conv", "depth"]), "prefixes")
    discard(*blocks, *levels)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of runs of one node in sorted (node, conv) rows: (node, first, ids)."""
    node, held = None, []
    out: list[tuple] = []

    def close() -> None:
        if held:
            out.append((node, held[0], ",".join(map(str, held))))

    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node or len(held) >= PIECE_IDS:
                close()
                node, held = own, []
            held.append(conv)
        if len(out) >= 2000:
            yield _piece_batch(out)
            out = []
    close()
    yield _piece_batch(out)
    release()


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas, from rows sorted by (node, first); one piece is held at a time."""
    node, digest, out = None, None, []
    for batch in batches:
        for own, piece in zip(batch.column(0), batch.column(1), strict=True):
            own, data = own.as_py(), piece.as_py().encode()
            if own != node:
                if digest:
                    out.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(data)
            else:
                digest.update(b"," + data)
    if digest:
        out.append((node, digest.hexdigest()))
    a, b = zip(*out, strict=True) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string())], names=["node", "ends"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the comma-joined conv ids of each node, in ascending order, from rows (node, conv)."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = ends.select("node", "conv").repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv")
    pieces = materialize(sorted_rows.mapInArrow(_pieces, "node long, first long, ids string"), "end-pieces")
    count = pieces.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    tagged = pieces.join(count.hint("merge"), "node")
    single = tagged.filter("k = 1").select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))
    several = tagged.filter("k > 1").select("node", "first", "ids").repartition(n, "node").sortWithinPartitions("node", "first").select("node", "ids")
    out = materialize(single.unionByName(several.mapInArrow(_digests, "node long, ends string")), "ends")
    discard(pieces)
    return out


def prefix_trie(conversations: DataFrame, family: int = 20) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    turns, lengths = placed_turns(conversations, family)
    rows = named_prefixes(turns, lengths)
    discard(turns)
    up = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = rows.groupBy("name").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    # a node's parent is on its owner's path
    nodes = materialize(nodes.join(up.hint("merge"), ["conv", "depth"], "left"), "nodes-bare")
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "name")
    full = nodes.join(children.hint("merge"), "name", "left").fillna(0, ["n_children"])
    full = full.withColumn("leaf", F.expr("if(n_children = 0, 1L, 0L)")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    full = materialize(full, "nodes")

    # what an owner has from each depth on, in stretches of its path
    cut = F.floor(F.col("depth") / STRETCH)
    parts = full.groupBy("conv", cut.alias("stretch")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saving"), F.min("depth").alias("top"))
    later = Window.partitionBy("conv").orderBy(F.desc("stretch"))
    parts = materialize(
        parts.select("conv", "stretch", "top", (F.sum("leaves").over(later) - F.col("leaves")).alias("leaves_after"), (F.sum("saving").over(later) - F.col("saving")).alias("saving_after"), "leaves", "saving"),
        "stretches",
    )
    inner = Window.partitionBy("conv", "stretch").orderBy(F.desc("depth"))
    below = full.withColumn("stretch", cut).join(parts.select("conv", "stretch", "leaves_after", "saving_after").hint("merge"), ["conv", "stretch"])
    below = below.withColumn("leaves", F.sum("leaf").over(inner) + F.col("leaves_after")).withColumn("saving", F.sum("saved").over(inner) + F.col("saving_after"))

    # members that don't own the node bring all they own
    owners = parts.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saving").alias("saving"), (F.min("top") - 1).alias("last"))
    owners = owners.filter("last >= 0 and (leaves <> 0 or saving <> 0)").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / STRETCH))))
    guests = rows.withColumn("stretch", cut).join(owners.hint("merge"), ["conv", "stretch"]).filter("depth <= last")
    guests = guests.groupBy("name").agg(F.sum("leaves").alias("guest_leaves"), F.sum("saving").alias("guest_saving"))

    last = lengths.select("conv", F.col("n").alias("depth"))
    ends = end_digests(rows.join(last.hint("merge"), ["conv", "depth"]).select(F.col("name").alias("node"), "conv"))
    parents = full.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    out = below.join(guests.hint("merge"), "name", "left").join(ends.withColumnRenamed("node", "name").hint("merge"), "name", "left")
    out = join_names(out, parents, ["parent"], how="left", counted=full.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("n_children").alias("n")))
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaves") + F.coalesce("guest_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saving") + F.coalesce("guest_saving", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )
