"""The prefix trie of conversations by ROLLUP over positional columns.

Every distinct turn gets a number, and a conversation becomes blocks of eight turn numbers, one column each.
A block is grouped by the node its conversation has reached before it, and ROLLUP over its columns then
aggregates all prefixes at once; grouping_id tells how long a prefix is. The node before a block is named by a digest:
full blocks are the items of a coarser sequence with blocks of its own, and so on, so that a digest is made from at
most eight items and a conversation of any length never stands in one row.

Sums over subtrees are a second ROLLUP, over nodes. What lies below the end of a block is added up in the coarser trie
first, whose nodes are the ends of blocks; the number of levels is the logarithm of the longest conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import rank_within
from packetloom.store import Store

WIDTH = 8
PIECE = 8192  # conversation ids that are hashed as one piece of text
FRONT = 6  # turns taken over: crc32(id) modulo this
NAMES = [f"t{i}" for i in range(1, WIDTH + 1)]
ROOT = b"\0" * 16


def _digest(*parts: Column) -> Column:
    """16 bytes for a list of values; trailing nulls are left out."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("/", *parts), 256)), 1, 16)


def _block_columns(items: DataFrame, more: list[Column]) -> DataFrame:
    """Items (conv_id, pos, item, ...) as one row per block of a conversation; a null item only makes the block exist."""
    at = F.col("pos") % WIDTH
    named = [F.max(F.when(at == i, F.col("item"))).alias(n) for i, n in enumerate(NAMES)]
    return items.groupBy("conv_id", F.expr(f"pos div {WIDTH}").alias("block")).agg(*named, *more)


def rebuilt_turns(conversations: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, item, points) of the rebuilt conversations, and all conversations (conv_id, n) with their lengths."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("double").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"),
        F.char_length(text).alias("points"),
    )
    ranked = store.save(rank_within(turns, ["conv_id"], ["turn", "digest"], store, "pos"), "ranked-turns")
    # numbers need not be consecutive, only the same for equal turns
    numbers = store.save(ranked.select("digest").distinct().withColumn("item", F.monotonically_increasing_id()), "distinct-turns")
    ranked = store.save(
        ranked.join(numbers.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest")).select(
            "conv_id", "pos", "item", "points"
        ),
        "numbered-turns",
    )
    lengths = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    lengths = lengths.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % FRONT).cast("int"))
    lengths = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    of_base = lengths.where("conv_id = base").select(F.col("base").alias("_base"), F.col("own").alias("_held"))
    lengths = lengths.join(of_base, F.col("base") == F.col("_base"), "left").withColumn(
        "front", F.least(F.col("h"), F.coalesce("_held", F.lit(0)))
    )
    lengths = store.save(
        lengths.select("conv_id", "h", "base", "front", (F.col("front") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")),
        "conversation-lengths",
    )
    fronts = ranked.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < FRONT - 1)).withColumnRenamed("conv_id", "base")
    taken = lengths.join(fronts, "base").where("pos < h").select("conv_id", "pos", "item", "points")
    rest = (
        ranked.join(lengths, "conv_id")
        .where("pos >= h")
        .select("conv_id", (F.col("front") + F.col("pos") - F.col("h")).alias("pos"), "item", "points")
    )
    return taken.union(rest), lengths.select("conv_id", "n")


def _blocks(turns: DataFrame, lengths: DataFrame, store: Store) -> tuple[DataFrame, list[DataFrame]]:
    """Blocks of turns with the names of the nodes before (`prior`) and after them (`after`), and the coarser levels.

    A level has one row per (conversation, block): prior and the items t1.. of its block.
    """
    points = [F.max(F.when(F.col("pos") % WIDTH == i, F.col("points"))).alias(f"p{i + 1}") for i in range(WIDTH)]
    start = lengths.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("int").alias("points"))
    rows = _block_columns(turns.select("conv_id", F.col("pos").cast("long").alias("pos"), "item", "points").union(start), points)
    rows = store.save(rows.join(lengths, "conv_id"), "turn-blocks")
    levels, below = [rows], rows
    while below.where("block > 0").limit(1).count():
        # a full block is an item of the coarser sequence; conversations of one block need none
        full = below.where((F.col("n") > WIDTH) & F.col(NAMES[-1]).isNotNull())
        items = full.select("conv_id", F.col("block").alias("pos"), _digest(*[_text(n, below) for n in NAMES]).alias("item"), F.expr(f"n div {WIDTH}").alias("n"))
        below = store.save(_block_columns(items, [F.max("n").alias("n")]), "coarse-blocks")
        levels.append(below)
    keys = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if keys is None:
            level = level.withColumn("prior", F.lit(ROOT)).withColumn("after", F.lit(None).cast("binary"))
        else:
            before = keys.select(F.col("conv_id").alias("_c"), F.col("pos").alias("_b"), F.col("key").alias("_prior"))
            behind = keys.select(F.col("conv_id").alias("_c2"), (F.col("pos") - 1).alias("_b2"), F.col("key").alias("after"))
            level = (
                level.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")), "left")
                .join(behind, (F.col("conv_id") == F.col("_c2")) & (F.col("block") == F.col("_b2")), "left")
                .withColumn("prior", F.coalesce("_prior", F.lit(ROOT)))
                .drop("_c", "_b", "_c2", "_b2", "_prior")
            )
        levels[depth] = level = store.save(level, "blocks-of-level")
        if depth:
            prefixes = [
                F.struct((F.col("block") * WIDTH + i + 1).alias("pos"), _prefix(level, i + 1).alias("key"), F.col(NAMES[i]).isNotNull().alias("there"))
                for i in range(WIDTH)
            ]
            keys = level.select("conv_id", F.explode(F.array(*prefixes)).alias("k")).where("k.there").select("conv_id", "k.pos", "k.key")
    return levels[0], levels[1:]


def _text(name: str, df: DataFrame) -> Column:
    return F.hex(name) if dict(df.dtypes)[name] == "binary" else F.col(name).cast("string")


def _prefix(df: DataFrame, upto: int = WIDTH) -> Column:
    return _digest(F.hex("prior"), *[_text(n, df) for n in NAMES[:upto]])


_LAST = "CASE " + " ".join(f"WHEN d = {i + 1} THEN t{i + 1} IS NOT NULL" for i in range(WIDTH)) + " ELSE true END"


def _rolled(rows: DataFrame, measures: str) -> DataFrame:
    """ROLLUP of rows (prior, t1..t8, ...) over their path; d is the length of the prefix. Only prefixes that exist."""
    columns = ", ".join(NAMES)
    return rows.sparkSession.sql(
        f"SELECT prior, {columns}, {WIDTH} - bit_count(grouping_id()) AS d, {measures} FROM {{rows}} GROUP BY prior, ROLLUP({columns})",
        rows=rows,
    ).where(_LAST)


def _subtree_sums(nodes: DataFrame, coarser: list[DataFrame], sums: list[str], store: Store) -> DataFrame:
    """(key, prior, d, *sums) over the subtree of each node (prior, t1..t8, after, *sums) of one level.

    `after` names the node where a full block ends for the blocks behind it. A key names a node by its path.
    """
    if coarser:
        inside = nodes.where(F.col("prior") != F.lit(ROOT)).groupBy("prior").agg(*[F.sum(s).alias(s) for s in sums])
        level = coarser[0]
        prefixes = [
            F.struct(
                _prefix(level, i + 1).alias("name"),
                *[(F.col(n) if j <= i else F.lit(None).cast("binary")).alias(n) for j, n in enumerate(NAMES)],
                (F.col("after") if i == WIDTH - 1 else F.lit(None).cast("binary")).alias("after"),
            )
            for i in range(WIDTH)
        ]
        ends = level.select("prior", F.explode(F.array(*[F.when(F.col(n).isNotNull(), p) for n, p in zip(NAMES, prefixes)])).alias("e"))
        ends = ends.where("e is not null").select("prior", "e.*").dropDuplicates(["name"])
        ends = ends.join(inside.withColumnRenamed("prior", "_p"), F.col("name") == F.col("_p"), "left").drop("_p").fillna(0, sums)
        ends = store.save(ends, "block-ends")
        behind = _subtree_sums(ends, coarser[1:], sums, store).select(F.col("key").alias("_k"), *[F.col(s).alias(f"_{s}") for s in sums])
        nodes = nodes.join(behind, F.col("after") == F.col("_k"), "left").select(
            "prior", *NAMES, *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]
        )
    rolled = _rolled(nodes.select("prior", *NAMES, *sums), ", ".join(f"sum({s}) AS {s}" for s in sums))
    rolled = rolled.where((F.col("d") > 0) | (F.col("prior") == F.lit(ROOT)))
    return rolled.select(_prefix(nodes).alias("key"), "d", *sums)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, n_ends, ends_sha256) of the conversations (key, conv_id) that end at each node.

    Ids are sorted over the whole table and joined to pieces of text of bounded length; the pieces of a node then run through
    one digest, so a node where a third of all conversations end is a few pieces and no list.
    """

    def pieces(batches):
        key, first, ids = None, None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([first]), pa.array([len(ids)]), pa.array([",".join(map(str, ids))])],
                ["key", "first", "n", "piece"],
            )

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or len(ids) == PIECE):
                    yield out()
                    ids = []
                if not ids:
                    key, first = k, c
                ids.append(c)
        if ids:
            yield out()

    def digests(batches):
        key, n, sha = None, 0, None

        def out(keys, counts, values):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts), pa.array(values)], ["key", "n_ends", "ends_sha256"])

        for batch in batches:
            keys, counts, values = [], [], []
            for k, m, piece in zip(*[batch.column(c).to_pylist() for c in ("key", "n", "piece")]):
                if k == key:
                    sha.update(b",")
                else:
                    if sha is not None:
                        keys.append(key), counts.append(n), values.append(sha.hexdigest())
                    key, n, sha = k, 0, hashlib.sha256()
                sha.update(piece.encode())
                n += m
            if keys:
                yield out(keys, counts, values)
        if sha is not None:
            yield out([key], [n], [sha.hexdigest()])

    cut = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = cut.mapInArrow(pieces, "key binary, first long, n long, piece string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, n_ends long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame, store: Store) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; ties by the SHA-256 of role and text. Null roles and texts are empty; rows
    that repeat entirely are turns of their own; rows without a conv_id belong to no conversation. The conversation
    whose first turns are taken over is conv_id - conv_id % 100, with the remainder of the sign of conv_id. Other
    columns are not read. An empty table gives no rows.
    """
    turns, lengths = rebuilt_turns(conversations, store)
    blocks, coarser = _blocks(turns, lengths, store)

    measures = "count(*) AS n_convs, min(conv_id) AS conv_id, min(block) AS block, max(after) AS after, " + ", ".join(
        f"max(p{i}) AS p{i}" for i in range(1, WIDTH + 1)
    )
    nodes = _rolled(blocks, measures)
    nodes = nodes.where((F.col("d") > 0) | (F.col("prior") == F.lit(ROOT)))
    last_points = F.coalesce(*[F.when(F.col("d") == i, F.col(f"p{i}")) for i in range(1, WIDTH + 1)], F.lit(0))
    above = F.coalesce(*[F.when(F.col("d") == i, _prefix(nodes, i - 1)) for i in range(2, WIDTH + 1)])
    nodes = nodes.select(
        "prior",
        *NAMES,
        "d",
        _prefix(nodes).alias("key"),
        above.alias("above"),
        F.when(F.col("d") == WIDTH, F.col("after")).alias("after"),
        "conv_id",
        (F.col("block") * WIDTH + F.col("d")).alias("depth"),
        "n_convs",
        ((F.col("n_convs") - 1) * last_points).alias("saved"),
    )
    nodes = store.save(nodes, "trie-nodes")

    ends = blocks.where(F.expr(f"block = greatest(n - 1, 0) div {WIDTH}")).select(_prefix(blocks).alias("key"), "conv_id")
    ends = store.save(_end_digests(ends), "ends")
    ends = ends.withColumnRenamed("key", "_k")
    # a node is childless if all its members end there
    marked = nodes.join(ends, F.col("key") == F.col("_k"), "left").drop("_k")
    marked = marked.withColumn("leaves", (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("long"))
    marked = store.save(marked, "marked-nodes")
    sums = _subtree_sums(marked, coarser, ["leaves", "saved"], store).select(
        F.col("key").alias("_s"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )

    # the parent of the first node of a block is the node where the block before ended
    block_ends = nodes.where("after is not null").select(F.col("after").alias("_a"), F.col("key").alias("_above"))
    root = nodes.where("depth = 0").select(F.col("prior").alias("_a"), F.col("key").alias("_above"))
    children = nodes.where("depth > 0").join(block_ends.union(root), (F.col("d") == 1) & (F.col("prior") == F.col("_a")), "left")
    children = children.select(F.col("key").alias("_c"), F.coalesce("above", "_above").alias("parent"))
    children = store.save(children, "edges-of-trie")
    counts = children.groupBy(F.col("parent").alias("_n")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = children.join(nodes.select(F.col("key").alias("_p"), F.col("conv_id").alias("parent_conv_id")), F.col("parent") == F.col("_p"))
    parents = parents.select("_c", "parent_conv_id")
    return (
        marked.join(sums, F.col("key") == F.col("_s"))
        .join(counts, F.col("key") == F.col("_n"), "left")
        .join(parents, F.col("key") == F.col("_c"), "left")
        .select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
