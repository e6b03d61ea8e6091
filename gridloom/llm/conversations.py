"""A prefix trie of conversations by partition refinement: classes of equal prefixes are split turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attached, numbered, rows_out, written

FAMILY = 100  # ids of a family, whose first conversation the others begin with
PIECE = 1 << 16  # letters of a list of ids that travel together
_ENDS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_SHAS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, chars): each conversation's turns numbered from 1; key stands for (role, text), chars counts the text's code points.

    Turns are in order of turn, null first; of equal ones by their key. A null role or text is empty. Rows without a
    conv_id belong to no conversation. The order is global and dealt by ranges, so one conversation may hold any share of the rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"), F.char_length(text).cast("long").alias("chars"))
    return numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "key"], "conv_id", "at")


def shared(conv_id: Column) -> Column:
    """How many turns conversation c takes from the first of its family: crc32(decimal c) mod 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(turned: DataFrame, taken=shared, family: int = FAMILY) -> DataFrame:
    """(conv_id, depth, key, chars) of all conversations rebuilt; one without turns has a row of depth 0 and no key.

    Conversation c begins with the first `taken(c)` turns of conversation c - c % family (fewer if it has fewer, none if it is
    not there), then come its own turns after its first `taken(c)`. At most `family` conversations meet a turn, twice as many around 0.
    """
    own = turned.withColumn("h", taken(F.col("conv_id")))
    convs = turned.groupBy("conv_id").agg(F.max("at").alias("n")).withColumns({"h": taken(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % family})
    lens = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(lens, "base", "left").withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0)))))
    most = convs.agg(F.max("got")).first()[0] or 0
    heads = turned.where((F.col("conv_id") % family == 0) & (F.col("at") <= most)).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "key", "chars")
    first = convs.where("got > 0").join(heads, "base").where("depth <= got").select("conv_id", "depth", "key", "chars")
    rest = attached(own.where("at > h"), convs.select("conv_id", "got", F.col("n").alias("weight")), ["conv_id"]).select("conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("depth"), "key", "chars")
    none = convs.where("got = 0 and n <= h").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("chars"))
    return first.union(rest).union(none)


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) to lists of members of a node, comma-joined, of PIECE letters or so."""
    node, ids, size, out = None, [], 0, []

    def close():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))

    for batch in it:
        for c, d, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (c, d) != node or size > PIECE:
                close()
                node, ids, size = (c, d), [], 0
            ids.append(m)
            size += len(str(m)) + 1
        if len(out) > 1000:
            yield rows_out(_ENDS, list(zip(*out, strict=True)))
            out.clear()
    close()
    if out:
        yield rows_out(_ENDS, list(zip(*out, strict=True)))


def _hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to each node's hash; a node's pieces pass one after the other and are not kept."""
    node, h, out = None, None, []
    for batch in it:
        for c, d, ids in zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (c, d) == node:
                h.update(b"," + ids.encode())
            else:
                if node:
                    out.append((*node, h.hexdigest()))
                node, h = (c, d), hashlib.sha256(ids.encode())
        if len(out) > 10_000:
            yield rows_out(_SHAS, list(zip(*out, strict=True)))
            out.clear()
    if node:
        out.append((*node, h.hexdigest()))
        yield rows_out(_SHAS, list(zip(*out, strict=True)))


def ends_sha256(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes from their (conv_id, depth, member): the hash of the members' ids in order, comma-joined.

    Ids are sorted by ranges over all tasks and joined to pieces there; only pieces of a node meet, and stream through its hash.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "depth", "member"]
    pieces = ends.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_pieces, "conv_id long, depth long, first long, ids string")
    return pieces.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashes, "conv_id long, depth long, ends_sha256 string")


NODE = ["conv_id", "depth"]


def _node(df: DataFrame, **cols) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, chars) of nodes."""
    return df.select(*(cols.get(c, F.col(c)).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "chars")))


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv_id, depth, key, chars), depth from 1, or 0 for a sequence without turns.

    A node is a distinct sequence of first turns, named by its smallest member and its depth. All sequences start in one class, the
    root's. In each round the members of active classes are split by their next key: a member without one ends at the
    class's node; a class of one member is retired, and its tail becomes a chain of nodes of one member each, made for all retired at
    once. Leaves and saved code points are folded back level by level. One round a turn of the longest prefix that two
    sequences share, whatever the lengths. An empty table gives no rows.

    A round shuffles active members by id, and counts of (class, key) by partial aggregates; a class of over a thousandth of the
    members gets its name from a broadcast of at most a thousand rows, the others by a join. Rounds are written to the shared folder.
    """
    spark = sequences.sparkSession
    seq = written(sequences.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "depth", "conv_id").sortWithinPartitions("depth"))
    members = seq.select("conv_id").distinct()
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    active = written(members.crossJoin(F.broadcast(top.select(F.col("conv_id").alias("cls"), F.col("n_convs").alias("n")))))  # the root: one row
    nodes = [written(_node(top, depth=F.lit(0), parent_conv_id=F.lit(None), chars=F.lit(0)))]
    retired, ended, d = [active.where("n = 1").select("conv_id", F.lit(0).cast("long").alias("from"))], [], 0
    active = active.where("n > 1")
    while active.limit(1).count():
        d += 1
        now = active.join(seq.where(F.col("depth") == d).select("conv_id", "key", "chars"), "conv_id", "left").withColumnRenamed("cls", "parent")
        now = written(now.select("conv_id", "parent", "key", "chars"))
        ended.append(now.where("key is null").select(F.col("parent").alias("conv_id"), F.lit(d - 1).cast("long").alias("depth"), F.col("conv_id").alias("member")))
        split = now.where("key is not null").groupBy("parent", "key").agg(F.min("conv_id").alias("cls"), F.count("*").alias("n"), F.max("chars").alias("chars"))
        split = written(split)
        nodes.append(_node(split, conv_id=F.col("cls"), depth=F.lit(d), parent_conv_id=F.col("parent"), n_convs=F.col("n")))
        retired.append(split.where("n = 1").select(F.col("cls").alias("conv_id"), F.lit(d).cast("long").alias("from")))
        going = split.where("n > 1").select("parent", "key", "cls", "n", F.col("n").alias("weight"))
        active = written(attached(now.where("key is not null").select("conv_id", "parent", "key"), going, ["parent", "key"]).select("conv_id", "cls", "n"))
    alone = retired[0]
    for r in retired[1:]:
        alone = alone.union(r)
    alone = written(alone)
    tails = seq.join(alone, "conv_id").where("depth > from")
    last = seq.join(alone, "conv_id").groupBy("conv_id").agg(F.max("depth").alias("depth"))
    lone = written(_node(tails, parent_conv_id=F.col("conv_id"), n_convs=F.lit(1)))
    return _folded(nodes, lone, written(last), ended)


def _folded(nodes: list[DataFrame], lone: DataFrame, last: DataFrame, ended: list[DataFrame]) -> DataFrame:
    """Sums over subtrees, from the deepest level of the classes up; a chain of one member has one leaf and saves nothing."""
    out, below = [], None
    chained = lone.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("chain"))
    for level in reversed(nodes):
        at = level.join(chained, NODE, "left").withColumn("chain", F.coalesce("chain", F.lit(0)))
        if below is not None:
            up = below.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            at = at.join(up, NODE, "left")
        else:
            at = at.withColumns({c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")})
        kids, leaves, saved = (F.coalesce(c, F.lit(0)) for c in ("kids", "leaves", "saved"))
        n_children = kids + F.col("chain")
        below = written(at.select("conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), F.greatest(F.lit(1), leaves + F.col("chain")).alias("n_leaves"), (saved + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
        out.append(below)
    end = last.select(*NODE, F.lit(1).cast("long").alias("one"))
    chain = lone.join(end, NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.when(F.col("one") == 1, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    for level in out:
        chain = chain.union(level)
    ends = last.select(*NODE, F.col("conv_id").alias("member"))
    for e in ended:
        ends = ends.union(e)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return chain.join(ends_sha256(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))


def conversation_trie(conversations: DataFrame, taken=shared, family: int = FAMILY) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(written(turns(conversations)), taken, family))
