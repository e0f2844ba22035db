"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns become digests, and a prefix is named by two 64-bit sums (exclusive or) over the
hashes of its turns with their places, so equal prefixes meet in one aggregate with
partial sums and no conversation is ever gathered. A node is (least member, depth).

Totals over subtrees come from contraction in rounds. A round rakes all leaves into
their parents, then compresses unary chains: a node whose only child and whose parent
stay is cut out, its value moving onto the edge below it. Nodes keep the number of
their children and the exclusive or of the children's names, so the only child is known
without a join. Nodes to cut are local minima of a rank along the chain, halving it.
A round costs two aggregates over the live nodes and is written; live nodes fall
geometrically, long chains included. At the end only the root is left, and the
rounds are undone in reverse: a cut node's total is its value plus its child's total.

Ids of the conversations that end at a node are hashed in order. They are numbered by
ranges and joined in blocks; a digest over several blocks is one stream through a task,
a block at a time, as the digest itself asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.places import numbered
from tidewire.llm.words import space_words
from tidewire.operators.skew import hot_keys, skew_join
from tidewire.session import Scratch

#: Stands for a null id inside; no conversation can have it as its own.
NO_ID = (1 << 63) - 1
#: Turns of a conversation that are summed in one window.
CHUNK = 4096
#: Ids in a block of a digest.
BLOCK = 512
RESULT = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]
_NODE = ["c", "d"]


def ordered(
    scratch: Scratch, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, place, digest, n_words) of every turn, places from 0 by turn, null first."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    turns = conversations.select(
        F.coalesce(F.col(f"`{conv_id}`").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said)).alias("digest"),
        F.size(space_words(said[1])).cast("long").alias("n_words"),
    )
    return numbered(scratch, scratch.keep(turns, "turns"), "turns", ["conv"], ["turn", "digest"]).drop("turn")


def spliced(scratch: Scratch, turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of their family's first one.

    Conversation c takes the first h turns of c - c % family, and its own from there
    on; h is crc32 of the decimal c modulo ``most``. Turnless ones are kept as a row
    without a digest. A null id has no family.
    """
    lens = scratch.keep(turns.groupBy("conv").agg(F.count("*").alias("own")), "lens")
    c = F.col("conv")
    h = F.when(c == NO_ID, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % most)
    kin = lens.select("conv", "own", h.alias("h"), F.when(c == NO_ID, c).otherwise(c - c % family).alias("base"))
    heads = lens.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    lent = F.least("h", F.coalesce("base_own", F.lit(0)))
    plan = scratch.keep(kin.join(heads, "base", "left").select("conv", "own", "h", "base", lent.alias("lent")), "plan")
    shift = plan.select("conv", "h", "lent")
    own = skew_join(turns, shift, "conv", "inner", ["place"], hot_keys(turns, "conv")).where("place >= h")
    first = turns.where(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    borrowed = plan.join(first, "base").where("place < lent")
    steps = own.select("conv", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "n_words")
    none = plan.where("lent = 0 and own <= h").select(
        "conv", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("n_words")
    )
    return steps.unionByName(borrowed.select("conv", "place", "digest", "n_words")).unionByName(none)


def prefixes(scratch: Scratch, steps: DataFrame) -> DataFrame:
    """Every turn with its depth, the name (a, b) of its prefix, and of the one before.

    Sums run inside chunks of a conversation; conversations of several chunks add what
    the chunks before hold. A turnless conversation is at the root, depth 0.
    """
    chunk = F.floor(F.col("place") / CHUNK)
    own = scratch.keep(
        steps.withColumns({
            "x": F.when(F.col("place") < 0, 0).otherwise(F.xxhash64(F.lit(1), "place", "digest")),
            "y": F.when(F.col("place") < 0, 0).otherwise(F.xxhash64("digest", "place", F.lit(2))),
            "chunk": chunk,
        }),
        "steps",
    )
    totals = own.where("chunk >= 0").groupBy("conv", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.keep(
        totals.select("conv", "chunk", F.bit_xor("x").over(earlier).alias("bx"), F.bit_xor("y").over(earlier).alias("by"))
        .where("chunk > 0"),
        "before",
    )
    here = Window.partitionBy("conv", "chunk").orderBy("place")
    summed = own.select(
        "conv", "chunk", "place", "n_words", "x", "y", F.bit_xor("x").over(here).alias("a"), F.bit_xor("y").over(here).alias("b")
    )
    carried = scratch.keep(summed, "summed").join(before, ["conv", "chunk"], "left")
    a, b = (F.col(s).bitwiseXOR(F.coalesce(t, F.lit(0))) for s, t in (("a", "bx"), ("b", "by")))
    return carried.select(
        "conv", (F.col("place") + 1).cast("int").alias("depth"), "n_words", a.alias("a"), b.alias("b"),
        a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"),
    )


def _nodes(scratch: Scratch, found: DataFrame) -> DataFrame:
    """One row per distinct prefix: its name, least member, members and its parent's least member."""
    turns = found.where("depth > 0")
    nodes = turns.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("c"), F.count("*").alias("n_convs"), F.max("n_words").alias("words"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    )
    zero = F.lit(0).cast("long")
    # every conversation is at depth 1 or, turnless, at 0
    root = found.where("depth < 2").agg(F.min("conv").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(
        root.select(
            F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), "c", "n_convs", zero.alias("words"),
            F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        )
    )
    nodes = scratch.keep(
        nodes.withColumn("up", F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")))),
        "nodes",
    )
    parents = nodes.select(F.struct("depth", "a", "b").alias("up"), F.col("c").alias("pc"))
    linked = skew_join(nodes, parents, "up", "left", ["c"], hot_keys(nodes, "up"))
    return scratch.keep(linked.select("depth", "a", "b", "c", "pc", "n_convs", "words"), "linked")


def _rank(depth: Column, turn: int) -> Column:
    """A total order of depths: fewest trailing zero bits first, then by hash.

    Along a chain of consecutive depths every other node is a least one, again and
    again; the hash keeps chains with gaps from sorting themselves by depth.
    """
    zeros = F.bit_count(depth.bitwiseAND(-depth) - 1)
    return F.struct(zeros, F.xxhash64(F.lit(turn), depth), depth)


def _start(linked: DataFrame) -> DataFrame:
    """The tree as states: a node's parent, its children's number and names, its own values."""
    none = F.lit(None)
    long, zero = none.cast("long"), F.lit(0).cast("long")
    own = linked.select(
        "c", F.col("depth").alias("d"), "pc", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"), "n_convs",
        zero.alias("kids"), zero.alias("kc"), F.lit(0).alias("kd"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    kids = linked.where("depth > 0").select(
        F.col("pc").alias("c"), (F.col("depth") - 1).alias("d"), long.alias("pc"), none.cast("int").alias("pd"),
        long.alias("n_convs"), F.lit(1).cast("long").alias("kids"), F.col("c").alias("kc"), F.col("depth").alias("kd"),
        zero.alias("saved"),
    )
    met = own.unionByName(kids).groupBy(*_NODE).agg(
        F.max("pc").alias("pc"), F.max("pd").alias("pd"), F.max("n_convs").alias("n_convs"), F.sum("kids").alias("kids"),
        F.bit_xor("kc").alias("kc"), F.bit_xor("kd").alias("kd"), F.sum("saved").alias("saved"),
    )
    return met.select(
        *_NODE, "pc", "pd", "kids", "kc", "kd", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        "saved", zero.alias("e_leaves"), zero.alias("e_saved"), long.alias("cut_c"), none.cast("int").alias("cut_d"),
        long.alias("cut_leaves"), long.alias("cut_saved"), "n_convs",
    )


def _raked(state: DataFrame) -> DataFrame:
    """Nodes that stay, with their leaves' totals, and what they know of their neighbours."""
    zero, no = F.lit(0).cast("long"), F.lit(False)
    unary = (F.col("kids") == 1) & (F.col("d") > 0)
    blank = {
        "here": no, "pc": F.lit(None).cast("long"), "pd": F.lit(None).cast("int"), "kids": zero, "kc": zero, "kd": F.lit(0),
        "leaves": zero, "saved": zero, "e_leaves": zero, "e_saved": zero, "unary": no, "unary_above": no, "unary_below": no,
    }

    def say(rows: DataFrame, to: tuple[str, str], **what: Column) -> DataFrame:
        return rows.select(
            F.col(to[0]).alias("c"), F.col(to[1]).alias("d"), *[what.get(k, v).alias(k) for k, v in blank.items()]
        )

    stay = state.where("kids > 0 or d = 0").select(
        *_NODE, F.lit(True).alias("here"), "pc", "pd", "kids", "kc", "kd", "leaves", "saved", "e_leaves", "e_saved",
        unary.alias("unary"), no.alias("unary_above"), no.alias("unary_below"),
    )
    leaves = say(
        state.where("kids = 0 and d > 0"), ("pc", "pd"), kids=F.lit(-1).cast("long"), kc=F.col("c"), kd=F.col("d"),
        leaves=F.col("leaves") + F.col("e_leaves"), saved=F.col("saved") + F.col("e_saved"),
    )
    below = say(state.where(unary), ("kc", "kd"), unary_above=F.lit(True))
    above = say(state.where(unary), ("pc", "pd"), unary_below=F.lit(True))
    met = stay.unionByName(leaves).unionByName(below).unionByName(above).groupBy(*_NODE)
    return met.agg(
        *[F.max(k).alias(k) for k in ("here", "pc", "pd", "unary", "unary_above", "unary_below")],
        *[F.sum(k).alias(k) for k in ("kids", "leaves", "saved", "e_leaves", "e_saved")],
        *[F.bit_xor(k).alias(k) for k in ("kc", "kd")],
    ).where("here")


def _compressed(raked: DataFrame, turn: int) -> DataFrame:
    """Without the nodes cut out of chains; a child keeps what is cut above it.

    Cut are nodes that were unary before the rake and still are, and come before every
    neighbour that was unary: so no two neighbours go at once.
    """
    mine = _rank(F.col("d"), turn)
    cut = (
        F.col("unary") & (F.col("kids") == 1)
        & (~F.col("unary_above") | (mine < _rank(F.col("pd"), turn)))
        & (~F.col("unary_below") | (mine < _rank(F.col("kd"), turn)))
    )
    marked = raked.withColumn("cut", F.coalesce(cut, F.lit(False)))
    # one row per node that stays, and per node cut one to its child and one to its parent
    long, zero, null = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("int")
    stay = F.struct(
        "c", "d", F.lit(True).alias("here"), "pc", "pd", "kids", "kc", "kd", "leaves", "saved", "e_leaves", "e_saved",
        long.alias("npc"), null.alias("npd"), long.alias("cut_c"), null.alias("cut_d"),
        long.alias("cut_leaves"), long.alias("cut_saved"), zero.alias("up_leaves"), zero.alias("up_saved"),
    )
    to_child = F.struct(
        F.col("kc").alias("c"), F.col("kd").alias("d"), F.lit(False).alias("here"), long.alias("pc"), null.alias("pd"),
        zero.alias("kids"), zero.alias("kc"), F.lit(0).alias("kd"), zero.alias("leaves"), zero.alias("saved"),
        zero.alias("e_leaves"), zero.alias("e_saved"), F.col("pc").alias("npc"), F.col("pd").alias("npd"),
        F.col("c").alias("cut_c"), F.col("d").alias("cut_d"), F.col("leaves").alias("cut_leaves"), F.col("saved").alias("cut_saved"),
        F.col("e_leaves").alias("up_leaves"), F.col("e_saved").alias("up_saved"),
    )
    to_parent = F.struct(
        F.col("pc").alias("c"), F.col("pd").alias("d"), F.lit(False).alias("here"), long.alias("pc"), null.alias("pd"),
        zero.alias("kids"), F.col("c").bitwiseXOR(F.col("kc")).alias("kc"), F.col("d").bitwiseXOR(F.col("kd")).alias("kd"),
        zero.alias("leaves"), zero.alias("saved"), zero.alias("e_leaves"), zero.alias("e_saved"),
        long.alias("npc"), null.alias("npd"), long.alias("cut_c"), null.alias("cut_d"),
        long.alias("cut_leaves"), long.alias("cut_saved"), zero.alias("up_leaves"), zero.alias("up_saved"),
    )
    said = marked.select(F.inline(F.when(F.col("cut"), F.array(to_child, to_parent)).otherwise(F.array(stay))))
    met = said.groupBy(*_NODE).agg(
        *[F.max(k).alias(k) for k in ("here", "pc", "pd", "npc", "npd", "cut_c", "cut_d", "cut_leaves", "cut_saved")],
        *[F.sum(k).alias(k) for k in ("kids", "leaves", "saved", "e_leaves", "e_saved", "up_leaves", "up_saved")],
        *[F.bit_xor(k).alias(k) for k in ("kc", "kd")],
    )
    on_edge = {k: F.col(f"e_{k}") + F.coalesce(f"cut_{k}", F.lit(0)) + F.col(f"up_{k}") for k in ("leaves", "saved")}
    return met.select(
        *_NODE, F.coalesce("npc", "pc").alias("pc"), F.coalesce("npd", "pd").alias("pd"), "kids", "kc", "kd", "leaves", "saved",
        on_edge["leaves"].alias("e_leaves"), on_edge["saved"].alias("e_saved"), "cut_c", "cut_d",
        (F.col("cut_leaves") + F.col("e_leaves")).alias("cut_leaves"), (F.col("cut_saved") + F.col("e_saved")).alias("cut_saved"),
    )


def totals(scratch: Scratch, start: DataFrame) -> DataFrame:
    """(c, d, n_leaves, saved_tokens) over every node's subtree, from written states."""
    states, live = [start], start.count()
    while live > 1:
        turn = len(states)
        states.append(scratch.keep(_compressed(_raked(states[-1]), turn), f"state{turn}"))
        live = states[-1].count()
    total = [F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
    found = [scratch.keep(states[-1].select(*_NODE, *total), f"total{len(states) - 1}")]
    for turn in range(len(states) - 1, 0, -1):
        known = found[0]
        for more in found[1:]:
            known = known.unionByName(more)
        cut = states[turn].where("cut_c is not null").select(*_NODE, "cut_c", "cut_d", "cut_leaves", "cut_saved")
        grown = cut.join(known, _NODE).select(
            F.col("cut_c").alias("c"), F.col("cut_d").alias("d"), (F.col("cut_leaves") + F.col("n_leaves")).alias("n_leaves"),
            (F.col("cut_saved") + F.col("saved_tokens")).alias("saved_tokens"),
        )
        leaves = states[turn - 1].where("kids = 0 and d > 0").select(*_NODE, *total)
        found.append(scratch.keep(grown.unionByName(leaves), f"total{turn - 1}"))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    return all_found


def _ends(scratch: Scratch, found: DataFrame) -> DataFrame:
    """Per name of a prefix the digest of the ids that end there, ascending."""
    deepest = found.groupBy("conv").agg(F.max(F.struct("depth", "a", "b")).alias("end"))
    ends = scratch.keep(deepest.where(F.col("conv") != NO_ID).select("end.depth", "end.a", "end.b", "conv"), "ends")
    name = ["depth", "a", "b"]
    placed = numbered(scratch, ends, "ends", name, ["conv"])
    blocks = placed.groupBy(*name, F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    blocks = scratch.keep(blocks, "blocks")
    several = blocks.where("block > 0").select(*name).distinct()
    single = blocks.join(several, name, "left_anti").select(*name, F.sha2("ids", 256).alias("ends_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(name, last, strict=True)) | {"ends_sha256": state.hexdigest()}], schema=kind)

        kind = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*name, "ids")), strict=True):
                if key != last:
                    if last is not None:
                        yield done()
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if last is not None:
            yield done()

    runs = blocks.join(several, name, "left_semi").repartition(*name).sortWithinPartitions(*name, "block")
    streamed = runs.select(*name, "ids").mapInArrow(digest, "depth int, a long, b long, ends_sha256 string")
    return single.unionByName(streamed)


def prefix_trie(
    spark: SparkSession, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", splice: bool = False,
) -> DataFrame:
    """One row per distinct prefix of conversations, the empty one included.

    Turns go by ``turn``, null first, equal ones by a hash of their content; repeated
    rows are turns of their own. Null role and text are empty. ``conv_id`` is the least
    member, ``n_leaves`` counts the childless nodes of a subtree, its top included;
    ``saved_tokens`` sums over it what is stored once instead of per member: members
    less one, times the words of the last turn. ``ends_sha256`` is the digest of the
    comma-joined ascending ids that end at the node. Rows of a null id are one
    conversation: it is counted and comes last as a member, but has no id to name or to
    hash. An empty table has no nodes. Other columns are not looked at. ``splice``
    first rebuilds the conversations (see ``spliced``).
    """
    scratch = Scratch(spark, "trie")
    turns = ordered(scratch, conversations, conv_id, turn, role, text)
    steps = spliced(scratch, turns) if splice else turns
    found = scratch.keep(prefixes(scratch, steps), "prefixes")
    linked = _nodes(scratch, found)
    start = scratch.keep(_start(linked), "state0")
    done = totals(scratch, start)
    ends = linked.join(_ends(scratch, found), ["depth", "a", "b"]).select("c", F.col("depth").alias("d"), "ends_sha256")
    nodes = start.select(*_NODE, "pc", "n_convs", F.col("kids").alias("n_children"))
    rows = nodes.join(done, _NODE).join(ends, _NODE, "left")
    out = scratch.keep(
        rows.select(
            F.nullif("c", F.lit(NO_ID)).alias("conv_id"), F.col("d").cast("long").alias("depth"),
            F.nullif("pc", F.lit(NO_ID)).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "trie",
    )
    scratch.drop_but("trie")
    return out
