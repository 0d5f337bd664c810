"""Operator 12, conversation prefix trie: partition refinement over turns, and a fold from the leaves back to the root.

A turn becomes a 128-bit name of its role and text, and its number of words; texts stay where they are read. Conversations
are rebuilt (see ``rebuilt``), and those of one sequence are one member from here on, with the number and the ids of its
conversations. Refinement starts with one class, the root, of all sequences. A round splits each active class by the next
turn; a class is named by its least conversation. A class of one sequence retires: its tail is emitted as a unary chain,
in closed form. A class whose sequences hold no more than LOCAL turns from here on retires as a whole and is refined to
its end, and folded, inside one task. Only larger classes stay active, so the rounds are as many as the turns that more
than LOCAL turns' worth of sequences share. Then children, leaves and savings are folded back, round by round.

A turn's place comes from sorted ranges and their counts, so that one conversation can lie in many tasks; joins deal the
rows of hot keys to parts; sequences longer than PIECE turns are held in pieces; the ids that a node's digest needs are
packed where they are sorted and go through one running hash, batch by batch.

Turns go by turn number, null first; those of one number by the hash of role and text; equal rows are turns each. Null
roles and texts are empty. Rows without conv_id belong to no conversation. The remainder c % 20 has the sign of c. Very long
texts are hashed whole; an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import meet, stash, text_batches, text_of

BLOCK = 20
HEADS = 4
PIECE = 64
#: Turns that a class is refined with inside one task, at most.
LOCAL = 8192
#: Ids packed in one row of a node's digest, at most.
PACK = 1 << 16
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, top boolean"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """c, r (the turn's number from 1), a, b (name of role and text), n (words)."""
    role, text = text_of("role"), text_of("text")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("t"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), F.length(role), text, role).alias("b"), words.alias("n"))
    rows = rows.withColumn("u", F.xxhash64(F.monotonically_increasing_id()))  # equal rows may lie in several ranges
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("a"), F.col("b"), F.col("u")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "a", "b", "n", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("g"))
    ranged = stash(ranged, "ranges")
    parts = ranged.groupBy("c", "p").agg(F.min("g").alias("lo"), F.count("*").alias("c_"))
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = stash(parts.select("c", "p", F.col("lo"), F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("off")), "range-starts")
    return stash(ranged.join(first, ["c", "p"]).select("c", (F.col("g") - F.col("lo") + F.col("off") + 1).alias("r"), "a", "b", "n"), "turns")


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(all conversations c; their turns c, d, a, b, n): the first h turns of conversation c - c % block, then c's own turns
    after its first h, h = crc32(c) % heads. turns as of ``numbered_turns``."""
    taken = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    rows = turns.withColumns({"h": taken, "base": F.col("c") - F.col("c") % block})
    convs = stash(rows.groupBy("c").agg(F.first("h").alias("h"), F.first("base").alias("base"), F.count("*").alias("len")), "conversations")
    lengths = convs.select(F.col("c").alias("base"), F.col("len").alias("have"))
    bases = stash(convs.groupBy("base").agg(F.sum("len").alias("c")).join(lengths, "base", "left").select("base", F.col("c"), F.coalesce("have", F.lit(0)).alias("have")), "bases")
    later = meet(rows.where("r > h").withColumnRenamed("c", "own"), bases, ["base"], ["own", "r"])
    own = later.select(F.col("own").alias("c"), (F.least("h", "have") + F.col("r") - F.col("h")).alias("d"), "a", "b", "n")
    first = rows.where(F.col("r") < heads).select(F.col("c").alias("base"), F.col("r").alias("d"), "a", "b", "n")
    head = convs.select("c", "h", "base").join(first, "base").where("d <= h").select("c", "d", "a", "b", "n")
    return convs.select("c"), stash(own.unionByName(head), "rebuilt")


def _sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq: the least conversation of each sequence, w: how many have it, len; members seq, c of the sequences of several)."""
    named = turns.groupBy("c").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64("d", "a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", "d")).alias("y"))
    named = stash(convs.join(named, "c", "left").na.fill(0, ["len", "x", "y"]), "names")
    groups = stash(named.groupBy("len", "x", "y").agg(F.min("c").alias("seq"), F.count("*").alias("w")).withColumn("c", F.col("w")), "sequences")
    several = groups.where("w > 1").select("len", "x", "y", "seq", F.col("w").alias("c"))
    members = meet(named.withColumnRenamed("c", "own"), stash(several, "several"), ["len", "x", "y"], ["own"]).select("seq", F.col("own").alias("c"))
    return groups.select("seq", "w", "len"), members


def _digests(members: DataFrame) -> DataFrame:
    """seq, digest of its conversations' ids: packed in ranges, then hashed in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids = None, []

        def packed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["seq", "first", "ids"])

        for b in batches:
            out = []
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (s != seq or len(ids) == PACK):
                    out.append((seq, ids[0], ",".join(map(str, ids))))
                    ids = []
                seq = s
                ids.append(c)
            yield packed(out)
        if ids:
            yield packed([(seq, ids[0], ",".join(map(str, ids)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, running = None, None
        for b in batches:
            out = []
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s == seq:
                    running.update(b",")
                else:
                    if running is not None:
                        out.append((seq, running.hexdigest()))
                    seq, running = s, hashlib.sha256()
                running.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["seq", "digest"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([running.hexdigest()], pa.string())], ["seq", "digest"])

    packs = members.repartitionByRange("seq", "c").sortWithinPartitions("seq", "c").mapInArrow(pack, "seq long, first long, ids string")
    ordered = packs.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "ids")
    return stash(ordered.mapInArrow(digest, "seq long, digest string"), "digests")


def refine(cls: int, depth: int, members: list[tuple[int, int, list[tuple[int, int, int]]]]) -> list[list]:
    """The nodes below (depth, cls), folded, as rows of NODE. members: sequence, conversations, turns (a, b, words) from here on."""
    nodes: list[list] = []
    saved: list[int] = []  # what each node saves by itself, and then with its subtree
    above: list[int] = []
    stack = [(depth, cls, -1, members)]
    while stack:
        d, name, parent, own = stack.pop()
        parts: dict[tuple[int, int], list] = {}
        for m in own:
            if len(m[2]) > d - depth:
                parts.setdefault(m[2][d - depth][:2], []).append(m)
        for part in parts.values():
            n_convs = sum(m[1] for m in part)
            child = min(m[0] for m in part)
            end = next((m[0] for m in part if len(m[2]) == d + 1 - depth), None)
            nodes.append([d + 1, child, name, n_convs, 0, 0, 0, end, d == depth])
            saved.append((n_convs - 1) * part[0][2][d - depth][2])
            above.append(parent)
            stack.append((d + 1, child, len(nodes) - 1, part))
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        node[5] = node[5] or 1
        node[6] += saved[i]
        if above[i] >= 0:
            up = nodes[above[i]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + node[5], up[6] + node[6]
    return nodes


def _refined(small: DataFrame, pieces: DataFrame) -> DataFrame:
    """Nodes below the classes of small (cls, depth, seq, w), each in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 8 + [pa.bool_()]
        names = [x.split()[0] for x in NODE.split(", ")]
        at, members = None, {}

        def done() -> list[list]:
            return refine(at[0], at[1], [(s, w, turns) for s, (w, turns) in members.items()]) if at else []

        for b in batches:
            out = []
            for cls, depth, seq, w, p, turns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (cls, depth) != at:
                    out += done()
                    at, members = (cls, depth), {}
                own = members.setdefault(seq, (w, []))[1]
                own += [(t["a"], t["b"], t["n"]) for t in turns if p * PIECE + t["i"] >= depth]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    rows = small.join(pieces, "seq").where(f"(p + 1) * {PIECE} > depth").select("cls", "depth", "seq", "w", "p", F.expr("transform(x, t -> struct(t.a, t.b, t.n, pmod(t.d - 1, 64) as i))".replace("64", str(PIECE))).alias("x"))
    return rows.repartition("cls").sortWithinPartitions("cls", "seq", "p").mapInArrow(run, NODE)


def _chains(single: DataFrame, pieces: DataFrame) -> DataFrame:
    """The tails of single (seq, w, len, parent, from: the depth of the first node) as unary chains."""
    rows = single.join(pieces, "seq").where(f"(p + 1) * {PIECE} >= `from`")
    total = rows.withColumn("words", F.aggregate("x", F.lit(0).cast("long"), lambda s, t: s + t["n"]))
    after = Window.partitionBy("seq").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    total = total.withColumn("after", F.coalesce(F.sum("words").over(after), F.lit(0)))
    here = F.when(F.col("w") == 1, F.transform("x", lambda t: F.lit(0).cast("long"))).otherwise(F.transform("x", lambda _, i: F.aggregate(F.slice("x", i + 1, F.size("x") - i), F.lit(0).cast("long"), lambda s, t: s + t["n"])))
    turns = total.select("seq", "w", "len", "parent", "from", "after", F.explode(F.arrays_zip(F.col("x.d").alias("d"), here.alias("s"))).alias("t")).where("t.d >= `from`")
    d = F.col("t.d")
    return turns.select(
        d.alias("depth"), F.col("seq").alias("conv_id"), F.when(d == F.col("from"), F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(d < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * (F.col("t.s") + F.when(F.col("w") > 1, F.col("after")).otherwise(0))).alias("saved_tokens"), F.when(d == F.col("len"), F.col("seq")).alias("end"), (d == F.col("from")).alias("top"),
    )


def _fold(level: DataFrame, below: DataFrame, tag: str) -> DataFrame:
    """Nodes of one depth (depth, conv_id, parent_conv_id, n_convs, own: what a node saves by itself) with what their children
    below (parent_conv_id, n_leaves, saved_tokens) add up to."""
    sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("s"))
    met = level.join(sums, "conv_id", "left")
    return stash(met.select("depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), tag)


def prefix_trie(conversations: DataFrame, local: int = LOCAL, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    text_batches(conversations.sparkSession)
    convs, turns = rebuilt(numbered_turns(conversations), block, heads)
    seqs, members = _sequences(convs, turns)
    own = turns.join(seqs.select(F.col("seq").alias("c")), "c", "left_semi").withColumn("p", F.expr(f"cast((d - 1) div {PIECE} as int)"))
    pieces = stash(own.groupBy(F.col("c").alias("seq"), "p").agg(F.sort_array(F.collect_list(F.struct("d", "a", "b", "n"))).alias("x")), "pieces")  # PIECE turns at most

    least, total = seqs.agg(F.min("seq"), F.sum("w")).first()
    if least is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    levels = [conversations.sparkSession.createDataFrame([(0, least, None, total, 0)], "depth long, conv_id long, parent_conv_id long, n_convs long, own long")]
    active = seqs.where("len > 0").withColumn("cls", F.lit(least))
    ends = [seqs.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(least).alias("conv_id"), F.col("seq").alias("end"))]
    chains, small, d = [], [], 0
    while not active.isEmpty():
        if d % PIECE == 0:
            active = active.drop("x").join(pieces.where(F.col("p") == d // PIECE).select("seq", "x"), "seq")
        turn = F.element_at("x", d % PIECE + 1)
        step = active.select("seq", "w", "len", "cls", "x", turn["a"].alias("a"), turn["b"].alias("b"), turn["n"].alias("n"))
        d += 1
        left = F.sum(F.col("len") - d)
        split = step.groupBy("cls", "a", "b").agg(F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("c"), F.first("n").alias("words"), left.alias("left"))
        split = stash(split.withColumn("size", F.col("c")), f"split-{d}")
        many = split.where("size > 1")
        levels.append(many.select(F.lit(d).cast("long").alias("depth"), "conv_id", F.col("cls").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own")))
        met = meet(step.withColumnRenamed("cls", "parent"), split.withColumnRenamed("cls", "parent"), ["parent", "a", "b"], ["seq"])
        going = F.col("size") > 1
        large = going & (F.col("left") > local) & (F.col("len") > d)
        met = stash(met.select("seq", "w", "len", F.col("conv_id").alias("cls"), "parent", "size", "left", F.when(large, F.col("x")).alias("x")), f"class-{d}")
        chains.append(met.where("size = 1").select("seq", "w", "len", "parent", F.lit(d).alias("from")))
        ends.append(met.where(f"size > 1 and len = {d}").select(F.lit(d).cast("long").alias("depth"), F.col("cls").alias("conv_id"), F.col("seq").alias("end")))
        small.append(met.where(f"size > 1 and len > {d} and left <= {local}").select("cls", F.lit(d).cast("long").alias("depth"), "seq", "w"))
        active = met.where(f"size > 1 and len > {d} and left > {local}").select("seq", "w", "len", "cls", "x")

    def union(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    nodes, folded = [], []
    if chains:
        retired = stash(_chains(union(chains), pieces).unionByName(_refined(union(small), pieces)), "retired")
        nodes.append(retired.drop("top"))
        tops = retired.where("top").select("depth", "parent_conv_id", "n_leaves", "saved_tokens")
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        kin = None if below is None else below.select("parent_conv_id", "n_leaves", "saved_tokens")
        if chains:
            own_tops = tops.where(F.col("depth") == depth + 1).drop("depth")
            kin = own_tops if kin is None else kin.unionByName(own_tops)
        if kin is None:
            kin = levels[0].selectExpr("parent_conv_id", "0L as n_leaves", "0L as saved_tokens").where("false")
        below = _fold(levels[depth], kin, f"folded-{depth}")
        folded.append(below)
    nodes.append(union(folded).join(union(ends), ["depth", "conv_id"], "left"))
    whole = union(nodes)
    digests = _digests(members)
    one = lambda ids: F.sha2(ids.cast("binary"), 256)
    ended = whole.where("end is not null").join(digests.withColumnRenamed("seq", "end"), "end", "left").withColumn("ends_sha256", F.coalesce("digest", one(F.col("end").cast("string"))))
    inner = whole.where("end is null").withColumn("ends_sha256", one(F.lit("")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return ended.select(columns).unionByName(inner.select(columns))
