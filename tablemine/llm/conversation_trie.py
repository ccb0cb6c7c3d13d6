"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range of sequences.

Distinct sequences are dealt out by ranges of their order, so all sequences that share a prefix are neighbours and only the
paths of a range's first and last sequence can go on in another range. Everything off those two paths is final where it was
found; the two paths of all ranges are merged by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemine.llm.common import attach, numbered, written

#: Turns in a row: a longer conversation is several rows, whose trees hang on each other.
SEGMENT = 256
#: Turns in a range, on average: what one task holds.
SHARD_TURNS = 200_000
#: Ids that are joined to one piece of text before they are hashed.
PIECE_IDS = 50_000

# Fixed values of the rebuilding rule: the first h turns come from the first conversation of a hundred.
FAMILY, MOST_TURNS = 100, 6


def placed(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, position, key, chars), (conv_id, n_turns)): turns in order, and how many each conversation has.

    ``key`` is the MD5 of role and text, NULL ones as empty; ``chars`` the code points of the text. Turns are ordered by
    turn number, NULL first, equal numbers by ``key``; repeated rows are repeated turns. NULL conversations are one.
    """
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = df.select(F.col(f"`{conversation}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), key.alias("key"), F.length(t).cast("long").alias("chars"))
    rows = numbered(rows, [F.col("conv_id").asc(), F.col("turn").asc(), F.col("key").asc()], "place", "trie-order").drop("turn")
    convs = rows.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n_turns"))
    convs = written(convs, "trie-conversations")
    named = convs.select(F.col("conv_id").alias("_c"), "first")
    turns = rows.join(named, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", (F.col("place") - F.col("first") + 1).alias("position"), "key", "chars")
    return turns, convs.select("conv_id", "n_turns")


def rebuilt(df: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`placed`, after every conversation c has the first h turns of conversation c - c % 100 in place of its own first h.

    h is crc32(decimal c) % 6. Fewer turns are taken if there are fewer; a NULL conversation keeps its own turns.
    """
    turns, convs = placed(df, **names)
    c = F.col("conv_id")
    h = F.when(c.isNull(), F.lit(0)).otherwise(F.crc32(c.cast("string").cast("binary")) % MOST_TURNS)
    bases = convs.where(c % FAMILY == 0).select(c.alias("base"), F.col("n_turns").alias("n_base"))
    plan = convs.withColumn("h", h.cast("long")).join(bases, c - c % FAMILY == F.col("base"), "left")
    k = F.least(F.col("h"), F.coalesce(F.col("n_base"), F.lit(0)))
    plan = plan.select(c.alias("c"), "base", "h", k.alias("k"), (k + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n"))
    plan = written(plan, "trie-plan")
    own = turns.join(plan, c.eqNullSafe(F.col("c"))).where("position > h").select("conv_id", (F.col("k") + F.col("position") - F.col("h")).alias("position"), "key", "chars")
    heads = turns.where((c % FAMILY == 0) & (F.col("position") < MOST_TURNS)).withColumnRenamed("conv_id", "head")
    taken = heads.join(plan.where("k > 0"), F.col("head") == F.col("base")).where("position <= k").select(F.col("c").alias("conv_id"), "position", "key", "chars")
    return own.unionByName(taken), plan.select(F.col("c").alias("conv_id"), F.col("n").alias("n_turns"))


def _lane(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("b"), F.col("digest"))


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, b, p1, p2, q1, q2, ids, chars, last): SEGMENT turns a row; p and q are hashes of all turns before and up to it.

    A conversation without turns is one row without ids.
    """
    b = F.floor((F.col("position") - 1) / SEGMENT).cast("int")
    each = turns.withColumn("b", b).groupBy("conv_id", "b").agg(F.sort_array(F.collect_list(F.struct("position", "key", "chars"))).alias("t"))
    none = convs.where("n_turns = 0").select("conv_id", F.lit(0).alias("b"), F.array().cast(each.schema["t"].dataType).alias("t"))
    rows = each.unionByName(none).select("conv_id", "b", F.col("t.key").alias("ids"), F.col("t.chars").alias("chars"))
    rows = rows.withColumn("digest", F.md5(F.array_join(F.transform("ids", F.hex), "").cast("binary")))
    rows = rows.withColumn("x1", _lane(1)).withColumn("x2", _lane(2)).drop("digest")
    # one row per SEGMENT turns, so the windows hold the segments of a conversation and not its turns
    upto = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("q1", F.bit_xor("x1").over(upto)).withColumn("q2", F.bit_xor("x2").over(upto))
    last = F.col("b") == F.max("b").over(W.partitionBy("conv_id"))
    return rows.withColumn("last", last).withColumn("p1", F.col("q1").bitwiseXOR(F.col("x1"))).withColumn("p2", F.col("q2").bitwiseXOR(F.col("x2"))).drop("x1", "x2")


class TernaryTree:
    """A ternary search tree of sequences of codes; node numbers grow from parent to child."""

    def __init__(self):
        self.code: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.equal: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.members: list[int] = []
        self.first: list[int | None] = []

    def _add(self, code: int, parent: int) -> int:
        self.code.append(code)
        for x in (self.low, self.high, self.equal):
            x.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.members.append(0)
        self.first.append(None)
        return len(self.code) - 1

    def insert(self, codes: list[int], members: int, first: int | None) -> list[int]:
        """The nodes on the path of ``codes``, all counting ``members`` more and the smaller ``first``."""
        path, parent = [], -1
        for c in codes:
            node = self.equal[parent] if parent >= 0 else (0 if self.code else -1)
            if node < 0:
                node = self._add(c, parent)
                if parent >= 0:
                    self.equal[parent] = node
            while self.code[node] != c:
                side = self.low if c < self.code[node] else self.high
                if side[node] < 0:
                    side[node] = self._add(c, parent)
                node = side[node]
            self.members[node] += members
            if first is not None and (self.first[node] is None or first < self.first[node]):
                self.first[node] = first
            path.append(node)
            parent = node
        return path


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every range before its halves: sorted sequences inserted so give balanced trees."""
    open_ = [(0, n)]
    while open_:
        a, z = open_.pop()
        if a < z:
            m = (a + z) // 2
            yield m
            open_ += [(m + 1, z), (a, m)]


# what a task returns for each node; see _shard
_NODE = "shard int, edge string, me string, above string, up string, depth long, conv_id long, parent_conv_id long, n long, kids long, leaves long, saved long, chars long, q1 long, q2 long"
_KEYS = [x.split()[0] for x in _NODE.split(", ")]
_TYPES = [pa.int32(), *[pa.string()] * 4, *[pa.int64()] * 10]


def _shard(rows: list[dict], shard: int, block: int) -> list[list]:
    """The columns of _NODE for the sorted rows of one range.

    ``edge`` tells nodes on the path of the first row (l), the last row (r) or both (c); their leaves, saved and kids hold
    what hangs off the paths only. ``me`` names those nodes and ``above`` the one before on the path. ``up`` is the name by which
    the parent's conv_id is looked up in the end, if it isn't final here. The first node of a path stands for all turns
    before the block.
    """
    codes = {k: i for i, k in enumerate(sorted({k for r in rows for k in r["ids"]}))}
    entries = {e: i for i, e in enumerate(sorted({(r["p1"], r["p2"]) for r in rows}))}
    tree = TernaryTree()
    chars: dict[int, int] = {}
    hangs: dict[int, tuple] = {}
    named: dict[int, str] = {}
    begun: dict[int, tuple[int, int]] = {}
    ends: dict[int, tuple[int, int]] = {}
    paths: dict[int, list[int]] = {}
    for i in medians(len(rows)):
        r = rows[i]
        path = tree.insert([entries[r["p1"], r["p2"]], *[codes[k] for k in r["ids"]]], r["n"], r["first"])
        chars.update(zip(path[1:], r["chars"]))
        ends[path[-1]] = (r["q1"], r["q2"])
        if r["kids"]:
            hangs[path[-1]] = (r["kids"], r["leaves"], r["saved"])
        if i in (0, len(rows) - 1):
            paths[i] = path
            name = hashlib.md5(f"{block}:{r['p1']}:{r['p2']}".encode())
            for node, k in zip(path, [b"", *r["ids"]]):
                name.update(k)
                named[node] = name.hexdigest()
        begun[path[0]] = (r["p1"], r["p2"])
    left, right = set(paths[0]), set(paths[len(rows) - 1])
    edge = left | right
    kids, leaves, saved = ([0] * len(tree.code) for _ in range(3))
    for i in range(len(tree.code) - 1, -1, -1):  # children before parents
        more = hangs.get(i, (0, 0, 0))
        kids[i] += more[0]
        leaves[i] += more[1]
        saved[i] += more[2]
        up = tree.parent[i]
        if i in edge:
            continue
        leaves[i] += kids[i] == 0
        saved[i] += (tree.members[i] - 1) * chars.get(i, 0)
        if up >= 0:
            kids[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    out: list[list] = [[] for _ in _KEYS]
    for i, up in enumerate(tree.parent):
        side = ("c" if i in left and i in right else "l" if i in left else "r") if i in edge else None
        inner = up >= 0 and (up not in edge) and not (block and tree.parent[up] < 0)
        if up < 0 or inner:
            lookup = None
        elif block and tree.parent[up] < 0:  # the node where the block before ends
            lookup = "{}:{}".format(*begun[up])
        else:
            lookup = named[up]
        q = begun[i] if up < 0 and block else ends.get(i, (None, None))
        row = (shard, side, named.get(i), named[up] if side and up >= 0 else None, lookup, block * SEGMENT + tree.depth[i], tree.first[i],
               tree.first[up] if inner else None, tree.members[i], kids[i], leaves[i], saved[i], chars.get(i, 0), *q)
        for column, v in zip(out, row):
            column.append(v)
    return out


def _merged(nodes: DataFrame) -> DataFrame:
    """``nodes`` of all ranges of a block with the paths at their borders merged: every node once, sums complete.

    Each merged node belongs to the first range that has it. Within a range it counts for itself and the nodes above it on the
    two paths, so the sums over all ranges give each subtree once.
    """
    inner, border = nodes.where("edge IS NULL"), nodes.where("edge IS NOT NULL")
    one = border.groupBy("me").agg(
        F.min("shard").alias("home"), F.max("above").alias("above"), F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    one = written(one, "trie-border")
    more = one.where("above IS NOT NULL").groupBy(F.col("above").alias("me")).agg(F.count(F.lit(1)).alias("more"))
    one = one.join(more, "me", "left").withColumn("kids", F.col("kids") + F.coalesce(F.col("more"), F.lit(0))).drop("more")
    leaf = (F.col("kids") == 0).cast("long")
    one = one.withColumn("leaves", F.col("leaves") + leaf).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("chars"))

    own = border.select("me", "shard", "edge", "depth").join(one.select("me", "home", "leaves", "saved"), "me")
    at_home = lambda c: F.when(F.col("shard") == F.col("home"), F.col(c)).otherwise(F.lit(0))
    down = W.partitionBy("shard", "edge").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    beside = W.partitionBy("shard")
    total = lambda c: F.sum(at_home(c)).over(down) + F.when(F.col("edge") == "c", F.coalesce(F.sum(F.when(F.col("edge") != "c", at_home(c))).over(beside), F.lit(0))).otherwise(F.lit(0))
    sums = own.select("me", total("leaves").alias("leaves"), total("saved").alias("saved")).groupBy("me").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = one.drop("leaves", "saved", "home").join(sums, "me").select(F.lit(None).cast("long").alias("parent_conv_id"), "*")
    kept = ["me", "up", "depth", "conv_id", "parent_conv_id", "n", "kids", "leaves", "saved", "q1", "q2"]
    return inner.select(*kept).unionByName(whole.select(*kept))


def end_hashes(rows: DataFrame) -> DataFrame:
    """(q1, q2, ends): SHA-256 of the comma-joined, ascending conv_ids of ``rows(q1, q2, conv_id)`` with equal q1, q2; NULL comes last.

    Ranges join their ids to pieces. A run within one range is hashed there. For the others one task after another piece is
    hashed as it comes, which SHA-256 demands; it holds one piece at a time.
    """
    order = [F.col("q1").asc(), F.col("q2").asc(), F.col("conv_id").asc_nulls_last()]
    dealt = rows.select("q1", "q2", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["q1", "q2", "task", "k", "piece", "ends"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, now, ids, k, first = TaskContext.get().partitionId(), None, [], 0, True
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(6)], names)

        def close(inside: bool) -> None:
            text = ",".join(ids).encode()
            whole = inside and k == 0
            out.append((*now, task, k, None if whole else text, hashlib.sha256(text).hexdigest() if whole else None))

        for b in parts:
            for a, c, i in zip(*[x.to_pylist() for x in b.columns]):
                if (a, c) != now:
                    if now is not None:
                        close(not first)
                        first = False
                    now, ids, k = (a, c), [], 0
                elif len(ids) >= PIECE_IDS:
                    close(False)
                    ids, k = [], k + 1
                ids.append("NULL" if i is None else str(i))
                if len(out) >= 1000:
                    yield batch()
                    out.clear()
        if now is not None:
            close(False)
        yield batch()

    pieces = written(dealt.mapInArrow(join, "q1 long, q2 long, task int, k long, piece binary, ends string"), "trie-ends")
    cut = pieces.where("piece IS NOT NULL").repartition("q1", "q2").sortWithinPartitions("q1", "q2", "task", "k").select("q1", "q2", "piece")

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], ["q1", "q2", "ends"])
        for b in parts:
            for i in range(b.num_rows):
                at, piece = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_py()
                if at == now:
                    digest.update(b",")
                    digest.update(piece)
                else:
                    if now is not None:
                        yield batch()
                    now, digest = at, hashlib.sha256(piece)
        if now is not None:
            yield batch()

    return pieces.where("ends IS NOT NULL").select("q1", "q2", "ends").unionByName(cut.mapInArrow(fold, "q1 long, q2 long, ends string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per distinct prefix.

    ``turns(conv_id, position, key, chars)`` and ``convs(conv_id, n_turns)`` as :func:`rebuilt` gives them. A node is named by its
    smallest member and its depth, so its last turn is turn ``depth`` of that conversation. n_convs are the conversations that
    begin with it, n_leaves and saved_tokens cover its subtree, ends_sha256 those that end at it. Conversations with the same
    turns are one row before the trees are built, whatever their number. Blocks of SEGMENT turns are done from the last to
    the first, as many rounds as the longest conversation has blocks. NULL conversations count, name a node only if it
    has no other, and are written NULL among the ends. No conversations, no node.
    """
    rows = written(segments(turns, convs), "trie-segments")
    same = rows.groupBy("b", "p1", "p2", "q1", "q2", "ids", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    same = written(same, "trie-distinct")
    sizes = {r.b: r.n for r in same.groupBy("b").agg(F.sum(F.size("ids") + 1).alias("n")).collect()}
    entry: DataFrame | None = None
    done: list[DataFrame] = []
    for block in sorted(sizes, reverse=True):
        at = same.where(F.col("b") == block).drop("b")
        if entry is None:
            at = at.select("*", *[F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        else:
            at = at.join(entry, ["q1", "q2"], "left")
        order = ["p1", "p2", "ids"]

        def build(parts: Iterator[pa.RecordBatch], block: int = block) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            found = [r for b in parts for r in b.to_pylist()]
            if found:
                columns = _shard(found, TaskContext.get().partitionId(), block)
                for i in range(0, len(columns[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000], t) for c, t in zip(columns, _TYPES)], _KEYS)

        dealt = at.repartitionByRange(max(1, -(-sizes[block] // SHARD_TURNS)), *order).sortWithinPartitions(*order)
        nodes = written(_merged(written(dealt.mapInArrow(build, _NODE), "trie-shards")), "trie-nodes")
        own = F.col("depth") > block * SEGMENT if block else F.lit(True)
        entry = nodes.where(~own).select("q1", "q2", "kids", "leaves", "saved")
        done.append(nodes.where(own))
    if not done:
        done = [turns.sparkSession.createDataFrame([], "me string, up string, depth long, conv_id long, parent_conv_id long, n long, kids long, leaves long, saved long, q1 long, q2 long")]
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    parents = nodes.where("me IS NOT NULL").select(F.col("me").alias("up"), F.col("conv_id").alias("of"))
    if len(done) > 1:
        at_end = nodes.where(F.col("q1").isNotNull()).select(F.concat_ws(":", "q1", "q2").alias("up"), F.col("conv_id").alias("of"))
        parents = parents.unionByName(at_end.join(nodes.select("up").distinct(), "up", "left_semi"))
    looked_up = attach(nodes.where("up IS NOT NULL"), parents, ["up"])
    nodes = looked_up.unionByName(nodes.where("up IS NULL").withColumn("of", F.lit(None).cast("long")))
    ended = nodes.where("q1 IS NOT NULL").join(end_hashes(rows.where("last")), ["q1", "q2"], "left")
    out = ended.unionByName(nodes.where("q1 IS NULL").withColumn("ends", F.lit(None).cast("string")))
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "of").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, **names: str) -> DataFrame:
    """:func:`trie` of all conversations of ``df``, rebuilt. Other columns are ignored."""
    return trie(*rebuilt(df, **names))
