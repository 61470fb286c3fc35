"""The trie of conversations that begin alike, by rolling prefix fingerprints.

Turns get a hash of role and text, which is checked in full: of all turns of one hash the smallest and the
largest content must be equal, else these turns are hashed anew. A conversation's prefix has the fingerprint
sum(hash * BASE ** place), scanned by numpy; a prefix and its depth make a candidate group. In each group the
turn and the parent's fingerprint of every member are compared with those of its representative, the
smallest conversation; by induction over depth, groups that agree hold equal prefixes. Members that
differ from their representative get new hashes for that turn and the scan is made anew, until none does.

Counts of subtrees go up without walking level by level: each node's share is laid at its
representative's turn, summed from the end of that conversation towards its start, and the sums of all members of a node
are added. A conversation of any length may lie in many partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, partitions, settle
from .scan import scanned

#: Fixed odd multiplier of the fingerprints.
BASE = 0x9E3779B97F4A7C15
#: Conversations in a block of BLOCK ids share their first turns, HEAD - 1 of them at most.
BLOCK, HEAD = 20, 4
#: Characters of role and text that divide ranges of turns; the order uses all.
RANGE_CHARS = 48
#: Ids of one node that are written as one piece of text.
PIECE_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def _hashed(turns: DataFrame, bits: int) -> DataFrame:
    """turns with `tid`, a number that equal turns (role, text) share and different turns do not."""
    content = F.struct("role", "text")
    turns = turns.withColumn("tid", F.shiftrightunsigned(F.xxhash64("role", "text"), 64 - bits) if bits < 64 else F.xxhash64("role", "text"))
    seed = 0
    while True:
        groups = turns.groupBy("tid").agg(F.min(content).alias("least"), F.max(content).alias("most"))
        clash = settle(groups.where("least <> most").select("tid", F.lit(True).alias("clash")), "clash")
        if clash.isEmpty():
            return turns
        seed += 1
        turns = turns.join(clash, "tid", "left").withColumn("tid", F.when(F.col("clash"), F.xxhash64("role", "text", F.lit(seed))).otherwise(F.col("tid"))).drop("clash")


def _placed(conversations: DataFrame, bits: int) -> DataFrame:
    """(conv_id, p, tid, n_words): each turn's place in its conversation, and its content as a number."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    turns = _hashed(rows.where("conv_id is not null"), bits).withColumn("body", F.concat("role", F.lit("\0"), "text")).drop("role", "text")
    found = scanned(turns, "conv_id", ["turn nulls first", "body"], [], "places", ranges=[F.col("turn").asc_nulls_first(), F.substring("body", 1, RANGE_CHARS)], drop=("body", "turn"))
    return settle(found.withColumnRenamed("at", "p"), "turns")


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, own, p, tid, n_words): the turns that each conversation takes from the first of its block, then its own."""
    wants = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first"), head_turns(F.col("conv_id")).alias("h")).where("h > 0")
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("p") < HEAD - 1)).withColumnRenamed("conv_id", "first")
    taken = wants.join(heads, "first").where("p < h").select("conv_id", F.lit(False).alias("own"), "p", "tid", "n_words")
    own = turns.where(F.col("p") >= head_turns(F.col("conv_id"))).select("conv_id", F.lit(True).alias("own"), "p", "tid", "n_words")
    return taken.union(own).withColumn("salt", F.lit(0))


def _fingerprinted(turns: DataFrame, bits: int) -> DataFrame:
    """(conv_id, depth, tid, n_words, f, parent_f) with equal (depth, f) for equal prefixes and for these only."""
    order, seed = ["own", "p"], 0
    while True:
        plain = F.xxhash64("tid") if bits == 64 else F.shiftrightunsigned(F.xxhash64("tid"), 64 - bits)
        term = F.when(F.col("salt") == 0, plain).otherwise(F.xxhash64("tid", "salt"))
        rows = scanned(turns.withColumn("term", term), "conv_id", order, ["term"], "prefixes", base=BASE, drop=("own", "p") if not seed else ("depth",), before=True)
        rows = settle(rows.select("conv_id", (F.col("at") + 1).alias("depth"), "tid", "n_words", "salt", F.col("sum_term").alias("f"), F.col("before_term").alias("parent_f")), "fingerprints")
        mine = F.struct("parent_f", "tid")
        groups = rows.groupBy("depth", "f").agg(F.min("parent_f").alias("a"), F.max("parent_f").alias("b"), F.min("tid").alias("c"), F.max("tid").alias("d"), F.min_by(mine, "conv_id").alias("model"))
        mixed = settle(groups.where("a <> b or c <> d").select("depth", "f", "model"), "mixed")
        if mixed.isEmpty():
            return rows.drop("salt")
        seed += 1
        differs = F.col("model").isNotNull() & (mine != F.col("model"))
        turns = rows.join(mixed, ["depth", "f"], "left").select("conv_id", "depth", "tid", "n_words", F.when(differs, seed).otherwise(F.col("salt")).alias("salt"))
        order = ["depth"]


def _piece_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, f, conv_id) -> for runs of one node the first id and the ids as text, PIECE_IDS in a piece."""
    at, ids, out = None, [], []

    def closed():
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def made():
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "f", "first_id", "piece"])

    for batch in batches:
        for depth, f, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "f", "conv_id"))):
            if (depth, f) != at or len(ids) == PIECE_IDS:
                closed()
                at = (depth, f)
            ids.append(conv)
        if len(out) > 1000:
            yield made()
    closed()
    yield made()


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of whole nodes -> the SHA-256 of each node's ids."""
    at, state, out = None, None, []

    def made():
        columns = list(zip(*out)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["depth", "f", "ends_sha256"])

    for batch in batches:
        for depth, f, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "f", "piece"))):
            if (depth, f) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (depth, f), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield made()
    if at is not None:
        out.append((*at, state.hexdigest()))
        yield made()


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, f, n_ends, ends_sha256) of nodes at which conversations end; depth 0 has those without turns.

    Ids are joined to pieces over ranges of (node, id), so a node at which very many conversations end is no single task but for the
    digest of its pieces, which is one sequence and read in a stream.
    """
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "f")).alias("end")).select("conv_id", "end.depth", "end.f")
    ends = settle(last.union(convs.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long"))), "ends")
    by = ("depth", "f", "conv_id")
    pieces = ends.repartitionByRange(partitions(ends.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(_piece_task, "depth long, f long, first_id long, piece string")
    digests = settle(pieces, "pieces").repartition("depth", "f").sortWithinPartitions("depth", "f", "first_id").mapInArrow(_digest_task, "depth long, f long, ends_sha256 string")
    return ends.groupBy("depth", "f").agg(F.count("*").alias("n_ends")).join(digests, ["depth", "f"])


def conversation_trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), equal ones by role and text; null role and text count as empty; repeated rows
    are turns of their own. Rows without conv_id take no part; `%` keeps the sign of the conversation's id. A
    table without conversations has no node. Texts of any length are compared whole; other columns are ignored. Hashes have `bits` bits
    at first: few make collisions likely, which are split (for tests).
    """
    convs = settle(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct(), "conversations")
    rows = _fingerprinted(_rebuilt(_placed(conversations, bits), convs), bits)
    nodes = rows.groupBy("depth", "f").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent_f").alias("parent_f"), F.min_by("n_words", "conv_id").alias("n_words"))
    ends = settle(_ends(rows, convs), "node_ends")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_f").alias("f")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, ["depth", "f"], "left").join(ends, ["depth", "f"], "left").withColumn("parent", F.when(F.col("depth") > 1, F.struct(F.col("depth") - 1, "parent_f"))), "nodes")

    shares = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), F.col("n_children").isNull().cast("long").alias("leaf"))
    laid = rows.select("conv_id", "depth", "f").join(shares, ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"])
    upward = scanned(laid, "conv_id", ["depth desc"], ["saved", "leaf"], "upward")
    below = upward.groupBy("depth", "f").agg(F.sum("sum_leaf").alias("n_leaves"), F.sum("sum_saved").alias("saved_tokens"))

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    parents = nodes.select(F.struct("depth", F.col("f").alias("parent_f")).alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = looked_up(nodes, "parent", parents, "parents").join(below, ["depth", "f"])
    first_id, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not n_convs:
        return found.select(*names)
    found = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(first_id)))
    top = nodes.agg(F.count_if(F.col("depth") == 1), F.sum(F.col("n_children").isNull().cast("long")), F.sum((F.col("n_convs") - 1) * F.col("n_words"))).first()
    bare = ends.where("depth = 0").select("ends_sha256").first()
    root = convs.sparkSession.createDataFrame([(first_id, 0, None, n_convs, top[0], top[1] or 1, top[2] or 0, bare and bare[0])], ", ".join(f"{n} {'string' if n == 'ends_sha256' else 'long'}" for n in names))
    out = root.unionByName(found.select(*names))
    return out.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", nothing)})


#: The same with whole prefixes as lists. CRC-32 is a fold over the bits of the id's characters.
SQL = f"""
with ids as (select distinct conv_id from conversations where conv_id is not null),
heads as (select conv_id, conv_id - conv_id % {BLOCK} as first_id, (xor(list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, e: case when e >= 0 then xor(c, e) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295) % {HEAD})::int as h from ids),
t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p from conversations where conv_id is not null),
b as (select h.conv_id, 0 own, p, r, x from heads h join t on t.conv_id = first_id where p < h
  union all select t.conv_id, 1, p, r, x from t join heads h on h.conv_id = t.conv_id where p >= h),
d as (select conv_id, x, row_number() over w as depth, list([r, x]) over (w rows unbounded preceding) as pre from b window w as (partition by conv_id order by own, p)),
n0 as (select depth, pre, min(conv_id) conv_id, count(*) n_convs, any_value(len(regexp_extract_all(x, '{WORD}'))) n_words from d group by all),
n as (select *, pre[:-2] as up from n0),
kids as (select up as pre, count(*) n_children from n group by up),
ends as (select pre, string_agg(conv_id::varchar, ',' order by conv_id) ids from (select conv_id, max_by(pre, depth) pre from d group by conv_id) group by pre),
s as (select n.conv_id, depth, (n_convs - 1) * n_words w, (n_children is null)::int leaf from n left join kids using (pre)),
u as (select d.depth, d.pre, sum(coalesce(w, 0)) over (partition by d.conv_id order by d.depth desc) w, sum(coalesce(leaf, 0)) over (partition by d.conv_id order by d.depth desc) l from d left join s on s.conv_id = d.conv_id and s.depth = d.depth),
below as (select pre, sum(w) w, sum(l) l from u group by pre),
top as (select min(conv_id) root_id, count(*) n_convs from ids)
select n.conv_id, n.depth, coalesce(m.conv_id, root_id) as parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children, l::bigint as n_leaves, w::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from n join below using (pre) left join kids using (pre) left join ends using (pre) left join n m on m.pre = n.up, top
union all select root_id, 0, null, n_convs, (select count(*) from n where depth = 1), greatest(1, (select coalesce(sum(leaf), 0) from s))::bigint, (select coalesce(sum(w), 0) from s)::bigint,
  sha256(coalesce((select string_agg(conv_id::varchar, ',' order by conv_id) from ids where conv_id not in (select conv_id from d)), '')) from top where n_convs > 0"""
