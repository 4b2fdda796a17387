"""Prefix trie of conversations by collapsing whole sequences.

1. Turns are put in order and each conversation is rebuilt: the first turns of
   the first conversation of its block, then its own.
2. A turn becomes a 127-bit value of its role and text; a prefix is named by its
   depth and the polynomial of its turns' values modulo 2**127 - 1.  Such names
   join: that of a long conversation's later part needs only the name before it.
3. Identical rebuilt conversations collapse into one weighted sequence with its
   list of ends, told by the digest of their ids.
4. Sequences that are proper prefixes of others are dropped by an anti-join; what
   is left are the leaves.
5. Prefixes of the sequences are summed by name: members, leaves, and costs.  A
   node belongs to the leaf of smallest conversation below it, so each leaf owns
   the last part of its own path; what a subtree holds is the sum over its leaves
   of what they own, less what the node's own leaf owns above the node.  No pairs
   of nodes and ancestors are formed.

Rows are range-dealt by conversation and place, so a conversation of any length
is spread over tasks; what one part of it needs from the parts before is one row
a part.  Ends of one sequence are joined in pieces of 64 KB before one task
digests the pieces in order.

Defined results: null role or text is empty; null turns come first, turns that
tie go by role, then text; repeated rows are turns of their own; rows without a
conversation belong to none and are left out; an empty table gives no nodes, not
even a root; very long texts: whole, words and value are taken in the JVM;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, tidy

#: Conversations to a block, and most turns taken over plus one.
BLOCK, TAKEN = 20, 4
P = (1 << 127) - 1
#: Base of the polynomial; any large number will do.
BASE = int.from_bytes(sha256(b"prefix names").digest()[:15], "big")
ROOT = bytes(16)
PIECE = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def block_of(conv: Column, block: int = BLOCK) -> Column:
    return conv - conv % block


def taken(conv: Column, most: int = TAKEN) -> Column:
    """Turns that a conversation takes over from its block's first one."""
    return (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")


def numbered(rows: DataFrame, group: str, order: list[str], value: Column | None = None, name: str = "place", dropped: tuple[str, ...] = ()) -> DataFrame:
    """rows (without the columns dropped) with the running sum of value (default 1, so the place) within group, up to and with each row.

    Rows are range-dealt by group and order; a window adds up within the rows
    of one group in one part, and a table of one row a part carries on the
    groups that go on from part to part.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_value", (F.lit(1) if value is None else value).cast("long")).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = saved(dealt.withColumn("_row", F.monotonically_increasing_id()).drop(*dropped), name).withColumn("_part", F.shiftright("_row", 33))
    ends = dealt.groupBy("_part").agg(F.min_by(group, "_row").alias("first"), F.max_by(group, "_row").alias("last"))
    # sums of the last group of each part: a row a part
    tails = dealt.join(F.broadcast(ends.select("_part", F.col("last").alias(group))), ["_part", group]).groupBy("_part").agg(F.sum("_value").alias("total"))
    carried, held = [], (None, 0)
    for r in sorted(ends.join(tails, "_part").collect(), key=lambda r: r["_part"]):
        before = held[1] if r["first"] == held[0] else 0
        if before:
            carried.append((r["_part"], r["first"], before))
        held = (r["last"], r["total"] + (before if r["first"] == r["last"] else 0))
    local = F.sum("_value").over(Window.partitionBy("_part", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn(name, local)
    if carried:
        kind = rows.schema[group].dataType.simpleString()
        out = out.join(F.broadcast(spark.createDataFrame(carried, f"_part long, {group} {kind}, _before long")), ["_part", group], "left")
        out = out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return out.select(*[c for c in rows.columns if c not in dropped], name)


def rebuilt(rows: DataFrame, block: int = BLOCK, most: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, value, words) of rebuilt turns, where places ascend with gaps, and (conv_id) of all conversations, turnless ones too."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    role, text = empty("role"), empty("text")
    value = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"), value.alias("value"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    # numbered() puts nulls first, as asked; texts are sorted on but not kept
    turns = saved(numbered(turns, "conv_id", ["turn", "role", "text"], dropped=("turn", "role", "text")), "turns")
    conv = F.col("conv_id")
    own = turns.filter(F.col("place") > taken(conv, most))
    heads = turns.filter((conv == block_of(conv, block)) & (F.col("place") < most)).groupBy(conv.alias("block")).agg(F.collect_list(F.struct("place", "value", "words")).alias("head"))  # fewer than most a conversation
    convs = turns.select("conv_id").distinct().withColumn("block", block_of(conv, block))
    lent = convs.join(heads, "block").select("conv_id", F.explode(F.filter("head", lambda x: x["place"] <= taken(conv, most))).alias("x")).select("conv_id", "x.place", "x.value", "x.words")
    return own.unionByName(lent), convs.select("conv_id")


def walked(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, path, parent, words): the prefixes of each conversation by name."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    @tidy
    def named(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        now, depth, name, raw = object(), 0, 0, ROOT
        for batch in batches:
            depths, paths, parents = [], [], []
            for conv, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv != now:
                    now, depth, name, raw = conv, 0, 0, ROOT
                depth, name = depth + 1, (name * BASE + int.from_bytes(value, "big")) % P
                parents.append(raw)
                raw = name.to_bytes(16, "big")
                depths.append(depth)
                paths.append(raw)
            n = len(depths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(depths, pa.int64()), pa.array(paths, pa.binary()), pa.array(parents, pa.binary()), batch.column(2), pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64())],
                ["conv_id", "depth", "path", "parent", "words", "_part", "_row"],
            )
            row += n

    shape = f"conv_id {kind}, depth long, path binary, parent binary, words long, _part long, _row long"
    dealt = turns.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place").select("conv_id", "value", "words")
    parts = saved(dealt.mapInArrow(named, shape), "walks")
    ends = parts.groupBy("_part").agg(F.min_by("conv_id", "_row").alias("first"), F.max_by(F.struct("conv_id", "depth", "path"), "_row").alias("last")).collect()  # a row a part
    carried = _carried((r["_part"], r["first"], *r["last"]) for r in ends)
    if not carried:
        return parts.drop("_part", "_row")

    @tidy
    def joined(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            found = set(columns["_part"].unique().to_pylist()) & carried.keys()
            if found:
                data = {n: columns[n].to_pylist() for n in ("conv_id", "depth", "path", "parent", "_part")}
                for i, (part, conv, depth) in enumerate(zip(data["_part"], data["conv_id"], data["depth"])):
                    if part in found and carried[part][0] == conv:
                        _, before, name = carried[part]
                        data["path"][i] = joined_name(name, data["path"][i], depth)
                        data["parent"][i] = joined_name(name, data["parent"][i], depth - 1)
                        data["depth"][i] = before + depth
                columns |= {"depth": pa.array(data["depth"], pa.int64()), "path": pa.array(data["path"], pa.binary()), "parent": pa.array(data["parent"], pa.binary())}
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in ("conv_id", "depth", "path", "parent", "words")})

    return saved(parts.mapInArrow(joined, f"conv_id {kind}, depth long, path binary, parent binary, words long"), "walks")


def joined_name(before: int, path: bytes, turns: int) -> bytes:
    """Name of a prefix and of so many turns after it."""
    return ((before * pow(BASE, turns, P) + int.from_bytes(path, "big")) % P).to_bytes(16, "big")


def _carried(parts: Iterable[tuple]) -> dict[int, tuple]:
    """part -> (conversation, depth, name) that goes on from the part before; parts: (part, first conversation, last one, its depth and path there)."""
    out, held = {}, None
    for part, first, last, depth, path in sorted(parts):
        name = int.from_bytes(path, "big")
        if held and held[0] == first:
            out[part] = held
            if first == last:
                name = int.from_bytes(joined_name(held[2], path, depth), "big")
                depth += held[1]
        held = (last, depth, name)
    return out


def collapsed(walks: DataFrame) -> DataFrame:
    """(conv_id, depth, path, weight, ends_sha256): whole sequences, each told by its smallest conversation."""
    kind = walks.schema["conv_id"].dataType.simpleString()
    last = walks.groupBy("conv_id").agg(F.max(F.struct("depth", "path")).alias("end")).select("end.depth", "end.path", "conv_id")
    order = ["depth", "path", "conv_id"]

    @tidy
    def pieces(batches):
        now, ids, size, out = None, [], 0, []

        def close():
            if ids:
                out.append({"depth": now[0], "path": now[1], "conv_id": ids[0], "n": len(ids), "piece": ",".join(map(str, ids))})
                ids.clear()

        for batch in batches:
            for depth, path, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (depth, path) != now or size > PIECE:
                    close()
                    now, size = (depth, path), 0
                ids.append(conv)
                size += len(str(conv)) + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=piece_shape)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=piece_shape)

    @tidy
    def digested(batches):
        now, held, out = None, None, []

        def close():
            if now is not None:
                out.append({"conv_id": held[0], "depth": now[0], "path": now[1], "weight": held[1], "ends_sha256": held[2].hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if (r["depth"], r["path"]) != now:
                    close()
                    now, held = (r["depth"], r["path"]), [r["conv_id"], 0, sha256()]
                else:
                    held[2].update(b",")
                held[1] += r["n"]
                held[2].update(r["piece"].encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=whole_shape)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=whole_shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    piece_ddl, whole_ddl = f"depth long, path binary, conv_id {kind}, n long, piece string", f"conv_id {kind}, depth long, path binary, weight long, ends_sha256 string"
    piece_shape, whole_shape = (to_arrow_schema(StructType.fromDDL(x)) for x in (piece_ddl, whole_ddl))
    parts = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, piece_ddl)
    return parts.repartition("depth", "path").sortWithinPartitions(*order).mapInArrow(digested, whole_ddl)


def trie(rows: DataFrame, block: int = BLOCK, most: int = TAKEN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node; rows: (conv_id, turn, role, text)."""
    turns, convs = rebuilt(rows, block, most)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT)).alias("path"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    walks = walked(turns).unionByName(roots)
    sequences = saved(collapsed(walks), "sequences")
    up = [(F.col("depth") - 1).alias("depth"), F.col("parent").alias("path")]
    inner = walks.filter("depth > 0").select(*up).distinct()
    leaves = sequences.join(inner, ["depth", "path"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    weighted = sequences.select("conv_id", "weight").join(leaves, "conv_id", "left").select("conv_id", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    kept = saved(walks.join(saved(weighted, "weighted"), "conv_id"), "kept")
    nodes = kept.groupBy("depth", "path").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.max("words").alias("words"), F.max("parent").alias("parent"),
        F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
    ).withColumn("cost", (F.col("n_convs") - 1) * F.col("words"))
    nodes = saved(numbered(nodes, "owner", ["depth"], F.col("cost"), "owned"), "nodes")
    owned = saved(nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("cost").alias("cost")), "owned")
    below = kept.filter("leaf = 1").join(owned, "conv_id").select("depth", "path", "cost")
    facts = (
        nodes.select("depth", "path", "conv_id", "parent", "n_convs", "n_leaves", (F.col("cost") - F.col("owned")).alias("saved_tokens"))
        .unionByName(nodes.filter("depth > 0").select(*up, F.lit(1).alias("n_children")), allowMissingColumns=True)
        .unionByName(below.withColumnRenamed("cost", "saved_tokens"), allowMissingColumns=True)
        .unionByName(sequences.select("depth", "path", "ends_sha256"), allowMissingColumns=True)
    )
    whole = saved(facts.groupBy("depth", "path").agg(
        F.max("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.coalesce(F.sum("n_children"), F.lit(0)).cast("long").alias("n_children"),
        F.sum("n_leaves").cast("long").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(sha256().hexdigest())).alias("ends_sha256"),
    ), "trie")
    parents = whole.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, ["depth", "parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of every conversation."""
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = rf"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
         {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as x from conversations where conv_id is not null),
c as (
  select conv_id, list(x order by pos) as own,
         xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda k: unicode(k)::bigint)),
           lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % {TAKEN} as h
  from t group by conv_id),
s as (
  select c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) as turns from c left join c b on b.conv_id = c.conv_id - c.conv_id % {BLOCK}),
k as (
  select conv_id, len(turns) as n, d, md5(to_json(turns[1:d])::varchar) as key, case when d > 0 then md5(to_json(turns[1:d - 1])::varchar) end as up,
         case when d > 0 then len(regexp_extract_all(turns[d].t, '{WORD}')) else 0 end as words
  from (select *, unnest(range(0, len(turns) + 1)) as d from s)),
node as (
  select d, key, min(conv_id) as conv_id, any_value(up) as up, count(*) as n_convs, any_value(words) as words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from k group by d, key),
child as (select up, count(*) as n_children from node where d > 0 group by up),
below as (
  select a.key, sum((v.n_convs - 1) * v.words)::bigint as saved_tokens, count(*) filter (where c.n_children is null) as n_leaves
  from node v join k a on a.conv_id = v.conv_id and a.d <= v.d left join child c on c.up = v.key group by a.key)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
from node n join below b on b.key = n.key left join child c on c.up = n.key left join node p on p.key = n.up
"""
