"""Prefix trie of conversations by a splitter skeleton.

A turn is a digest of role and text and the text's length; a conversation is the path of its turns'
digests. In the order of (path, conv_id) the conversations below a node of the trie follow each
other. A sample of the paths gives splitters that cut this order into shards; conversations with one
path fall into several shards if there are many. Only prefixes of splitters can have conversations in
more than one shard: the trie of the splitters, the skeleton, is broadcast. Every shard goes over its
sorted paths with a stack, finishes all other nodes by itself, and leaves partial numbers for the
nodes of the skeleton, which Spark adds up; sums over the skeleton's subtrees follow on the driver
(it has as many nodes as the splitters have turns). Ends of a skeleton node stay in the order of
ids, as short lists, and pass through the hash one after the other, since SHA-256 goes by order.

What a task holds: the open path, finished nodes below it until their parent's least conversation is
known (a shard has about ``SHARD`` turns), and one conversation's digests and lengths, of about
24 bytes a turn. Texts do not travel.

Defined results: turns of a conversation go by turn (null first), turns with one number by digest;
null roles and texts are empty; rows without a conv_id belong to no conversation; repeated rows
are turns of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Turns of a shard, sampled paths for each, turns of a splitter, bytes of a digest, ids of a list of ends.
SHARD, SAMPLED, DEPTH, WIDTH, LISTED = 1 << 17, 16, 256, 16, 512
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOUND = f"{NODE}, kind int, skeleton int, shard int, place long, chars long, ids string"
NONE = hashlib.sha256().hexdigest()


def rebuilt(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path, chars): conversation c begins with the first crc32(c) % ``heads`` turns of c - c % ``every``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", digest.alias("digest"), F.length(text).alias("chars"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h)
    whole = both.select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.chars").alias("chars"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 places (path, conv_id) that cut a sample into equal numbers of turns."""
    if shards < 2:
        return []
    cut = F.substring("path", 1, DEPTH * WIDTH)
    some = paths.select("conv_id", cut.alias("path"), (F.length("path") > DEPTH * WIDTH).alias("long"), (F.size("chars") + 1).alias("n"))
    rows = some.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLED).collect()
    # a path that is cut stands before all that go on from it
    found = sorted(((bytes(r["path"]), -(1 << 63) if r["long"] else r["conv_id"]), r["n"]) for r in rows)
    whole, sofar, out = sum(n for _, n in found), 0, []
    for at, n in found:
        if sofar * shards >= whole * (len(out) + 1) and (not out or at > out[-1]):
            out.append(at)
        sofar += n
    return out[: shards - 1]


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root, parents come before children."""

    def __init__(self, paths):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in paths:
            at = 0
            for i in range(0, len(path), WIDTH):
                key = (at, path[i : i + WIDTH])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]


class Open:
    """A node with conversations still to come."""

    __slots__ = ("chars", "children", "convs", "ends", "first", "leaves", "listed", "place", "saved", "skeleton", "waiting")

    def __init__(self, chars: int, skeleton: int):
        self.chars, self.skeleton, self.first, self.convs, self.children, self.leaves, self.saved = chars, skeleton, None, 0, 0, 0, 0
        self.ends, self.waiting, self.listed, self.place = None, [], [], 0

    def add(self, conv: int, n: int) -> None:
        self.convs += n
        self.first = conv if self.first is None or conv < self.first else self.first


class Shard:
    """Goes over sorted paths; ``out`` gets rows of :data:`FOUND`."""

    def __init__(self, number: int, skeleton: Skeleton, out: list[tuple]):
        self.number, self.skeleton, self.out, self.path = number, skeleton, out, b""
        self.stack = [Open(0, 0)]

    def conversation(self, conv: int, path: bytes, chars) -> None:
        at, most = 0, min(len(path), len(self.path)) // WIDTH
        while at < most and path[at * WIDTH : at * WIDTH + WIDTH] == self.path[at * WIDTH : at * WIDTH + WIDTH]:
            at += 1
        self.close(at + 1)
        for i in range(at, len(path) // WIDTH):
            top = self.stack[-1].skeleton
            known = self.skeleton.child.get((top, path[i * WIDTH : i * WIDTH + WIDTH]), -1) if top >= 0 else -1
            self.stack.append(Open(int(chars[i]), known))
        self.path, node = path, self.stack[-1]
        node.add(conv, 1)
        if node.skeleton >= 0:
            node.listed.append(conv)
            if len(node.listed) == LISTED:
                self.list_ends(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(f",{conv}".encode())

    def list_ends(self, node: Open) -> None:
        self.out.append((*(None,) * 8, 2, node.skeleton, self.number, node.place, None, ",".join(map(str, node.listed))))
        node.listed, node.place = [], node.place + 1

    def close(self, left: int) -> None:
        """Closes nodes until ``left`` are open."""
        while len(self.stack) > left:
            depth, node = len(self.stack) - 1, self.stack.pop()
            up = self.stack[-1] if self.stack else None
            if node.skeleton >= 0:
                if node.listed:
                    self.list_ends(node)
                if node.convs:
                    self.out.append((node.first, depth, None, node.convs, node.children, node.leaves, node.saved, None, 1, node.skeleton, self.number, None, node.chars, None))
            else:
                node.leaves += not node.children
                node.saved += (node.convs - 1) * node.chars
                ends = node.ends.hexdigest() if node.ends else NONE
                row = (node.first, depth, None, node.convs, node.children, node.leaves, node.saved, ends, 0)
                self.out += [(*x[:2], node.first, *x[3:], None, self.number, None, None, None) for x in node.waiting]
                up.children += 1
                if up.skeleton >= 0:
                    self.out.append((*row, up.skeleton, self.number, None, None, None))
                else:
                    up.waiting.append(row)
            if up and node.convs:
                up.add(node.first, node.convs)
                up.leaves += node.leaves
                up.saved += node.saved


def _hash_lists(batches):
    """(skeleton, sha256) of lists that come in order, one node after the other."""
    node, state, done = None, None, []
    for b in batches:
        for at, ids in zip(b["skeleton"].tolist(), b["ids"].tolist(), strict=True):
            if at != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pd.DataFrame(done, columns=["skeleton", "sha"]).astype({"skeleton": "int32"})
        done = []
    if state:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["skeleton", "sha"]).astype({"skeleton": "int32"})


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes, as of the contract, of (conv_id, path, chars)."""
    spark = paths.sparkSession
    paths = C.materialise(paths, "paths")
    turns = paths.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    if shards is None:
        shards = max(1, -(-turns // SHARD), min(2 * spark.sparkContext.defaultParallelism, turns // (1 << 12)))
    cuts = splitters(paths, shards)
    skeleton = Skeleton(p for p, _ in cuts)
    sent = spark.sparkContext.broadcast((cuts, skeleton))

    def deal(batches):
        at = sent.value[0]
        for b in batches:
            b["path"] = [bytes(p) for p in b["path"]]
            yield b.assign(shard=[bisect.bisect_right(at, x) for x in zip(b["path"], b["conv_id"].tolist(), strict=True)]).astype({"shard": "int32"})

    def walk(batches):
        out, shard = [], None
        frame = lambda: pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")], dtype=object)
        for b in batches:
            for number, conv, path, chars in zip(b["shard"].tolist(), b["conv_id"].tolist(), b["path"].tolist(), b["chars"].tolist(), strict=True):
                if shard is None or shard.number != number:
                    if shard:
                        shard.close(0)
                    shard = Shard(number, sent.value[1], out)
                shard.conversation(conv, bytes(path), chars)
                if len(out) >= 20_000:
                    yield frame()
                    out.clear()
        if shard:
            shard.close(0)
        for at in range(0, len(out), 20_000):
            yield pd.DataFrame(out[at : at + 20_000], columns=[x.split()[0] for x in FOUND.split(", ")], dtype=object)

    dealt = paths.mapInPandas(deal, "conv_id long, path binary, chars array<int>, shard int")
    in_order = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = C.materialise(in_order.mapInPandas(walk, FOUND), "nodes")
    partial = found.where("kind = 1").groupBy("skeleton").agg(F.min("conv_id").alias("first"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("chars").alias("chars"))
    at = {r["skeleton"]: r.asDict() for r in partial.collect()}  # of nodes of the skeleton only
    lists = found.where("kind = 2").select("skeleton", "shard", "place", "ids")
    ends = dict(map(tuple, lists.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "place").mapInPandas(_hash_lists, "skeleton int, sha string").collect()))
    for k in at:
        at[k] |= {"more": 0, "more_leaves": 0, "more_saved": 0}
    for k in sorted(at, reverse=True):
        x, up = at[k], at.get(skeleton.parent[k])
        x["more_leaves"] += not x["n_children"] + x["more"]
        x["more_saved"] += (x["n_convs"] - 1) * x["chars"]
        if up:
            up["more"] += 1
            up["more_leaves"] += x["more_leaves"]
            up["more_saved"] += x["more_saved"]
    whole = [(x["first"], skeleton.depth[k], at[skeleton.parent[k]]["first"] if k else None, x["n_convs"], x["n_children"] + x["more"], x["n_leaves"] + x["more_leaves"], x["saved_tokens"] + x["more_saved"], ends.get(k, NONE)) for k, x in at.items()]
    parents = spark.createDataFrame([(k, x["first"]) for k, x in at.items()], "skeleton int, __first long")
    names = [x.split()[0] for x in NODE.split(", ")]
    inner = found.where("kind = 0").join(F.broadcast(parents), "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__first"))
    return inner.select(*names).unionByName(spark.createDataFrame(whole, NODE))


def op13_prefix_trie(spark, sf_dir):
    return trie(rebuilt(C.table(spark, sf_dir, "conversations")))


_BIT = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: {_BIT})), 4294967295)"

SQL = f"""
with turns as (
  select conv_id, turn, md5(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as d, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
placed as (select conv_id, d, chars, row_number() over (partition by conv_id order by turn nulls first, d) as k from turns),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_CRC} % 6 as h from (select distinct conv_id from turns)),
parts as (
  select c.conv_id, 0 as part, k, d, chars from convs c join placed p on p.conv_id = c.base and k <= h
  union all select c.conv_id, 1, k, d, chars from convs c join placed p on p.conv_id = c.conv_id and k > h),
paths as (
  select conv_id, chars, row_number() over w as depth, string_agg(d, '') over (partition by conv_id order by part, k rows unbounded preceding) as path
  from parts window w as (partition by conv_id order by part, k)),
members as (select conv_id, 0 as depth, '' as path, 0 as chars from convs union all select conv_id, depth, path, chars from paths),
lasts as (select conv_id, max(depth) as depth, arg_max(path, depth) as path from members group by conv_id),
nodes as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars from members group by depth, path),
up as (select *, substr(path, 1, 32 * (depth - 1)) as above from nodes where depth > 0),
children as (select above as path, count(*) as n_children from up group by above),
ended as (select path, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as sha from lasts group by path),
below as (
  select substr(path, 1, 32 * a) as path, sum(leaf) as n_leaves, sum(saved) as saved_tokens
  from (select n.path, (c.path is null)::bigint as leaf, (n.n_convs - 1) * n.chars as saved, unnest(range(0, n.depth + 1)) as a from nodes n left join children c on c.path = n.path)
  group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, cast(b.n_leaves as bigint) as n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from nodes n left join nodes p on n.depth > 0 and p.path = substr(n.path, 1, 32 * (n.depth - 1)) left join children c on c.path = n.path left join ended e on e.path = n.path join below b on b.path = n.path
"""
