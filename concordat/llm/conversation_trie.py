"""Operator 12: a prefix trie of conversations, built level by level.

The conversations' turns are put in order once, by a range partitioning over (conversation, turn, role, text) in which a
conversation may cover many partitions, and kept as digests with word counts. Then, for each depth, the turns at that depth
of the live conversations are grouped by (parent node, turn); a group is a node, named by its least conv_id. A conversation
stays live while its node has other members; one that is alone in its node can't branch any more, so the rest of it is a
chain of nodes that needs no further level. After the last level the levels are joined in reverse: a node takes the number
of its children, their leaves and their savings, summed by parent. So there are as many levels as the longest sequence that
two conversations share has turns, and one more.

Groupings combine before they shuffle. Of the nodes of a level, those with more than a thousandth of its conversations (a
thousand at most) go back to their members by broadcast, all others by a shuffled join, so no hot node meets in one task.
Ids of conversations that end in a node are sorted by Spark in ranges; what a range holds of a node is joined to text in
runs of ids, and only those runs pass, in order, through the task that digests a node which covers several ranges.

Two turns with the same SHA-256 (of role and text with their lengths) count as the same turn; no two different texts with
the same one are known.

Edge cases: null turns come first, then by number, equal ones by role and text. Null roles and texts are empty. Rows
without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A table without
conversations has no root, so no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import drop_tables, shared_dir, written

BLOCK, CYCLE = 20, 4  # conversation c takes its first crc32(c) % CYCLE turns from the first of its block of BLOCK
HOT_SHARE, RUN = 1000, 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
LEVEL = "conv_id bigint, parent bigint, digest binary, words bigint, n_convs bigint, len bigint"
MEMBER = "conv_id bigint, len bigint, node bigint, n_convs bigint"
ROLLED = "conv_id bigint, parent bigint, digest binary, n_convs bigint, len bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (none null) and the turn's digest, of every row with a conv_id."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(digest, role, text) of each distinct turn, to look up the turns of nodes."""
    return digested(conversations).groupBy("digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, words) of every row with a conv_id, in the order of turns."""
    # partitions are whole ranges of the order, so the running id of a written row is its place but for where it starts
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ranged = digested(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.regexp_count("text", F.lit(WORDS)).cast("bigint").alias("words")
    at = written(ranged.select("conv_id", "digest", words, F.monotonically_increasing_id().alias("at")), "turns")
    at = at.withColumn("part", F.shiftright("at", 33))
    # a conversation has a row here for each partition that it covers
    pieces = at.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return at.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "digest", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations as (conv_id, place, digest, words), and (conv_id, len) of all of them, also turnless ones."""
    turns = written(ordered_turns(conversations), "ordered")
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % CYCLE).alias("h"))
    heads = sizes.where(f"conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(heads, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    convs = written(convs.select("*", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    first = turns.where(f"conv_id % {BLOCK} = 0 AND place < {CYCLE}").withColumnRenamed("conv_id", "base")
    head = first.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("place <= taken")
    columns = ["conv_id", "place", "digest", "words"]
    return own.select(columns).unionByName(head.select(columns)), convs.select("conv_id", "len")


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"ids": pa.string(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(c, pa.int64())) for k, c in enumerate(names.split())], names.split())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a range of sorted (depth, node, conv_id) the digests of the nodes within it, and runs of the ids of nodes that
    may lie in other ranges too: the first, the last and those with many ids."""
    names, rows = "depth node first ids ends_sha256", []
    key, held, as_runs = None, [], True

    def close() -> None:
        text = ",".join(map(str, held))
        rows.append((*key, held[0], text, None) if as_runs else (*key, None, None, hashlib.sha256(text.encode()).hexdigest()))

    for b in batches:
        for depth, node, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (depth, node) != key:
                if key is not None:
                    close()
                    as_runs = False
                key, held = (depth, node), []
            elif len(held) == RUN:
                as_runs = True
                close()
                held = []
            held.append(c)
            if len(rows) >= 1000 or (rows and len(rows[-1][3] or "") > RUN):
                yield _batch(names, rows)
                rows = []
    if key is not None:
        as_runs = True
        close()
    if rows:
        yield _batch(names, rows)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (depth, node, first id) to one digest per node, a run at a time."""
    names, rows, key, sha = "depth node ends_sha256", [], None, None
    for b in batches:
        for depth, node, ids in zip(*(b.column(c) for c in ("depth", "node", "ids")), strict=True):
            if (depth.as_py(), node.as_py()) == key:
                sha.update(b",")
            else:
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (depth.as_py(), node.as_py()), hashlib.sha256()
            sha.update(ids.as_py().encode())
        if len(rows) >= 1000:
            yield _batch(names, rows)
            rows = []
    if key is not None:
        yield _batch(names, [*rows, (*key, sha.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, SHA-256 of the comma-joined ascending ids) from (depth, node, conv_id)."""
    order = ["depth", "node", "conv_id"]
    runs = ends.select([F.col(c).cast("bigint") for c in order]).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = written(runs.mapInArrow(_runs, "depth bigint, node bigint, first bigint, ids string, ends_sha256 string"), "ends")
    open_ = runs.where("ids IS NOT NULL").repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return runs.where("ids IS NULL").select("depth", "node", "ends_sha256").union(open_.mapInArrow(_streamed, "depth bigint, node bigint, ends_sha256 string"))


def _named(here: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``here`` (members with parent and digest) with their node: large nodes by broadcast, the others by a shuffled join."""
    keys, found = ["parent", "digest"], ["conv_id", "len", "node", "n_convs"]
    nodes = nodes.select(*keys, F.col("conv_id").alias("node"), "n_convs")
    large = nodes.where(F.col("n_convs") * HOT_SHARE > n).withColumnsRenamed({"node": "large", "n_convs": "large_n"})
    marked = here.join(F.broadcast(large), keys, "left")
    small = marked.where("large IS NULL").join(nodes.where(F.col("n_convs") * HOT_SHARE <= n), keys)
    hot = marked.where("large IS NOT NULL").withColumnsRenamed({"large": "node", "large_n": "n_convs"})
    return hot.select(found).union(small.select(found))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie, from rebuilt ``turns`` and ``convs``: conv_id, depth, parent_conv_id, digest (of the node's
    turn, null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    # by place, so that a level reads its own row groups only
    turns = written(turns.repartitionByRange("place", "conv_id").sortWithinPartitions("place", "conv_id"), "by-place")
    levels, members, rolled = (shared_dir(spark, x) for x in ("levels", "members", "rolled"))
    level = lambda d: spark.read.schema(LEVEL).parquet(f"{levels}/depth={d}")

    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("len")).where("n_convs > 0")
    root.selectExpr("conv_id", "cast(null AS bigint) AS parent", "cast(null AS binary) AS digest", "0L AS words", "n_convs", "len").write.parquet(f"{levels}/depth=0")
    first = level(0).first()
    depth, n = 0, first["n_convs"] if first else 0
    live = convs.select("conv_id", "len", F.lit(first["conv_id"] if first else None).cast("bigint").alias("node"), F.lit(n).cast("bigint").alias("n_convs"))
    live.where("len = 0").write.parquet(f"{members}/depth=0")
    while n:
        depth += 1
        here = live.where(f"len >= {depth}").select("conv_id", "len", F.col("node").alias("parent"))
        here = written(here.join(turns.where(f"place = {depth}").select("conv_id", "digest", "words"), "conv_id"), "here")
        nodes = here.groupBy("parent", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("len").alias("len"))
        nodes.select("conv_id", "parent", "digest", "words", "n_convs", "len").write.parquet(f"{levels}/depth={depth}")
        _named(here, level(depth), n).where("n_convs > 1").write.parquet(f"{members}/depth={depth}")
        drop_tables(spark, [here])
        live = spark.read.schema(MEMBER).parquet(f"{members}/depth={depth}")
        n = live.count()

    for d in range(depth, -1, -1):
        mine = level(d)
        if d < depth:
            below = spark.read.schema(ROLLED).parquet(f"{rolled}/depth={d + 1}").groupBy(F.col("parent").alias("conv_id"))
            mine = mine.join(below.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")), "conv_id", "left")
        else:
            mine = mine.selectExpr("*", "cast(null AS bigint) AS n_children", "cast(null AS bigint) AS n_leaves", "cast(null AS bigint) AS below")
        # a node of one conversation may have no level below it: its chain of single nodes ends in one leaf and saves nothing
        chain = F.when((F.col("n_convs") == 1) & (F.col("len") > d), 1).otherwise(0)
        mine.select(
            "conv_id", "parent", "digest", "n_convs", "len",
            F.coalesce("n_children", chain).cast("bigint").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).cast("bigint").alias("saved_tokens"),
        ).write.parquet(f"{rolled}/depth={d}")

    nodes = spark.read.schema(ROLLED + ", depth int").parquet(rolled)
    ends = spark.read.schema(MEMBER + ", depth int").parquet(members).where("n_convs > 1 AND len = depth")
    digests = ends_digests(ends.select("depth", "node", "conv_id")).select(F.col("depth").cast("int").alias("depth"), F.col("node").alias("conv_id"), "ends_sha256")
    none, alone = F.lit(hashlib.sha256(b"").hexdigest()), F.sha2(F.col("conv_id").cast("string"), 256)
    many = nodes.where("n_convs > 1").join(digests, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    one = nodes.where("n_convs = 1").withColumn("ends_sha256", F.when(F.col("len") == F.col("depth"), alone).otherwise(none))
    # chains: the turns of a conversation after the depth from which it is alone (that of its only single node so far)
    since = nodes.where("n_convs = 1 AND len > depth AND depth > 0").select("conv_id", "len", F.col("depth").alias("since"))
    rest = turns.select("conv_id", "place", "digest").join(since, "conv_id").where("place > since")
    last = F.col("place") == F.col("len")
    chains = rest.select(
        "conv_id", F.col("place").alias("depth"), F.col("conv_id").alias("parent"), "digest", F.lit(1).alias("n_convs"), F.when(last, 0).otherwise(1).alias("n_children"),
        F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.when(last, alone).otherwise(none).alias("ends_sha256"),
    )
    whole = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "depth")] + [F.col("parent").alias("parent_conv_id"), "digest"]
    whole += [F.col(c).cast("bigint").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")] + ["ends_sha256"]
    return many.select(whole).union(one.select(whole)).union(chains.select(whole))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("digest")


_CRC = "list_reduce(list_prepend({x}, range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"
OP12_SQL = f"""WITH orig AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
lambda x, b: {_CRC.format(x="xor(x, b)")}), 4294967295::BIGINT) % {CYCLE} AS h FROM orig),
rebuilt AS (SELECT a.conv_id, coalesce(b.turns, [])[1:h::INTEGER] || a.turns[h::INTEGER + 1:] AS s FROM hashed a LEFT JOIN orig b ON b.conv_id = a.conv_id - a.conv_id % {BLOCK}),
paths AS (SELECT conv_id, len(s) AS n, d, s[1:d::INTEGER] AS path FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM paths GROUP BY path, d),
parents AS (SELECT n.*, p.conv_id AS parent_conv_id, p.path AS up FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:(n.d - 1)::INTEGER]),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS k FROM parents WHERE d > 0 GROUP BY d, up),
full_ AS (SELECT p.*, coalesce(k, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d::INTEGER].t, '[^\x20\x09-\x0D]+')) END AS saved
FROM parents p LEFT JOIN kids USING (d, path)),
sums AS (SELECT d, path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM (SELECT unnest(range(f.d + 1)) AS d, path[1:(unnest(range(f.d + 1)))::INTEGER] AS path, saved,
CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf FROM full_ f) GROUP BY d, path)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_ JOIN sums USING (d, path)"""
