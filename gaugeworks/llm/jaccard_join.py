"""Operator 6: exact n-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles (64-bit hashes; a set is known by a 128-bit digest). Documents with
equal sets are one node. The steps:

1. Order of tokens. Any order that all documents share keeps the join exact; rare ones first keeps it cheap. Each
   batch reports the tokens that several of its documents hold; the most frequent (a fixed number) go last.
2. Prefixes. Sets of similarity t share a token of their first n - ceil(t n) + 1 tokens. Prefix tokens of a single
   node are dropped, by a bitmap of bounded size first and by a join after it.
3. Grouping. In the list of each token the node whose prefix is shared most is the hub; documents are verified
   against their hubs, and what links with a hub is its group.
4. The matrix (token, group) holds each group's union of prefix tokens, with the range of its sizes. Documents of the
   smaller group query the larger; the tokens shared with the union bound the overlap with any member.
5. Only groups that qualify are opened, in blocks of bounded size: a block of members meets a block of queries, and
   one link for each query and block is reported, as the group is one component already.

The links' components end the work. No step makes all pairs of a group of copies: copies meet their hub only. Sets are
compared by 64-bit hashes of shingles, and known by 128-bit digests; that no two of them collide is taken for granted.

Nulls and texts without words have the empty set, link with nothing and are their own component. Rows that repeat a
text are copies of one another; rows that repeat an id with other texts are not. A null id stays null; it has the
component of its set. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import components
from gaugeworks.llm.shared import bitmap, in_bitmap, join_hot, lower_ascii, mix, saved, slices, span_hashes, text_bytes, word_spans

#: Tokens known as frequent, and how often they were seen at least; sets in a block of members or queries, and about the most tokens of its sets.
FREQUENT, LEAST_SEEN, BLOCK, TOKENS = 1 << 17, 4, 64, 1 << 18
#: Tokens of the blocks that one call of the verification holds, about.
HELD = 1 << 21


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    data, off = text_bytes(column)
    data = lower_ascii(data)
    start, end, row = word_spans(data, off)
    h = span_hashes(data, start, end)
    factors = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, words + 1)]
    n = max(0, len(h) - words + 1)
    joined = np.zeros(n, np.uint64)
    for k, f in enumerate(factors):
        joined += mix(h[k : k + n] ^ f) * f
    joined = mix(joined)
    to = np.searchsorted(row, np.arange(len(column) + 1))
    out = []
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(joined[a : b - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            s = np.zeros(min(1, b - a), np.uint64)
            for k in range(b - a):
                s += mix(h[a + k : a + k + 1] ^ factors[k]) * factors[k]
            out.append(mix(s + np.uint64(b - a)))
    return out


def node_of(s: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted set."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    return np.array([mix(s + place).sum(dtype=np.uint64), mix(s * np.uint64(0xD6E8FEB86659FD93) ^ place).sum(dtype=np.uint64)], np.uint64).tobytes()


def least(n: int, t: int) -> int:
    return -(-t * n // 100)


def prefix(s: np.ndarray, t: int, tokens: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first tokens of a set: rare ones by hash, then frequent ones by how often they were seen and by hash."""
    p = len(s) - least(len(s), t) + 1
    if not len(tokens):
        return s[:p]
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    common = tokens[at] == s
    rare = s[~common]
    if len(rare) >= p:
        return rare[:p]
    often, by = s[common], seen[at[common]]
    return np.concatenate([rare, often[np.argsort(by, kind="stable")]])[:p]


def _over(docs: DataFrame, make: Callable[[], Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch]], schema: str, words: int) -> DataFrame:
    """make() gives a task's function of (ids, sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for part in slices(batch, "text"):
                yield of(part.column(0), shingle_sets(part.column(1), words))

    return docs.mapInArrow(run, schema)


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and how often they were seen. A token in more documents than there are batches is always among those reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in slices(batch, "text", 8 << 20):
                sets = [s for part in slices(group, "text") for s in shingle_sets(part.column(1), words)]
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

    seen = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)
    top = seen.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()  # a fixed number of rows at most
    token, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _prefixes(docs: DataFrame, id_type: str, t: int, words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))

    def make():
        tokens, seen = shared.value

        def of(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            first = [prefix(s, t, tokens, seen) if len(s) else s for s in sets]
            off = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            flat = np.concatenate(first) if first else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int32()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))],
                names=["id", "n", "node", "prefix"],
            )

        return of

    return _over(docs, make, f"id {id_type}, n int, node binary, prefix array<long>", words)


def _shared_tokens(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens that the prefixes of two nodes or more hold, and the rows (token, node, n) of these tokens."""
    each = table.where("node is not null").select(F.xxhash64("node").alias("h"), F.explode("prefix").alias("token"))
    tokens = saved(each.groupBy("token").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("token"), "tokens")
    found = table.sparkSession.sparkContext.broadcast(bitmap(tokens, "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = found.value
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            token = lists.values.to_numpy()[off[0] : off[-1]]
            keep = np.flatnonzero(in_bitmap(known, token.view(np.uint64)))
            at = pa.array(np.searchsorted(off - off[0], keep, "right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column(0).take(at), batch.column(1).take(at)], names=["token", "node", "n"])

    rows = table.where("node is not null").select("node", "n", "prefix").mapInArrow(run, "token long, node binary, n int")
    return tokens, saved(rows.join(tokens, "token", "left_semi").distinct(), "lists")


def _suffix(n: Column, t: int) -> Column:
    return F.ceil(n * t / 100) - 1


def _need(n: Column, m: Column, t: int) -> Column:
    """The overlap that sets of n and m tokens need."""
    return F.ceil((n + m) * t / (100 + t))


def _half(node: Column) -> Column:
    """Seven bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(node, 2, 7)), 16, 10).cast("long")


def _halves(nodes: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(x[1:8], "big") for x in nodes], np.uint64)


def _verified(docs: DataFrame, asked: DataFrame, members: DataFrame, t: int, words: int) -> DataFrame:
    """Links (a, b) between queries and members of the groups they ask: one for each query and block of members.

    asked: (node, n, g), members: (node, n, g).
    """
    wanted = saved(asked.select("node").union(members.select("node")).distinct(), "wanted")
    found = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(_half(F.col("node")).alias("h")), "h"))

    def make():
        known, had = found.value, set()

        def of(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            nodes = [node_of(s) if len(s) else b"" for s in sets]
            keep = []
            for i in np.flatnonzero(in_bitmap(known, _halves(nodes))).tolist():
                if nodes[i] and nodes[i] not in had:
                    keep.append(i)
                    had.add(nodes[i])
            if len(had) > 200_000:
                had.clear()
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "tokens"])

        return of

    sets = _over(docs, make, "node binary, tokens binary", words).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))
    sets = saved(sets, "sets")
    cut = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).cast("int")
    of_group = saved(members.groupBy("g").agg(cut.alias("blocks")).join(asked.groupBy("g").agg(cut.alias("parts")), "g"), "blocks")
    inner = join_hot(members, of_group, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    outer = join_hot(asked, of_group, "g").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Blocks are small, so many of them (by the hash of what names them) are verified in one call.
    inner, outer = (x.select(F.xxhash64("g", "block", "part").alias("cell"), "node", "n") for x in (inner, outer))
    held = inner.select("n").union(outer.select("n")).agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod("cell", F.lit(-(-held // HELD) or 1)).cast("int").alias("bucket")
    names = ["bucket", "cell", "node", "n", "tokens"]
    inner, outer = (x.join(sets, "node").select(bucket, *names[1:]).toDF(*[f"{side}_{c}" for c in names]) for side, x in (("in", inner), ("out", outer)))

    def verify(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_cell = [x.groupby(f"{side}_cell").indices for side, x in (("in", members), ("out", queries))]
        m, n = members["in_n"].to_numpy(), queries["out_n"].to_numpy()
        m_node, n_node = members["in_node"].tolist(), queries["out_node"].tolist()
        m_set, n_set = ([np.frombuffer(s, np.uint64) for s in x] for x in (members["in_tokens"], queries["out_tokens"]))
        for cell in by_cell[0].keys() & by_cell[1].keys():
            rows, asks = by_cell[0][cell], by_cell[1][cell].tolist()
            out += [(n_node[q], m_node[rows[i]]) for q, i in block_links([m_set[i] for i in rows], m[rows], [m_node[i] for i in rows], [(q, n[q], n_node[q], n_set[q]) for q in asks], t)]
        return pd.DataFrame(out, columns=["a", "b"])

    return inner.groupBy("in_bucket").cogroup(outer.groupBy("out_bucket")).applyInPandas(verify, "a binary, b binary")


def block_links(sets: list[np.ndarray], m: np.ndarray, nodes: list[bytes], queries: list[tuple], t: int) -> list[tuple[int, int]]:
    """For each of the queries (number, size, node, set) that links with one of the sets: its number and one such set."""
    if len(sets) == 1:  # of one set and few queries, no index is made
        fits = [x for x in queries if x[2] != nodes[0] and 100 * min(x[1], m[0]) >= t * max(x[1], m[0])]
        both = [len(np.intersect1d(sets[0], s, assume_unique=True)) for _, _, _, s in fits]
        return [(q, 0) for (q, n, _, _), k in zip(fits, both, strict=True) if 100 * k >= t * (n + m[0] - k)]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    token, start = flat[start], np.append(start, len(flat))
    out = []
    for q, n, node, s in queries:
        fits = (100 * np.minimum(n, m) >= t * np.maximum(n, m)) & np.array([x != node for x in nodes], bool)
        if fits.any():
            at = np.searchsorted(token, s)
            at = at[token[np.minimum(at, len(token) - 1)] == s]
            size = start[at + 1] - start[at]
            to = np.cumsum(size)
            both = np.bincount(owner[np.arange(size.sum()) + np.repeat(start[at] - (to - size), size)], minlength=len(m))
            linked = np.flatnonzero(fits & (100 * both >= t * (n + m - both)))
            if len(linked):
                out.append((q, int(linked[0])))
    return out


def jaccard_components(docs: DataFrame, t: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of docs. t: percent of similarity that links."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = saved(_prefixes(docs, docs.schema["id"].dataType.simpleString(), t, words), "prefixes")
    _, lists = _shared_tokens(table)

    n, p = F.col("n"), F.col("n") - F.ceil(F.col("n") * t / 100) + 1
    # The largest size that a node may link with, by its own tokens that no other prefix holds: a bound for a pair if
    # this node's prefix ends first in the order of tokens, so one of a pair's two bounds holds.
    cap = F.floor(((100 + t) * (n - (p - F.col("shared"))) - t * n) / t)
    nodes = saved(lists.groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("shared")).withColumn("cap", cap).withColumn("rank", F.col("shared") / p), "nodes")
    rows = lists.select("token", "node").join(nodes, "node")

    hubs = rows.groupBy("token").agg(F.max(F.struct("rank", "node", "n", "cap")).alias("hub"))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * t) & ((F.col("m") <= F.col("cap")) | (F.col("n") <= F.col("hub_cap")))
    to_hub = (
        rows.join(hubs.select("token", F.col("hub.node").alias("g"), F.col("hub.n").alias("m"), F.col("hub.cap").alias("hub_cap")), "token").where((F.col("node") != F.col("g")) & fits)
        .groupBy("node", "g").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("both"))
        .where(F.col("both") + F.greatest(_suffix(n, t), _suffix(F.col("m"), t)) >= _need(n, F.col("m"), t))
    )
    to_hub = saved(to_hub, "to-hub")
    hub_of = saved(to_hub.select(F.col("g").alias("node"), F.col("m").alias("n"), "g").distinct(), "hubs")
    first = saved(_verified(docs, to_hub.select("node", "n", "g"), hub_of, t, words), "hub-links")

    groups = components(first)
    grouped = saved(nodes.join(groups, "node", "left").select("node", "n", "cap", F.coalesce("root", "node").alias("g")), "grouped")
    size = saved(grouped.groupBy("g").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("cap").alias("g_cap")), "group-sizes")
    placed = saved(lists.select("token", "node").join(join_hot(grouped, size, "g"), "node"), "placed")
    matrix = placed.select("token", F.col("g").alias("other"), F.col("size").alias("o_size"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.col("g_cap").alias("o_cap")).distinct()
    low, high = F.greatest(F.ceil(n * t / 100), F.col("o_low")), F.least(F.floor(n * 100 / t), F.col("o_high"))
    asks = (F.col("g") != F.col("other")) & (F.struct("size", "g") < F.struct("o_size", "other")) & (low <= high) & ((F.col("o_low") <= F.col("cap")) | (n <= F.col("o_cap")))
    asked = (
        placed.join(matrix, "token").where(asks).groupBy("node", "other").agg(F.first("n").alias("n"), F.first("o_low").alias("o_low"), F.first("o_high").alias("o_high"), F.count("*").alias("both"))
        .where(F.col("both") + F.greatest(_suffix(n, t), _suffix(high, t)) >= _need(n, low, t))
        .select("node", "n", F.col("other").alias("g"))
    )
    asked = saved(asked, "asked")
    members = saved(join_hot(grouped.select("node", "n", "g"), asked.select("g").distinct(), "g"), "members")
    second = saved(_verified(docs, asked, members, t, words), "group-links")

    roots = components(first.union(second).select("a", "b"))
    # Copies are counted as one before anything is joined by their set or their component.
    each = table.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    each = saved(each.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "node-roots")
    smallest = saved(each.groupBy("root").agg(F.min("least").alias("smallest")), "smallest")
    label = saved(join_hot(each, smallest, "root").select("node", "smallest"), "node-labels")
    out = join_hot(table.where("node is not null").select("id", "n", "node"), label, "node").select("id", "n", "smallest")
    out = out.unionByName(table.where("node is null").select("id", "n", F.col("id").alias("smallest")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("smallest").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component: that with the smallest id (a null id is the largest), and of rows that repeat it in the component the smallest digest of the text."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("md5"), F.col(text_col).isNull().alias("no_text"))
    found = jaccard_components(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), id_col="_key", text_col="_text", **options)
    kept = found.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    return docs.withColumn(name, key).join(kept.withColumnRenamed("_key", name), name, "left_semi").dropDuplicates([name]).drop(name)


def sql() -> str:
    """All pairs that share a shingle, their links, and what is reachable by them; for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id"""
