"""N-gram Jaccard join by MinHash trees with exact verification.

Two documents are linked if their sets of 5-word windows have a Jaccard similarity of 0.8 or more. A text of 1 to 4 words has one
window, all its words; a text without words (empty, blank or null) has none and no links.

1. Each text becomes a fingerprint of its window set and, for each tree, the hash of a prefix of its MinHash label. Documents
   with equal sets are one class: copies meet in an aggregation and never as pairs.
2. Classes that share a tree's prefix are candidates, kept as stars of a prefix group, never as its pairs. The prefix is the longest that the recall law allows at the
   threshold. A forest would start longer and shorten where the estimate asks for it; at the recall that whole results need, every
   prefix has to be shortened to this depth, so labels are not made any longer.
3. Candidates that hang together are laid out in blocks, those of one prefix group side by side; a task verifies one pair of blocks exactly, and blocks that
   share no prefix group don't meet. A large group has SPREAD blocks, so each of its texts goes to SPREAD tasks however many there are; only blocks
   of more than BLOCK_BYTES are parted further. A task compares tiles, so its memory is that of two blocks.
4. A verified block pair gives each class its number of links and a spanning forest; components of the forests are the groups.

Only the candidates' texts move: a bitmap picks them where they lie. Spent tables are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.slots import running_sum
from .common import Words, as_bytes, byte_table, cut, free, join_hot, mix, numbered, sieve, sift, slices, small_batches
from .components import components

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Trees, and the longest prefix of a label.
TREES, DEPTH = 20, 8
#: Classes in a block at least, blocks of a large group, and bytes of a block's texts, about.
BLOCK, SPREAD, BLOCK_BYTES = 128, 12, 16 << 20
#: Classes on each side that are compared at once.
TILE = 512
_TABLE = byte_table()
_NONE = -(2**63)


def chance(similarity, depth: int, trees: int = TREES):
    """The chance that two sets of this similarity share a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def depth_for(similarity: float, recall: float) -> int:
    """The longest prefix that has the target recall at the threshold."""
    return next((d for d in range(DEPTH, 1, -1) if chance(similarity, d) >= recall), 1)


_SALTS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def label(windows: np.ndarray, depth: int) -> np.ndarray:
    """TREES x depth MinHash values of a set of window hashes."""
    salts, out = _SALTS[: TREES * depth], np.full(TREES * depth, 0xFFFFFFFF, np.uint32)
    high, low = (windows >> np.uint64(32)).astype(np.uint32), windows.astype(np.uint32)
    for a in range(0, len(windows), 4096):
        h, w = high[a : a + 4096, None], low[a : a + 4096, None]
        x = (w ^ salts.astype(np.uint32)) * ((salts >> np.uint64(32)).astype(np.uint32) | np.uint32(1)) + h
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out = np.minimum(out, x.min(axis=0))
    return out.reshape(TREES, depth)


def prefixes(labels: np.ndarray) -> np.ndarray:
    """One number for each tree's label; labels: ... x TREES x depth."""
    x = np.arange(TREES, dtype=np.uint64) + np.zeros(labels.shape[:-1], np.uint64)
    for j in range(labels.shape[-1]):
        x = mix(x * np.uint64(0xD6E8FEB86659FD93) + labels[..., j].astype(np.uint64))
    return x


def _signatures(depth: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text_key, text -> doc_id, text_key, bytes, cls and prefixes (null: no windows)."""
        for batch in batches:
            texts = as_bytes(batch.column(2))
            cls, at = [None] * len(texts), [None] * len(texts)
            for a, b in slices(texts):
                h, doc = Words(texts[a:b], _TABLE).shingles(WORDS)
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                for i in range(b - a):
                    if ends[i] < ends[i + 1]:
                        s = np.unique(h[ends[i] : ends[i + 1]])
                        both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(7))) + np.uint64(len(s))])
                        cls[a + i] = int(mix(both[:1] ^ mix(both[1:]))[0].view(np.int64))
                        at[a + i] = prefixes(label(s, depth)).view(np.int64)
            cols = [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(cls, pa.int64()), pa.array(at, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "bytes", "cls", "prefixes"])

    return signatures


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many windows each set of ``left`` shares with each of ``right``."""
    flat, other = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(flat, other)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets, x in ((left, flat), (right, other)):
        at = np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0))
        hit = both[at] == x if len(both) else np.zeros(len(x), bool)
        owner, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        sides.append((len(sets), owner[order], at[order]))
    for a in range(0, len(both), 4096):
        part = []
        for n, owner, at in sides:
            lo, hi = np.searchsorted(at, [a, a + 4096])
            x = np.zeros((n, min(4096, len(both) - a)), np.float32)
            x[owner[lo:hi], at[lo:hi] - a] = 1
            part.append(x)
        out += part[0] @ part[1].T
    return out


def _verify_rows(n: np.ndarray, side: np.ndarray, texts: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a task: links, weighted with class sizes ``n``, and the first of its linked classes. side 2: both blocks are one."""
    sets: list[np.ndarray] = []
    for a, b in slices(texts):
        h, doc = Words(texts[a:b], _TABLE).shingles(WORDS)
        ends = np.searchsorted(doc, np.arange(b - a + 1))
        sets += [np.unique(h[ends[i] : ends[i + 1]]) for i in range(b - a)]
    size = np.array([len(s) for s in sets], np.int64)
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # by size, so that most tiles of sets too different in size are left out
    order = np.argsort(size, kind="stable")
    one = bool((side == 2).all())
    sides = [order, order] if one else [order[side[order] == 0], order[side[order] == 1]]
    tiles = [[x[a : a + TILE] for a in range(0, len(x), TILE)] for x in sides]
    for k, left in enumerate(tiles[0]):
        for right in tiles[1][k if one else 0 :]:
            if size[left[-1]] < similarity * size[right[0]] - 1e-9 or size[right[-1]] < similarity * size[left[0]] - 1e-9:
                continue
            common = _common([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
            linked = common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-9
            if one and left is right or one and left[0] == right[0]:
                np.fill_diagonal(linked, False)
                links[left] += linked @ n[right]
            else:
                links[left] += linked @ n[right]
                links[right] += linked.T @ n[left]
            # a spanning forest: each left class with its first link, and each right class with its first
            rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            edges = np.concatenate([np.stack([left[rows], right[linked[rows].argmax(axis=1)]]), np.stack([right[cols], left[linked[:, cols].argmax(axis=0)]])], axis=1)
            while True:  # stars of the first links may still lie apart: links between different roots join them
                for x, y in edges.T.tolist():
                    a, b = find(x), find(y)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                own = np.array([find(i) for i in left]), np.array([find(i) for i in right])
                apart = linked & (own[0][:, None] != own[1][None, :])
                rows = np.flatnonzero(apart.any(axis=1))
                if not len(rows):
                    break
                edges = np.stack([left[rows], right[apart[rows].argmax(axis=1)]])
    return links, np.array([find(i) for i in range(len(sets))], np.int64)


def _verify(similarity: float):
    """Rows sorted by task; a task's rows are neighbours in a partition."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows):
            cls = np.array([r[1] for r in rows], np.int64)
            links, root = _verify_rows(np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows]), [r[4] for r in rows], similarity)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cls, links, cls[root])], names=["cls", "links", "root"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for r in zip(*cols, as_bytes(batch.column(4)), strict=True):
                if held and held[0][0] != r[0]:
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    return verify


def _blocks(nodes: DataFrame, block: int, spread: int, block_bytes: int) -> DataFrame:
    """cls, root, j (its block) and many (whether its component has several) of each candidate. nodes: node, root, near and bytes."""
    placed = cut(numbered(nodes, [], ["root", "near", "node"], "_i"))
    first = cut(placed.groupBy("root").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_all")))
    # a block ends after so many classes, or where the texts so far pass another block_bytes: a long text costs a block more, however long it is
    summed = running_sum(placed, ["root"], F.floor(F.col("_i") / 256), [F.col("_i")], _upto=F.col("bytes"))
    rows = F.greatest(F.lit(block), F.ceil(F.col("_n") / spread))
    j = F.floor((F.col("_i") - F.col("_first")) / rows) + F.floor((F.col("_upto") - F.col("bytes")) / block_bytes)
    many = (F.col("_n") > rows) | (F.col("_all") > block_bytes)
    at = cut(summed.join(first, "root").select(F.col("node").alias("cls"), "root", j.alias("j"), many.alias("many")))
    free(placed, first)
    return at


def _tasks(at: DataFrame, shared: DataFrame) -> DataFrame:
    """task, side, cls and part: the block pairs to verify, dealt to partitions in turn by size."""
    many = at.filter("many")
    meets = cut(many.join(shared, "cls").select("bucket", "root", "j").distinct())
    pairs = cut(meets.join(meets.select("bucket", "root", F.col("j").alias("k")), ["bucket", "root"]).filter("j < k").select("root", "j", "k").distinct())
    task = F.xxhash64("root", "j", "k")
    same = at.select(F.xxhash64("root", "j", "j").alias("task"), F.lit(2).alias("side"), "cls")
    left = many.join(pairs, ["root", "j"]).select(task.alias("task"), F.lit(0).alias("side"), "cls")
    right = many.withColumnRenamed("j", "k").join(pairs, ["root", "k"]).select(task.alias("task"), F.lit(1).alias("side"), "cls")
    rows = cut(same.unionByName(left).unionByName(right))
    sizes = numbered(rows.groupBy("task").agg(F.count(F.lit(1)).alias("_size")), [], ["_size", "task"], "part")
    out = cut(rows.join(sizes.drop("_size"), "task"))
    free(meets, pairs, rows)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a key for each row: _d and _k."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("_d"), F.xxhash64("text").alias("_k"), F.coalesce("text", F.lit("")).alias("text"))


def link_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, spread: int = SPREAD, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables. Of each row of ``docs`` (doc_id, text): doc_id, text_key (xxhash64 of the text), bytes and cls, null for texts without words.

    Of each class: cls, group, n (rows), links (with rows of other classes), least_id (the least doc_id) and at (key of the row that stands for it).
    cls is equal for equal window sets, group for classes that links connect.
    """
    small_batches(docs.sparkSession)
    depth = depth_for(similarity, recall)
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = cut(signed.mapInArrow(_signatures(depth), "doc_id long, text_key long, bytes long, cls long, prefixes array<long>"))
    key = F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("d"), "text_key", "bytes")
    classes = cut(signed.filter("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id"), F.min(key).alias("at"), F.first("prefixes").alias("prefixes")))
    rows = classes.select("cls", F.explode("prefixes").alias("bucket"))
    heads = cut(rows.groupBy("bucket").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    shared = cut(sieve(rows, ["bucket"], heads.select("bucket")).join(heads, "bucket"))
    parts = components(shared.select(F.col("cls").alias("u"), F.col("head").alias("v")))
    near = shared.groupBy("cls").agg(F.min("bucket").alias("near"))
    nodes = parts.join(near.withColumnRenamed("cls", "node"), "node").join(classes.select(F.col("cls").alias("node"), F.col("at.bytes").alias("bytes")), "node")
    at = _blocks(nodes, block, spread, block_bytes)
    tasks = _tasks(at, shared.select("cls", "bucket"))
    wanted = cut(tasks.join(classes.select("cls", "n", F.col("at.d").alias("_d"), F.col("at.text_key").alias("_k")), "cls"))
    texts = sieve(_keyed(docs), ["_d", "_k"], wanted.select("_d", "_k").distinct()).dropDuplicates(["_d", "_k"])
    checked = wanted.join(texts, ["_d", "_k"]).select("task", "cls", "n", "side", "text", "part")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checked = checked.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).drop("part").sortWithinPartitions("task")
    verified = cut(checked.mapInArrow(_verify(similarity), "cls long, links long, root long"))
    groups = components(verified.filter("root <> cls").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    per = classes.drop("prefixes").join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    per = cut(per.select("cls", F.coalesce("root", "cls").alias("group"), "n", F.coalesce("links", F.lit(0)).alias("links"), "least_id", "at"))
    free(classes, heads, shared, parts, at, tasks, wanted, verified, groups)
    return signed.drop("prefixes"), per


def near_duplicate_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links of each row of ``docs`` (doc_id, text): class_id is the least doc_id of the documents connected by links; a document without links is its own class.

    n_links counts the other rows linked to a row, copies included; repeated rows are copies. Columns beyond doc_id and text aren't read.
    """
    rows, classes = link_classes(docs, **options)
    least = cut(classes.groupBy("group").agg(F.min("least_id").alias("class_id")))
    per = cut(classes.join(least, "group").select("cls", "class_id", (F.col("n") - 1 + F.col("links")).alias("n_links")))
    free(classes, least)
    return join_hot(rows, "cls", per).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each connected group, the row with the least doc_id stays (null last).

    Documents without words have no links and stay, but for repeated rows: rows equal in doc_id and text are one. Only rows that may
    go, or that are repeated, move.
    """
    rows, classes = link_classes(docs, **options)
    last = lambda d: F.when(d == _NONE, F.lit(2**63 - 1)).otherwise(d)
    own = cut(rows.select(F.coalesce("doc_id", F.lit(_NONE)).alias("_d"), F.col("text_key").alias("_k"), "cls"))
    first = own.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(last(F.col("_d")).alias("o"), "_d", "_k")).alias("at"))
    first = cut(first.join(classes.select("cls", "group"), "cls"))
    stays = cut(first.groupBy("group").agg(F.min("at").alias("at")).select(F.col("at._d").alias("_d"), F.col("at._k").alias("_k")))
    gone = own.filter("cls is not null").select("_d", "_k").distinct().join(stays, ["_d", "_k"], "left_anti")
    again = own.groupBy("_d", "_k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_d", "_k")
    touched = cut(gone.withColumn("_gone", F.lit(True)).unionByName(again.withColumn("_gone", F.lit(False))).groupBy("_d", "_k").agg(F.max("_gone").alias("_gone")))
    free(own, first, stays, classes)
    key = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)), "_k": F.xxhash64("text")}
    marked = sift(docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(k) for k, c in key.items()]), ["_d", "_k"], touched, "_may")
    moved = marked.filter("_may").join(touched, ["_d", "_k"], "left").filter("not coalesce(_gone, false)")
    once = moved.filter("_gone is not null").dropDuplicates(["_d", "_k"])
    return marked.filter("not _may").select("_row.*").unionByName(moved.filter("_gone is null").select("_row.*")).unionByName(once.select("_row.*"))


def join_sql() -> str:
    """DuckDB SQL for near_duplicate_join over documents: all pairs that share a window, and reachability over links. For small tables."""
    return r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, g FROM (SELECT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k, b.k AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT p.k, p.j FROM p JOIN n x ON x.k = p.k JOIN n y ON y.k = p.j WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT k, k AS m FROM d UNION SELECT l.j AS k, r.m FROM r JOIN l ON l.k = r.k),
c AS (SELECT r.k, min(e.doc_id) AS class_id FROM r JOIN d e ON e.k = r.m GROUP BY r.k)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.k = d.k) AS n_links FROM d JOIN c ON c.k = d.k
"""
