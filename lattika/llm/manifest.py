"""A Merkle manifest of a table: one tree a source and one over the sources, and a proof for every row.

A node is the SHA-256 of its children's digests as hex text, three children a node, the last node of a level fewer. Trees are built from
the leaves up, a written table a level: rows (tree, place, nodes of the tree at this level, digest, the children's digests). Proofs are pushed from the root
down: a level joins its nodes to their parents' proofs, and each node puts its own siblings before what it inherits. A step of a
proof is what stands left and right of a node, so that a leaf folds up to the root with its proof alone.

Rows are placed by a distributed numbering, never in one task for a source; a node's children meet in an aggregation of three rows at most. Digests are binary
until they are hashed. A level is a third of the one below, so all levels together are half of the leaves.

Fields: ``-`` if null, else the bytes' count, ``:`` and the value, so no two rows are written alike. A null source is a source, the first one; null doc_ids come
last in their source. Rows that tie in source and doc_id are ordered by digest; equal rows have equal leaves and take neighbouring places, each with its own proof.
Empty texts are texts. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, numbered

#: Children of a node.
FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as it is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of texts put together, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def _hex_all(digests: Column) -> Column:
    """Hex text of an array of digests."""
    return F.array_join(F.transform(digests, _hex), "")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels over ``leaves`` (tree, place, n, digest), the first one being these; a tree's last level has one node, with n = 1."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].filter("n > 1")
        kids = F.array_sort(F.collect_list(F.struct("place", "digest")))
        up = below.groupBy("tree", F.floor(F.col("place") / FAN).cast("long").alias("place")).agg(F.first("n").alias("n"), kids.alias("_kids"))
        up = up.select("tree", "place", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("_kids.digest").alias("kids"))
        levels.append(cut(up.withColumn("digest", digest(_hex_all(F.col("kids"))))))
        most = -(-most // FAN)
    return levels


def _push(levels: list[DataFrame], top: DataFrame | None, heights: set[int]) -> DataFrame:
    """The leaves with their proofs; ``top`` (tree, proof, and what else every leaf of a tree takes over) has what each tree's last node inherits.

    Without it, there is one tree, whose last node inherits nothing. ``heights`` are the levels at which trees end. The leaves' kids are not looked at.
    """
    own = F.col("place") % FAN
    left = F.unhex(_hex_all(F.slice("_kids", 1, own.cast("int"))))
    right = F.unhex(_hex_all(F.slice("_kids", (own + 2).cast("int"), FAN)))
    step = F.struct(left.alias("left"), right.alias("right"))
    more = [c for c in top.columns if c not in ("tree", "proof")] if top else []
    inherited = None
    for k in range(len(levels) - 1, -1, -1):
        level, parts = levels[k], []
        if k in heights:
            ends = level.filter("n = 1")
            parts.append(ends.join(top, "tree") if top else ends.withColumn("proof", F.array().cast(_STEP)))  # a row a tree on either side
        if inherited is not None:
            parents = inherited.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("kids").alias("_kids"), F.col("proof").alias("_suffix"), *more)
            rows = level.filter("n > 1").join(parents, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("place") / FAN) == F.col("_place")))
            parts.append(rows.withColumn("proof", F.concat(F.array(step), "_suffix")))
        parts = [x.select(*level.columns, "proof", *more) for x in parts]
        inherited = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        inherited = cut(inherited) if k else inherited
    return inherited


def _heights(sizes: list[int]) -> set[int]:
    out = set()
    for n in sizes:
        h = 0
        while n > 1:
            n, h = -(-n // FAN), h + 1
        out.add(h)
    return out


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof and folded_root of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    proof is an array of steps (left, right: digests put together), from the leaf up. folded_root is folded from the row's leaf, or, where ``tampered``, a column of
    ``docs`` for another text, differs from the text, from the leaf that the row would then have. Digests are binary.
    """
    rest = [field(F.col(c)) for c in FIELDS[:-1]]
    leaf = digest(*rest, field(F.col("text")))
    seen = leaf if tampered is None else F.when(tampered.eqNullSafe(F.col("text")), None).otherwise(digest(*rest, field(tampered)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNotNull().alias("_has"), "source", leaf.alias("digest"), (F.lit(None).cast("binary") if tampered is None else seen).alias("seen"))
    rows = numbered(rows, [], ["_has", "source", "doc_id", "digest"], "_g").withColumn("_key", field(F.col("source")))
    trees = rows.groupBy("_key").agg(F.min("_g").alias("_low"), F.count(F.lit(1)).alias("n"))
    trees = cut(numbered(trees, [], ["_low"], "tree"))
    placed = join_hot(rows, "_key", trees)
    leaves = cut(placed.select("tree", (F.col("_g") - F.col("_low")).alias("place"), "n", "digest", "doc_id", "seen"))
    levels = _levels(leaves.select("tree", "place", "n", "digest"))
    # how high trees are: one number for each size up to the next power
    power = F.ceil(F.round(F.log(float(FAN), F.col("n").cast("double")), 9))
    bounds = trees.groupBy(power.alias("_h")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    heights, n_trees, roots = _heights([x for r in bounds for x in (r["low"], r["high"])]), sum(r["n"] for r in bounds), None
    for k in sorted(heights):
        ended = levels[k].filter("n = 1").select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
    if roots is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, leaf binary, subroot binary, root binary, proof {_STEP}, folded_root binary")
    roots = cut(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("n"), "digest"))
    over = _levels(roots)
    root = F.lit(bytes(over[-1].filter("n = 1").select("digest").first()["digest"]))
    subroots = cut(_push(over, None, {len(over) - 1}).select(F.col("place").alias("tree"), "proof", F.col("digest").alias("subroot")))
    levels[0] = leaves
    out = _push(levels, subroots, heights)
    folded = F.aggregate("proof", F.coalesce("seen", "digest"), lambda x, s: digest(_hex(s["left"]), _hex(x), _hex(s["right"])))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof", folded.alias("folded_root"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; rows whose doc_id has an even CRC-32 lose their line ends before they are folded."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(F.coalesce(even, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proof = F.array_join(F.transform("proof", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
    rows = manifest(docs, tampered)
    return rows.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), F.sha2(proof, 256).alias("proof_sha256"), _hex(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def digest_sql() -> str:
    """DuckDB SQL for manifest_digest over documents."""
    from .sharding import crc32_sql

    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))

    def up(name: str, base: str) -> str:
        return f"""
{name} AS (SELECT 0 AS h, tree, place, n, digest, [digest] AS kids FROM {base} UNION ALL
  SELECT h + 1, tree, place // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY place)), list(digest ORDER BY place) FROM {name} WHERE n > 1 GROUP BY h, tree, place // {FAN}, n)"""

    def down(name: str, nodes: str, top: str) -> str:
        return f"""
{name} AS (SELECT h, tree, place, kids, digest, proof, up, subroot FROM {nodes} JOIN {top} USING (tree) WHERE n = 1 UNION ALL
  SELECT c.h, c.tree, c.place, c.kids, c.digest, array_to_string(list_filter(p.kids, lambda x, i: i <> c.place % {FAN} + 1), '') || p.proof,
    list_prepend([array_to_string(p.kids[1:c.place % {FAN}], ''), array_to_string(p.kids[c.place % {FAN} + 2:], '')], p.up), p.subroot
  FROM {name} p JOIN {nodes} c ON c.h = p.h - 1 AND c.tree = p.tree AND c.place // {FAN} = p.place)"""

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({fields("text")}) AS digest, CASE WHEN ({crc32_sql("doc_id::VARCHAR")}) % 2 = 0 THEN sha256({fields("replace(text, chr(10), '')")}) END AS seen FROM documents),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, digest) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),{up("nodes", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),{up("above", "subroots")},
top AS (SELECT 0 AS tree, '' AS proof, []::VARCHAR[][] AS up, NULL::VARCHAR AS subroot),{down("reached", "above", "top")},
heads AS (SELECT place AS tree, proof, up, digest AS subroot FROM reached WHERE h = 0),{down("proved", "nodes", "heads")},
folded AS (SELECT l.doc_id, l.digest AS leaf, p.subroot, (SELECT digest FROM above WHERE n = 1) AS root, sha256(p.proof) AS proof_sha256,
  list_reduce(list_prepend(['', coalesce(l.seen, l.digest)], p.up), lambda x, s: ['', sha256(s[1] || x[2] || s[2])])[2] AS folded_root FROM leaves l JOIN proved p ON p.h = 0 AND p.tree = l.tree AND p.place = l.place)
SELECT *, folded_root = root AS verified FROM folded
"""
