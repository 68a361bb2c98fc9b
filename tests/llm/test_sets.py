"""Packing, importance resampling and the Merkle manifest against brute force, on edge rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattika.llm import manifest, packing, resampling

from .conftest import prose

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
BYTES = P.path("byte_bpe_50k.json")


# ---- packing --------------------------------------------------------------------------------------------------------


def test_units_give_the_librarys_ids():
    rnd, enc = random.Random(1), packing.ByteEncoder(BYTES)
    alphabet = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xe9", "\xa0", "\u2028", "\u3000", "\x1c", "\x85", "\u200b", "5", "\u0661", "!?", ".", "\U0001f600", "\u0301", "\xdf", "<|endoftext|>", "\x00"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(25))) for _ in range(3000)] + [prose(300, 3), "", " ", "x " * 5000]
    assert enc.by_unit
    for text, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def layout(plan, counts):
    """What each bin holds by the plan: (offset, length)."""
    bins, by = defaultdict(list), defaultdict(list)
    for length, *row in plan.tolist():
        by[length].append(row)
    for length, n in counts.items():
        for i in range(n):
            first, uses, at, offset = [r for r in by[length] if r[0] <= i][-1]
            bins[at + (i - first) // uses].append((offset + (i - first) % uses * length, length))
    return bins


def test_plan_fills_bins_without_gaps():
    rnd = random.Random(2)
    for _ in range(150):
        cap = rnd.choice([1, 5, 10, 64])
        counts = {i: rnd.randrange(20) for i in range(1, cap + 1) if rnd.random() < 0.5}
        plan, n = packing.plan_bins(counts, cap)
        bins = layout(plan, counts)
        assert sorted(bins) == list(range(n))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= cap
        # no two bins would fit into one
        fill = sorted(sum(x for _, x in held) for held in bins.values())
        assert len(fill) < 2 or fill[0] + fill[1] > cap


def test_two_pieces_take_the_place_of_the_smallest():
    # greedy: 6 + 3 leaves 1; 2 + 2 in place of 3 leaves none
    plan, n = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert n == 2 and [(0, 6), (6, 2), (8, 2)] in [sorted(x) for x in layout(plan, {6: 1, 3: 1, 2: 2}).values()]
    assert packing.plan_bins({}, 10)[1] == 0
    assert packing.plan_bins({5: 7, 10: 3}, 10)[1] == 7


def test_plan_is_close_to_the_bound_at_any_count():
    rnd = random.Random(3)
    counts = {i: rnd.randrange(1, 40) for i in range(1, 1025)}
    for times in (1, 1000):
        many = {i: n * times for i, n in counts.items()}
        plan, n = packing.plan_bins(many)
        assert n <= 1.01 * sum(i * k for i, k in many.items()) / 1024 + 1 and len(plan) < 30000


def test_packing(spark, edge, edge_rows, empty):
    enc = packing.ByteEncoder(BYTES)
    got = packing.pack_documents(edge, BYTES, 2, 64).collect()
    want = Counter()
    for r in edge_rows:
        ids = enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        at = 0
        for k in range(-(-len(ids) // 64)):
            n = len(ids) % 64 or 64 if k == 0 else 64
            want[r[0], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty, BYTES).count() == 0


def test_sequences_hold_the_ids(spark, edge):
    pieces = packing.token_pieces(edge, BYTES, 2, 64).cache()
    packed = packing.pack(pieces, 64).cache()
    rows = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.length for r in rows.values()) == pieces.agg(F.sum("length")).first()[0]
    for r in packed.collect():
        s = rows[r.sequence_id]
        assert bytes(s.ids[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids) and len(s.ids) == 4 * s.length <= 256
        assert s.doc_ids[s.offsets.index(r.offset)] == r.doc_id


# ---- importance resampling ------------------------------------------------------------------------------------------


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) + 1 - k)]


def brute_scores(rows, targets):
    s, t = Counter(), Counter()
    for text in targets:
        t.update(features(text)[1])
    for r in rows:
        s.update(features(r[1])[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000)))) for b in {*s, *t}}
    out = []
    for r in rows:
        n, own = features(r[1])
        h = int(hashlib.sha256(f"42:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((r[0], n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def test_resampling(spark, edge, edge_rows, empty):
    targets = [prose(50, 11), None, "", "The word, THE word\x00\xc9"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = resampling.resample(edge, bench, percent=30).collect()
    want = brute_scores(edge_rows, targets)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 30 * len(able) // 100 + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(x[4], x[0]) for x in able[: len(drawn)]]
    none = bench.filter("false")
    assert resampling.resample(empty, bench).count() == 0 and resampling.resample(edge, none).count() == len(edge_rows)
    assert resampling.draw(edge, bench, percent=30).columns == edge.columns


def test_blocks_and_long_words_hash_alike(monkeypatch):
    texts = ["Ab c " * 40, "", "x" * 200 + " y " + "z" * 64 + " " + "q" * 65, prose(500, 4), "\xc0\xc9 \xe9 \xe9 \xe9", "one"]
    want = [sorted(features(t)[1]) for t in texts]
    for size in (1, 7, 1 << 19):
        monkeypatch.setattr(resampling, "BLOCK_WORDS", size)
        got = [[] for _ in texts]
        for text, bucket in resampling.text_buckets([t.encode() for t in texts]):
            for d, b in zip(text.tolist(), bucket.tolist(), strict=True):
                got[d].append(b)
        assert [sorted(x) for x in got] == want


def test_suffix_array():
    ids = np.array([2, 1, 2, 1, 2, 3, 2, 1])
    ends = np.array([5] * 5 + [8] * 3)
    order, common = resampling.suffix_array(ids, ends, 8)
    tails = [tuple(ids[i : min(i + 3, ends[i])].tolist()) for i in range(8)]
    assert [tails[i] for i in order] == sorted(tails)
    for a, b, n in zip(order, order[1:], common[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(tails[a], tails[b], strict=False)) if x != y), min(len(tails[a]), len(tails[b])))


# ---- manifest -------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of each row, from plain lists."""
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        """root, and for each node its (left, right) steps"""
        steps, of, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i in range(len(nodes)):
                a = of[i] // 3 * 3
                steps[i].append(("".join(level[a : of[i]]), "".join(level[of[i] + 1 : a + 3])))
                of[i] //= 3
            level = [h(*level[a : a + 3]) for a in range(0, len(level), 3)]
        return level[0], steps

    by = defaultdict(list)
    for d, text, lang, source, n_chars, *_ in rows:
        by[source].append((d is None, d or 0, h(*map(field, (d, source, lang, n_chars, text))), d, text, lang, n_chars))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, steps), up in zip(sources, trees, above, strict=True):
        for (_, _, leaf, d, text, lang, n_chars), own in zip(sorted(by[s], key=lambda x: x[:3]), steps, strict=True):
            at = leaf
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                at = h(*map(field, (d, s, lang, n_chars, None if text is None else text.replace("\n", ""))))
            for left, right in own + up:
                at = h(left, at, right)
            out.append((d, leaf, subroot, root, h(*(a + b for a, b in own + up)), at))
    return out


def test_manifest(spark, edge, edge_rows, empty):
    got = manifest.manifest_digest(edge).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute_manifest(edge_rows))
    assert all(r.verified == (r.folded_root == r.root) for r in got) and not all(r.verified for r in got) and any(r.verified for r in got)
    assert manifest.manifest_digest(empty).count() == 0
    one = edge.filter("doc_id = 7")
    row = manifest.manifest_digest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("") and row.verified


@pytest.mark.parametrize("n", [2, 3, 4, 28])
def test_trees_of_any_size(spark, n):
    rows = [(i, "a\nb", "en", s, 3) for s in ("x", "y", "z", None)[: n % 4 + 1] for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r)[:6] for r in manifest.manifest_digest(df).collect()) == Counter(brute_manifest(rows))


def test_sql_of_sets(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    from lattika.llm import queries

    for name in ("op12_importance_resampling", "op13_merkle_manifest"):
        ours = queries.queries()[name](spark, "/root/testdata/sf0.001")
        theirs = con.sql(queries.oracle_sql()[name])
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert Counter(map(tuple, ours.select(*theirs.columns).collect())) == Counter(theirs.fetchall())


# ---- blocks of near duplicates --------------------------------------------------------------------------------------


@pytest.mark.parametrize("longest", [100, 8 << 20])
def test_a_long_text_costs_one_block(spark, longest):
    """2,000 near copies in one group: about 12 blocks, with or without one text of 8 MB, and no block over the limit but a text that is over it alone."""
    from lattika.llm import near_duplicates as nd

    nodes = spark.range(2000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("near"), F.when(F.col("id") == 777, longest).otherwise(100).cast("long").alias("bytes"))
    at = nd._blocks(nodes, nd.BLOCK, nd.SPREAD, 1 << 20)
    assert at.count() == 2000 and at.filter("many").count() == 2000
    tasks = nd._tasks(at, nodes.select(F.col("node").alias("cls"), F.lit(1).cast("long").alias("bucket")))
    assert tasks.count() < 50000
    pairs = tasks.filter("side < 2").groupBy("task").agg(F.collect_set("side").alias("s"))
    assert pairs.filter("size(s) <> 2").count() == 0
    sizes = at.join(nodes.select(F.col("node").alias("cls"), "bytes"), "cls").groupBy("j").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("top")).collect()
    assert all(r.n <= 167 and r.b - r.top <= 1 << 20 for r in sizes) and len(sizes) <= 21
