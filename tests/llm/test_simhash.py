import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from helpers import no_documents, odd_documents

from tidemark.llm import graph, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values, bits):
    """Least value reachable, by comparing everything with everything."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint():
    for t in ["", "A b", "x", "a b c d", "A  b\tc\nd e É é f g\x0bh", "a b c d e " * 300]:
        assert simhash.fingerprint(t.encode()) & (2 ** 64 - 1) == plain_fingerprint(t)


def test_masks_hold_all_close_pairs():
    for blocks in (5, 6, 7, 9):
        masks = simhash.block_masks(blocks)
        rng = random.Random(blocks)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)


@pytest.mark.parametrize("bits,blocks,dense", [(4, 5, 4096), (4, 6, 4096), (4, None, 2), (4, 5, 3), (3, 4, 2), (2, 4, 4096)])
def test_components_against_all_pairs(spark, bits, blocks, dense):
    rng = random.Random(bits * 100 + dense)
    values = [0, 1, 2 ** 64 - 1]
    for _ in range(25):
        centre = rng.getrandbits(64)
        values.append(centre)
        for _ in range(rng.choice([0, 1, 6])):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.append(centre)
    signed = [v - 2 ** 64 if v >> 63 else v for v in set(values)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    roots = {r.node: r.root for r in graph.components(simhash.links(fps, bits, blocks, dense)).collect()}
    want = brute_components(signed, bits)
    groups, ours = defaultdict(set), defaultdict(set)
    for v in signed:
        groups[want[v]].add(v)
        ours[roots.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_blocks_stay_whole_where_joins_are_split(spark, tmp_path):
    # two files, tied to one another only in the four large blocks, whose partitions of the join are skewed
    for top in (0, 1):
        spark.range(1024).selectExpr(f"shiftleft(id + {top * 1024}, 52) AS fp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/fps")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        roots = graph.components(simhash.links(spark.read.parquet(f"{tmp_path}/fps"), 4, 5))
        assert roots.count() == 2048 and roots.where("root != 0").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_long_chain_is_one_component(spark):
    edges = spark.range(3000).selectExpr("id AS u", "id + 1 AS v")
    got = graph.components(edges)
    assert got.count() == 3001 and got.where("root != 0").count() == 0


def test_table_against_all_pairs(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    fps = {d: plain_fingerprint(t or "") for d, t in rows}
    root = brute_components(list(fps.values()), 4)
    least = {}
    for d, f in sorted(fps.items(), reverse=True):
        least[root[f]] = d
    got = simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert {r.doc_id: (r.fp & (2 ** 64 - 1), r.component_id) for r in got} == {d: (f, least[root[f]]) for d, f in fps.items()}
    assert len(got) == len(rows)


def test_odd_rows(spark):
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(odd_documents(spark)).collect())
    blank = [(d, 2) for d in (-1, 2, 3, 4)]
    assert sorted(got) == sorted([(-1, 1), (1, 1), (1, 1), *blank, (5, 5), (6, 6)])
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert simhash.keep_one(no_documents(spark)).count() == 0
    lone = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d e f g h")], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.keep_one(lone).collect()) == ["a b", "c d e f g h"]
