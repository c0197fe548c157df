"""Folder trees of any depth, and the index that page changes keep up to date."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import index, merge, text
from quire.streaming import streams


def _slow_rollup(folders, members):
    parent = {(o, f): p for o, f, p, _ in folders}
    name = {(o, f): n for o, f, _, n in folders}
    out = {k: [0, 0, 0, []] for k in parent}
    for (o, f) in parent:
        own = sum(1 for a, b, _ in members if (a, b) == (o, f))
        at, steps, path = f, 0, []
        while at is not None:
            out[o, at][0] += own
            out[o, at][1] = max(out[o, at][1], steps)
            path.insert(0, name[o, at])
            at, steps = parent[o, at], steps + 1
        out[o, f][2], out[o, f][3] = steps - 1, path
    return out


def test_folder_sums_equal_a_walk(spark):
    rng = random.Random(4)
    folders, members = [], []
    for owner in (1, 2, 3):
        for f in range(60):
            folders.append((owner, f, None if f == 0 or rng.random() < 0.1 else rng.randrange(max(0, f - 9), f), f"n{f}"))
    members = [(rng.choice((1, 2, 3)), rng.randrange(60), d) for d in range(300)]
    tree = spark.createDataFrame(folders, "owner_id int, folder_id int, parent_id int, name string")
    filed = spark.createDataFrame(members, "owner_id int, folder_id int, document_id int")
    own = spark.createDataFrame([(o, d) for o in (1, 2, 3, 4) for d in range(310)], "owner_id int, document_id int")
    found = merge.folder_rollup(tree, filed, own).collect()
    want = _slow_rollup(folders, members)
    assert {(r.owner_id, r.folder_id): [r.documents, r.height, r.depth, r.path] for r in found if r.folder_id is not None} == want
    assert {r.owner_id: (r.documents, r.unfiled) for r in found if r.folder_id is None} == {o: (310, 310 - len({d for a, _, d in members if a == o})) for o in (1, 2, 3, 4)}
    assert merge.folder_rollup(tree.limit(0), filed.limit(0), own.limit(0)).count() == 0


def test_deep_and_wide_folders(spark):
    # a chain of 10,000, whose closure would have 5 * 10^7 rows, and 3,000 folders in one
    chain = spark.range(10_000).selectExpr("1 AS owner_id", "id AS folder_id", "if(id = 0, NULL, id - 1) AS parent_id", "concat('n', id) AS name")
    wide = spark.range(3_000).selectExpr("2 AS owner_id", "id AS folder_id", "if(id = 0, NULL, 0L) AS parent_id", "'n' AS name")
    tree = chain.unionByName(wide)
    members = tree.selectExpr("owner_id", "folder_id", "folder_id AS document_id")
    found = merge.folder_rollup(tree, members, paths=False)
    deep = {r.folder_id: (r.documents, r.height, r.depth) for r in found.where("owner_id = 1").collect()}
    assert deep == {i: (10_000 - i, 9_999 - i, i) for i in range(10_000)}
    assert found.where("owner_id = 2 AND folder_id = 0").first().documents == 3_000
    short = merge.folder_rollup(chain.where("folder_id < 700"), members.where("owner_id = 1 AND folder_id < 700"))
    assert short.where("folder_id = 699").first().path == [f"n{i}" for i in range(700)]


def _pages(rng, n):
    out = []
    for i in range(n):
        page = f"p{rng.randrange(25)}"
        version = i + 1
        body = " ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.randrange(1, 260)))
        out.append((page, f"d{page}", 1, body, None if rng.random() < 0.4 else body.upper(), rng.choice(["", "note"]), rng.random() < 0.25, version))
    return out


CHANGES = "page_id string, document_id string, page_number int, ocr_text string, punctuated_text string, notes string, is_deleted boolean, version int"


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_give_the_batch_index(spark, tmp_path, seed):
    rng = random.Random(seed)
    changes = _pages(rng, 60)
    last = {}
    for c in changes:
        last[c[0]] = max(last.get(c[0], c), c, key=lambda x: x[-1])
    batch = spark.createDataFrame([c for c in last.values() if not c[6]], CHANGES)
    want = sorted((r.chunk_id, r.chunk_text) for r in index.chunk_sources(text.explode_sources(batch.drop("is_deleted", "version"))).collect())
    told = changes + rng.sample(changes, 20)
    rng.shuffle(told)
    at, kept = f"{tmp_path}/index", streams.PageIndex(spark, f"{tmp_path}/index", 8)
    for i in range(0, len(told), 16):
        kept.apply(spark.createDataFrame(told[i : i + 16], CHANGES))
    found = sorted((r.chunk_id, r.chunk_text) for r in kept.read("chunks").collect())
    assert found == want
    assert {r.page_id: (r.version, r.is_deleted) for r in kept.read("versions").collect()} == {p: (c[-1], c[6]) for p, c in last.items()}
    before = kept.manifest()
    assert kept.apply(spark.createDataFrame(told[:30], CHANGES)) == 0 and kept.manifest() == before
    # one page more touches one bucket
    page = ("new", "d", 1, "text", None, "", False, 1)
    assert kept.apply(spark.createDataFrame([page], CHANGES)) == 1
    assert sum(before.get(b) != g for b, g in kept.manifest().items()) == 1
    # what a lost batch left behind does not show, and is written over
    spark.createDataFrame([("x", "y")], "a string, b string").write.parquet(f"{at}/chunks/{max(kept.manifest().values()) + 1}")
    assert kept.apply(spark.createDataFrame([("newer", *page[1:])], CHANGES)) == 1
    assert {r.page_id for r in kept.read("versions").collect()} == set(last) | {"new", "newer"}


def test_streamed_index_equals_batch(spark, tmp_path):
    changes = _pages(random.Random(9), 40)
    df = spark.createDataFrame(changes, CHANGES)
    df.repartition(7).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        streams.stream_index_pages(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint", 4).start().awaitTermination()
    newest = df.groupBy("page_id").agg(F.max_by(F.struct("*"), "version").alias("p")).select("p.*").where("NOT is_deleted")
    want = {r.chunk_id for r in index.chunk_sources(text.explode_sources(newest.drop("is_deleted", "version"))).collect()}
    assert {r.chunk_id for r in streams.indexed_chunks(spark, f"{tmp_path}/index").collect()} == want
    assert streams.indexed_chunks(spark, f"{tmp_path}/nothing").count() == 0
