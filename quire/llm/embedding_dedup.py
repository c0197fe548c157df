"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by the PREFIX reference points (pivots) nearest to it, in order. An
inverted list per pivot and label holds the vectors that name it. Two vectors become candidates
when they share at least `shared` pivots; only candidates' cosines are then worked out, in double
precision. A pair is looked at only in the list of the least pivot that both name, so it counts
once. Long lists are cut into blocks, and each pair of blocks is a task of its own: within one, a
product of the blocks' incidence matrices gives shared-pivot counts, and only numbers of links and
a spanning edge per vector leave it, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tasks
from .graph import components

#: Reference points: one for PER_PIVOT vectors, within these limits (they are broadcast).
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 256, 32, 4096
#: Pivots that describe a vector, and how many of them two vectors must share to be compared.
PREFIX, SHARED = 10, 4
#: Bytes of all pivots together, which are broadcast; long vectors get fewer.
PIVOT_BYTES = 64_000_000
#: Vectors of one block of an inverted list.
BLOCK = 1024
#: Vector lengths that get pivots, the most frequent ones; vectors of other lengths share one list per
#: label and length, whose pairs are all verified.
INDEXED_LENGTHS = 64


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cast = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    some = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0)
    return cast.withColumn("usable", F.coalesce(some, F.lit(False)))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _describe(sent, prefix: int):
    def run(batches):
        pivots = sent.value
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _unit(_matrix(part.column(2), dim))
                if (own := pivots.get(int(dim))) is None:
                    near = np.zeros((len(x), 1), dtype=np.int32)
                else:
                    k = min(prefix, len(own))
                    near = np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :k].astype(np.int32)
                yield pa.record_batch([part.column(0), part.column(1), part.column(3), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(near), pa.list_(pa.int32()))], names=["cid", "label", "copies", "unit", "pivots"])

    return run


def _incidence(pivots: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Vectors by pivots that occur in either block, 1 where a vector names a pivot."""
    out = np.zeros((len(pivots), len(columns)), dtype=np.float32)
    np.put_along_axis(out, np.searchsorted(columns, pivots), 1, axis=1)
    return out


def _compare(cosine: float, shared: int):
    """One task per pair of blocks of a list: links of each vector (weighted by copies) and edges to the least linked one."""

    def run(key, table):
        pivot, left, right = key[2].as_py(), key[4].as_py(), key[5].as_py()
        side = table.column("side").to_numpy()

        def block(which):
            part = table.filter(pa.array(side == which)).combine_chunks()
            n = part.num_rows
            x, p = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1)) for c in ("unit", "pivots"))
            return part.column("cid").to_numpy(), part.column("copies").to_numpy(), x, p

        ids_a, copies_a, xa, pa_ = a = block(0)
        ids_b, copies_b, xb, pb = a if left == right else block(1)
        names, numbers, edges_a, edges_b = [], [], [], []
        if len(ids_a) and len(ids_b):
            columns = np.union1d(pa_, pb)
            ma, mb = _incidence(pa_, columns), _incidence(pb, columns)
            common = ma @ mb.T
            lower = int(np.searchsorted(columns, pivot))
            candidate = common >= min(shared, pa_.shape[1])
            if lower:  # pairs that meet in an earlier list are that list's
                candidate &= (ma[:, :lower] @ mb[:, :lower].T) == 0
            if left == right:
                candidate &= np.tri(len(ids_a), k=-1, dtype=bool).T
            i, j = np.nonzero(candidate)
            hit = np.zeros(len(i), dtype=bool)
            for k in range(0, len(i), 1 << 16):
                hit[k : k + (1 << 16)] = np.einsum("nd,nd->n", xa[i[k : k + (1 << 16)]], xb[j[k : k + (1 << 16)]]) >= cosine
            i, j = i[hit], j[hit]
            for ids, own, other in ((ids_a, i, copies_b[j]), (ids_b, j, copies_a[i])):
                n = np.bincount(own, weights=other, minlength=len(ids)).astype(np.int64)
                names.append(ids[n > 0])
                numbers.append(n[n > 0])
            # a forest over the linked vectors of both blocks, by spreading least numbers
            la = ids_a.copy()
            lb = la if left == right else ids_b.copy()
            while True:
                least = np.minimum(la[i], lb[j])
                if (la[i] == least).all() and (lb[j] == least).all():
                    break
                np.minimum.at(la, i, least)
                np.minimum.at(lb, j, least)
            for ids, low in ((ids_a, la), (ids_b, lb)):
                edges_a.append(ids[ids != low])
                edges_b.append(low[ids != low])
        n, m = sum(map(len, names)), sum(map(len, edges_a))
        link_ids, links, ea, eb = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (names, numbers, edges_a, edges_b))
        other = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(eb, pa.int64())])
        return pa.table([pa.array(np.concatenate([link_ids, ea]), pa.int64()), pa.array(np.concatenate([links, np.zeros(m, dtype=np.int64)]), pa.int64()), other], names=["cid", "links", "other"])

    return run


def linked_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """Link vectors of one label whose cosine is `cosine` or more, as far as the index finds them.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a
    null label or id, link with nothing. Vectors of different length do not link. Equal vectors of
    one label are one class: they all link with each other and are indexed once. Rows that share
    a vec_id are in one component; n_links of a row counts the other rows linked with it. An empty
    table gives no rows; extra columns are ignored. Pivots are a sample by hash, at most
    MOST_PIVOTS for a length; all vectors are indexed.

    Returns per row: vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    found = _usable(vectors, id_col, vector_col, label_col)
    labels = found.select("vec_id", "usable", "label", F.when(F.col("usable"), F.struct(F.xxhash64("vec"), F.xxhash64("vec", F.lit(1)), F.size("vec"))).alias("same"), "vec")
    sized = staged(labels, "vectors")
    classes = sized.where("usable").groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("vec", "vec_id").alias("vec"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    lengths = classes.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(INDEXED_LENGTHS).collect()
    pivots = {}
    for dim, count in lengths:
        room = max(LEAST_PIVOTS, PIVOT_BYTES // (8 * dim * len(lengths)))
        wanted = int(min(MOST_PIVOTS, room, max(LEAST_PIVOTS, count // PER_PIVOT)))
        # `wanted` vectors, MOST_PIVOTS at most, come to the driver
        rows = classes.where(F.size("vec") == dim).orderBy(F.xxhash64("rep"), "rep", F.xxhash64("vec")).limit(wanted).select("vec").collect()
        pivots[dim] = _unit(np.array([r["vec"] for r in rows], dtype=np.float64))
    sent = spark.sparkContext.broadcast(pivots)
    label_type = classes.schema["label"].dataType.simpleString()
    described = classes.select("cid", "label", "vec", "copies").mapInArrow(_describe(sent, prefix), f"cid long, label {label_type}, copies long, unit array<double>, pivots array<int>")
    described = staged(described, "described")

    listed = described.select("label", F.size("unit").alias("dim"), "cid", "copies", "unit", "pivots", F.explode("pivots").alias("pivot"))
    of_list = described.select("label", F.size("unit").alias("dim"), F.explode("pivots").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = listed.join(of_list, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("left"), F.greatest(o, F.col("block")).alias("right"), (o < F.col("block")).cast("int").alias("side")))
    keys = ["label", "dim", "pivot", "blocks", "left", "right"]
    spread = dealt.withColumn("p", F.explode(pairs)).select("label", "dim", "pivot", "blocks", F.col("p.left").alias("left"), F.col("p.right").alias("right"), F.col("p.side").alias("side"), "cid", "copies", "unit", "pivots")
    seen = staged(spread.groupBy(*keys).applyInArrow(_compare(cosine, shared), "cid long, links long, other long"), "vector-links")

    links = seen.groupBy("cid").agg(F.sum("links").alias("links"))
    # a vec_id of several classes holds them together
    ids = sized.where("usable").select("vec_id", F.col("label").alias("l"), F.col("same").alias("s"))
    cid_of = ids.join(classes, (F.col("l") == classes["label"]) & (F.col("s") == classes["same"])).select("vec_id", "cid")
    several = cid_of.groupBy("vec_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a <> z").select("vec_id", "a")
    held_by = cid_of.join(several, "vec_id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    edges = seen.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")).union(held_by)
    groups = staged(components(edges, "vector-components"), "vector-groups")
    lowest = groups.join(classes, F.col("node") == F.col("cid")).groupBy("component").agg(F.min("rep").alias("low"))
    groups = groups.join(lowest, "component").select("node", "low")
    of_class = classes.select("label", "same", "cid", "copies", "rep").join(links, "cid", "left").join(groups, F.col("cid") == F.col("node"), "left")
    of_class = of_class.select(F.col("label").alias("l"), F.col("same").alias("s"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    joined = sized.join(of_class, (sized["label"] == F.col("l")) & (sized["same"] == F.col("s")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
