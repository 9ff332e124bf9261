"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Documents are linked if 100 * |A n B| >= 75 * |A u B| for their sets of distinct
five-word shingles.

1. One pass over the texts gives each document its set size, a fingerprint of
   the whole set, and a MinHash signature of ``TREES`` keys of ``DEPTH`` minima.
   Documents with equal sets form a class; only its smallest id goes on.
2. A tree is a sorted order of the signatures: tree t sorts by key t, then by
   key t+1.  Documents that agree on key t (a common prefix of ``DEPTH`` values)
   are a region of tree t.  Two documents of similarity 0.75 share no region in
   any tree with probability (1 - 0.75**4)**40 < 3e-7.
3. Depth adapts per region: a region of more than ``REGION`` documents is split
   by its next key, one that is still too large (a family of near copies) by
   blocks of ids.  Every part keeps a candidate towards its whole region's
   smallest document, so a split never separates what the region joins.
4. Candidates are first each document and the hub (smallest document of a
   region) it shares most trees with, at least STAR_TREES; once those links are
   merged, all pairs of small regions and, in the sorted order of larger ones,
   neighbours that still lie in different components.  Every tree has its own
   order and blocks.  A family of n copies costs about n candidates, not n*n.
5. What crowded regions (more than NEAR + 1 documents) still hold in different
   components is joined exactly: a pair of the similarity shares a shingle among
   the first quarter of both sets, in any common order of shingles (here the
   rarest first), and what lies behind the first common one bounds the overlap.
6. Every candidate is confirmed on the full sets of both texts; components are
   the connected components of the confirmed links.

Rows: null, empty and all-space texts have an empty set and link with nothing;
a text of one to four words is one shingle; rows that share a doc_id are one
vertex (repeated rows come back as often as they occur); a row with a null
doc_id links with nothing, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as T
from .graph import components
from .scratch import stored

TREES, DEPTH = 40, 4
REGION, NEAR = 512, 16
#: Trees a document must share with a hub to be its first candidate (the others come up as neighbours); salts of a class of copies.
STAR_TREES, SALTS = 3, 16
#: Counters of shingles (16 MB) that order them by rarity; rows of a shingle from which the exact join deals its pairs to a grid of tasks.
COUNTERS, HOT_ROWS = 1 << 22, 512
#: Ids of candidates (about 32 MB of them) that are broadcast to select their texts; beyond, a shuffle does it.
BROADCAST_IDS = 2_000_000
WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75


def signatures(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """TREES keys per non-empty row: each a hash of DEPTH minima of 32-bit permutations of its shingles."""
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return np.zeros((0, TREES), np.uint64)
    starts = offs[full]
    base = (flat >> np.uint64(32)).astype(np.uint32)
    a = (T.stream(0xA1, TREES * DEPTH) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    c = (T.stream(0xC1, TREES * DEPTH) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(full), TREES), np.uint64)
    for t in range(TREES):
        key = np.full(len(full), t, np.uint64)
        for d in range(DEPTH):
            j = t * DEPTH + d
            low = np.minimum.reduceat((base ^ c[j]) * a[j], starts)
            key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, t] = key
    return out


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (fp1, fp2), and the signature keys (empty where the set is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                flat, offs = T.shingle_sets(batch.column(1).slice(lo, hi - lo), WORDS)
                size = np.diff(offs)
                sums = np.zeros((2, len(flat) + 1), np.uint64)
                np.cumsum(T.mix(flat + np.uint64(1)), out=sums[0, 1:])
                np.cumsum(T.mix(flat ^ np.uint64(0x5BF0A8B1)), out=sums[1, 1:])
                prints = (sums[:, offs[1:]] - sums[:, offs[:-1]]).view(np.int64)
                keys = signatures(flat, offs)
                key_offs = np.concatenate([[0], np.cumsum((size > 0) * TREES)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]),
                     pa.ListArray.from_arrays(pa.array(key_offs), pa.array(keys.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "keys"])

    return docs.select(F.col(id_column).cast("long"), text_column).mapInArrow(
        run, "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def regions(heads: DataFrame) -> DataFrame:
    """Rows (region, deep, doc, n, hub, size) of the trees' region parts with at least two documents.

    ``region`` identifies the part, ``deep`` is the next key, ``hub`` the
    smallest document of the whole region, ``size`` the whole region's.
    """
    rows = heads.select(
        F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"),
        F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(keys[t] as region, keys[(t + 1) % {TREES}] as deep))")).alias("x"),
    ).select("doc", "n", "x.region", "x.deep")
    counted = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("doc").alias("hub")).where("size > 1")
    joined = rows.join(counted, "region")
    joined = stored(joined, "regions")
    crowded = joined.where(F.col("size") > REGION)
    deep = crowded.groupBy("region", "deep").agg(F.count("*").alias("part_size"))
    split = crowded.join(deep, ["region", "deep"])
    blocks = F.ceil(F.col("part_size") / REGION)
    split = split.select(F.xxhash64("region", "deep", F.pmod(F.xxhash64("region", "doc"), blocks)).alias("region"), "deep", "doc", "n", "hub", "size")
    return joined.where(F.col("size") <= REGION).select("region", "deep", "doc", "n", "hub", "size").unionByName(split)


def neighbours(parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a part's sorted order, of documents in different components and of sizes that allow a link.

    Regions of up to NEAR + 1 documents show all their pairs.  In larger ones
    each document shows the one before it only, where the component changes:
    that merges most of a family before ``apart`` joins what is left exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            got = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            rows = got if tail is None else np.concatenate([tail, got], axis=1)
            fresh = 0 if tail is None else tail.shape[1]
            region, doc, n, comp, size = rows
            pairs = []
            for gap in range(1, NEAR + 1):
                second = np.arange(max(fresh, gap), rows.shape[1])
                if not len(second):
                    continue
                first = second - gap
                ok = (region[first] == region[second]) & (comp[first] != comp[second]) & (doc[first] != doc[second])
                small, large = np.minimum(n[first], n[second]), np.maximum(n[first], n[second])
                ok &= (100 * small >= PERCENT * large) & ((gap == 1) | (size[second] <= NEAR + 1))
                pairs.append(np.stack([np.minimum(doc[first], doc[second])[ok], np.maximum(doc[first], doc[second])[ok]]))
            tail = rows[:, -NEAR:]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(pairs, axis=1), axis=1)], names=["a", "b"])

    met = (parts.repartition("region").sortWithinPartitions("region", "deep", F.xxhash64("region", "doc"), "doc")
           .select("region", "doc", "n", "component", "size").mapInArrow(run, "a long, b long"))
    return met.distinct()


def crowd(labelled: DataFrame) -> DataFrame:
    """(doc, component) of the documents in crowded regions of several components; regions with the same hub count as one."""
    crowded = labelled.where(F.col("size") > NEAR + 1)
    mixed = crowded.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hub")
    mixed = stored(mixed, "mixed")
    return crowded.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "hub", "left_semi").select("doc", "component").distinct()


def apart(members: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Pairs (a, b) of members (doc, component) in different components, among them all that reach the similarity."""
    members = stored(members, "crowd")
    text = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("t")).where("doc is not null")
    text = text.join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, "doc").select("doc", "component", "t")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for lo, hi in T.steps(batch.column(2)):
                flat, _ = T.shingle_sets(batch.column(2).slice(lo, hi - lo), WORDS)
                np.add.at(seen, (flat & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(seen[slots])], names=["slot", "n"])

    # a slot that one shingle of one document fills is no shared shingle and stays 1
    table = text.mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    often = np.ones(COUNTERS, np.int32)
    often[table.column("slot").to_numpy()] = np.minimum(table.column("n").to_numpy(), np.iinfo(np.int32).max)
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shipped.value
        for batch in batches:
            doc, component = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi in T.steps(batch.column(2)):
                flat, offs = T.shingle_sets(batch.column(2).slice(lo, hi - lo), WORDS)
                n = np.diff(offs)
                row = np.repeat(np.arange(hi - lo), n)
                count = often[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((flat, count, row))  # rows stay in place
                at = np.arange(len(flat)) - offs[row]
                keep = (at <= n[row] - -(-PERCENT * n[row] // 100)) & (count[order] > 1)
                r = row[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (flat[order][keep].view(np.int64), at[keep], n[r], doc[lo + r], component[lo + r])],
                    names=["shingle", "at", "n", "doc", "component"])

    rows = stored(text.mapInArrow(prefixes, "shingle long, at long, n long, doc long, component long"), "prefixes")
    keys = rows.groupBy("shingle").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    sides = F.ceil(F.sqrt(F.col("rows") / HOT_ROWS)).alias("sides")
    rows = stored(rows.join(keys.select("shingle", sides), "shingle"), "shared")
    # a row has one place on its side of the grid and meets all places of the other: every pair meets in one cell
    place, others = F.pmod(F.xxhash64("doc"), F.col("sides")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    left = rows.withColumn("i", place).withColumn("j", others).alias("l")
    right = rows.withColumn("j", place).withColumn("i", others).alias("r")
    near = F.expr("l.shingle = r.shingle and l.i = r.i and l.j = r.j and l.component < r.component "
                  f"and {100 + PERCENT} * least(l.n - l.at, r.n - r.at) >= {PERCENT} * (l.n + r.n)")
    return left.join(right, near).select(F.expr("least(l.doc, r.doc)").alias("a"), F.expr("greatest(l.doc, r.doc)").alias("b")).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; ``pairs`` is read several times, so pass a stored table."""
    text = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("t")).where("id is not null")
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # only texts of candidates are shuffled: by a broadcast of their ids if those are few, else by a join
    text = text.join(F.broadcast(need) if need.count() <= BROADCAST_IDS else need, "id", "left_semi")
    both = (pairs.join(text.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
            .join(text.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in T.steps(batch.column(3)):
                fresh = np.flatnonzero(np.concatenate([[True], left[lo + 1:hi] != left[lo:hi - 1]]))  # a hub's text once
                fa, oa = T.shingle_sets(batch.column(2).slice(lo, hi - lo).take(pa.array(fresh)), WORDS)
                fb, ob = T.shingle_sets(batch.column(3).slice(lo, hi - lo), WORDS)
                which = np.searchsorted(fresh, np.arange(hi - lo), side="right") - 1
                for r in range(hi - lo):
                    x, y = fa[oa[which[r]]:oa[which[r] + 1]], fb[ob[r]:ob[r + 1]]
                    if len(x) and len(y):
                        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                        common = int(np.count_nonzero(x[at] == y))
                        keep[lo + r] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked doc_id), kept (doc_id = component_id)."""
    sketch = stored(sketches(docs, id_column, text_column), "sketches")
    thin = sketch.select("doc_id", "n_shingles", "fp1", "fp2")
    full = thin.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    key = ["doc_id", "n_shingles", "fp1", "fp2"]  # an id that stands for two sets keeps both signatures
    heads = sketch.where("doc_id is not null and n_shingles > 0").join(classes.withColumnRenamed("head", "doc_id").select(*key), key, "left_semi")
    heads = heads.dropDuplicates(key)
    parts = stored(regions(heads), "parts")

    # a document whose head has another text shares its doc_id, so both sets' classes join there
    copied = classes.where("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a class of copies may be huge
    same = full.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copied, ["n_shingles", "fp1", "fp2", "salt"])
    same = same.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    shared = parts.where("doc <> hub").groupBy("doc", "hub").agg(F.count("*").alias("trees")).where(F.col("trees") >= STAR_TREES)
    star = shared.groupBy("doc").agg(F.max(F.struct("trees", -F.col("hub"))).alias("best")).select((-F.col("best.col2")).alias("a"), F.col("doc").alias("b"))
    links = stored(confirmed(stored(star, "pairs"), docs, id_column, text_column), "links")
    merged = components(links)

    def labelled() -> DataFrame:
        rows = parts.join(merged.withColumnRenamed("node", "doc"), "doc", "left")
        return rows.withColumn("component", F.coalesce("component", "doc"))

    more = stored(neighbours(labelled()), "pairs")
    links = stored(links.unionByName(confirmed(more, docs, id_column, text_column)), "links")
    merged = components(links)
    rest = stored(apart(crowd(labelled()), docs, id_column, text_column), "pairs")
    links = links.unionByName(confirmed(rest, docs, id_column, text_column)).unionByName(same)
    found = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = thin.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group, with all its columns.

    Rows that repeat a doc_id and its text go too; different texts under one
    doc_id all stay if the id does; rows without a doc_id stay.
    """
    kept = near_duplicates(docs, id_column, text_column).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col(id_column).isNotNull())
    digest = max(docs.columns, key=len) + "_digest"  # longer than any column's name, so it clashes with none
    first = named.join(kept, named[id_column] == kept["_kept"], "left_semi").withColumn(digest, F.sha2(text_column, 256))
    first = first.dropDuplicates([id_column, digest]).drop(digest)
    return first.unionByName(docs.where(F.col(id_column).isNull()))
