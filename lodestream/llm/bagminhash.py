"""Near-duplicate documents: multisets of word shingles, BagMinHash signatures, banding, verified overlap.

The similarity of two documents is the weighted Jaccard index of the multisets of their `SHINGLE`-word sequences: the
sum of the smaller counts over the sum of the larger. A document with fewer words has one shingle, all its words; one
without words has none and is like no other. Words are runs of anything but space, tab, newline, vertical tab, form
feed and return.

Signature: each (shingle, count) is a Poisson process over the weights up to the count. The weights are discretised
to whole numbers and halved hierarchically, into (0, 1], (1, 2], (2, 4], (4, 8] and so on; each interval has a process of
its own whose points fall on weights and on signature components, and those above the count are thinned out. Points
are made in order of time, round by round, until a document's components are all earlier than its next points.

1. Equal texts are one node, named by their smallest doc_id.
2. Nodes with an equal band are candidates. Of each band the first node is compared with every other (a star, not all
   pairs); verified pairs give components.
3. Members of bands that still hold several components meet in cells of about `CELL` nodes or `CELL_BYTES` of text a
   side. A cell compares its nodes exactly wherever their components differ, and returns one link for each two
   components that it joins, never all pairs.
4. Components of all links are the classes; their name is the smallest doc_id.

With 30 bands of 5 rows a pair at similarity 0.8 shares no band with probability 7e-6; every pair that shares one is
decided by its exact overlap.

Rows with a null doc_id are in no class but their own (null). Rows with equal doc_ids are one document, whatever their
texts; those of them without words are named by their doc_id. Null texts count as empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm._shared import gathered, linked, scratch, small_batches, trim, whole_groups, written
from lodestream.llm.repeats import GOLDEN, U, flattened, mix, words

BANDS, ROWS, SHINGLE = 30, 5, 5
CELL, CELL_BYTES = 2048, 4 << 20
#: Bytes of text that a worker holds at once, many times over in arrays.
BATCH = 2 << 20
#: Texts that are cut into shingles together: 12 bits of a sort key name the text, 52 the shingle.
TOGETHER = 4096
#: Points that are made at once.
POINTS = 200_000


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, repeats included, by text."""
    code, _, _, starts = words(*flattened(texts))
    counts = np.diff(starts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(len(counts)), n)
    at = starts[of] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = np.minimum(counts, size).astype(np.uint64)[of]
    last = starts[1:][of]
    code = np.append(code, U(0))
    for i in range(size):
        inside = at + i < last
        out = np.where(inside, mix(out * GOLDEN + code[np.minimum(at + i, len(code) - 1)]), out)
    return of, out


def multisets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle; a shingle has 52 bits."""
    parts = []
    for c in range(0, max(1, len(texts)), TOGETHER):
        of, hashed = shingles(texts.slice(c, TOGETHER))
        key = np.sort(of.astype(np.uint64) << U(52) | hashed >> U(12))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        parts.append(((key[first] >> U(52)).astype(np.int64) + c, key[first] & U((1 << 52) - 1), np.diff(np.append(first, len(key)))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(of: np.ndarray, hashed: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """An n x m array of the earliest point of each component; rows without shingles stay infinite."""
    sig = np.full((n, m), np.inf)
    level = 0
    parts = []
    while True:  # the intervals (0, 1], (1, 2], (2, 4], ...
        low, length = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
        own = np.flatnonzero(count > low)
        if not len(own):
            break
        parts.append((of[own], mix(hashed[own] + U(level * 0xD1B54A32D192ED03 & (1 << 64) - 1)), np.full(len(own), low), np.full(len(own), length), count[own]))
        level += 1
    if not parts:
        return sig
    doc, seed, low, length, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(doc))
    flat = sig.reshape(-1)
    worst = np.full(n, np.inf)
    k = 0
    while len(doc):
        # Several points of each process at once where few processes go on; the sums are the same as one by one.
        step = int(np.clip(POINTS // len(doc), 1, 64))
        for c in range(0, len(doc), POINTS):
            own = slice(c, c + POINTS)
            salt = mix((np.arange(k, k + step, dtype=np.uint64) + U(1)) * GOLDEN)
            draw = mix(seed[own, None] ^ salt)
            wait = -np.log(((draw >> U(11)).astype(np.float64) + 0.5) / (1 << 53)) / length[own, None]
            at = np.cumsum(np.concatenate([time[own, None], wait], axis=1), axis=1)[:, 1:]
            time[own] = at[:, -1]
            row, col = np.nonzero(at < worst[doc[own]][:, None])
            at, more = at[row, col], mix(draw[row, col] + GOLDEN)
            row = row + c
            wide = np.flatnonzero(length[row] > 1)
            if len(wide):  # A point belongs to a weight of the interval; above the count it is not there.
                r = row[wide]
                gone = low[r] + 1 + ((more[wide] & U(0xFFFFFFFF)).astype(np.float64) / (1 << 32) * length[r]).astype(np.int64) > weight[r]
                keep = np.ones(len(row), bool)
                keep[wide[gone]] = False
                row, at, more = row[keep], at[keep], more[keep]
            place = doc[row] * m + ((more >> U(32)) * U(m) >> U(32)).astype(np.int64)
            np.minimum.at(flat, place, at)
        live = np.zeros(n, bool)
        live[doc] = True
        live = np.flatnonzero(live)
        worst[live] = sig[live].max(axis=1)
        going = time < worst[doc]
        doc, seed, low, length, weight, time = (x[going] for x in (doc, seed, low, length, weight, time))
        k += step
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS components each."""
    bits = sig.view(np.uint64)
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * GOLDEN + bits[:, b * ROWS + r])
        out[:, b] = h
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, "text", BATCH):
        table = table.combine_chunks()
        place = table["digest"].combine_chunks().dictionary_encode().indices.to_numpy()
        _, first = np.unique(place, return_index=True)  # the codes are 0, 1, 2, ...
        of, hashed, count = multisets(table["text"].combine_chunks().take(pa.array(first)))
        sig = signatures(of, hashed, count, len(first), BANDS * ROWS)
        none = ~np.isfinite(sig).all(axis=1)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * BANDS, pa.int32()), pa.array(bands(sig).reshape(-1).view(np.int64)), mask=pa.array(none))
        yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["digest"].combine_chunks(), listed.take(pa.array(place))], ["doc_id", "digest", "bands"])
        del table, of, hashed, count, sig
        trim()


class Overlaps:
    """The multisets of distinct texts, to count what one shares with many."""

    def __init__(self, texts: pa.Array):
        of, hashed, self.count = multisets(texts)
        values, self.shingle = np.unique(hashed, return_inverse=True)
        self.bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        self.total = np.bincount(of, self.count, minlength=len(texts)).astype(np.int64)
        self.mark = np.zeros(len(values), np.int64)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """The sum of the smaller counts of text `one` and of each of `others`."""
        a, b = self.bounds[one], self.bounds[one + 1]
        self.mark[self.shingle[a:b]] = self.count[a:b]
        n = self.bounds[others + 1] - self.bounds[others]
        ends = np.cumsum(n)
        at = np.repeat(self.bounds[others] - (ends - n), n) + np.arange(int(ends[-1]))
        both = np.concatenate(([0], np.cumsum(np.minimum(self.mark[self.shingle[at]], self.count[at]))))
        self.mark[self.shingle[a:b]] = 0
        return both[ends] - both[ends - n]

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` reach 0.8."""
        same = self.shared(one, others)
        return (same > 0) & (5 * same >= 4 * (self.total[one] + self.total[others] - same))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts reach 0.8."""
    for table in gathered(batches, "text_b", BATCH):
        table = table.combine_chunks()
        joined = pa.concat_arrays([table["text_a"].combine_chunks(), table["text_b"].combine_chunks()]).dictionary_encode()
        own = Overlaps(joined.dictionary)
        code = joined.indices.to_numpy()
        a, b = code[: table.num_rows], code[table.num_rows :]
        order = np.argsort(a, kind="stable")
        good = np.zeros(table.num_rows, bool)
        for rows in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            good[rows] = own.near(int(a[rows[0]]), b[rows])
        yield from table.select(["a", "b"]).filter(pa.array(good)).to_batches()
        del table, own
        trim()


def _links(own: Overlaps, side: np.ndarray, node: np.ndarray, label: np.ndarray, code: np.ndarray) -> list[tuple[int, int]]:
    """Of one cell: links that join its components wherever nodes of two of them are near."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one_side = not len(right)
    right = left if one_side else right
    right = right[np.argsort(own.total[code[right]], kind="stable")]
    left = right if one_side else left
    sizes = own.total[code[right]]
    order = {i: k for k, i in enumerate(left.tolist())}

    def near(i: int, elsewhere: np.ndarray) -> np.ndarray:
        total = int(own.total[code[i]])
        low = order[i] + 1 if one_side else int(np.searchsorted(sizes, -(-4 * total // 5)))
        other = right[low : int(np.searchsorted(sizes, 5 * total // 4, "right"))]
        other = other[elsewhere[other]]
        return other[own.near(int(code[i]), code[other])] if len(other) else other

    return [(min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))) for i, j in linked(label, order, near)]


def _linked_cells(table: pa.Table) -> pa.Table:
    """Links (a, b) of the cells (equal slots, neighbours in `table`) of side, node, label and text."""
    slot, side, node, label = (table[c].to_numpy() for c in ("slot", "side", "node", "label"))
    coded = table["text"].combine_chunks().dictionary_encode()
    own, code = Overlaps(coded.dictionary), coded.indices.to_numpy()
    found = []
    if len(slot):
        cuts = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found += _links(own, side[a:b], node[a:b], label[a:b], code[a:b])
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_linked_cells` of whole cells, about `CELL_BYTES` of text at a time; rows come sorted by slot."""
    for table in whole_groups(batches, "slot", "text", CELL_BYTES):
        yield from _linked_cells(table).to_batches()
        trim()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label) of all nodes of the undirected edges (a, b): the smallest node that each is linked to."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    both = written(edges.select(ends.alias("e")).select("e.*").distinct(), f"{folder}/both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), f"{folder}/labels-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("up"))
        new = near.join(up, near.near == up._n).select("node", F.least("near", "up").alias("label"))
        new = written(new, f"{folder}/labels-{k}")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def same_ids(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Links (a, b) between the nodes of rows (`key`, digest) that have one id and several contents."""
    mixed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select(key)
    return rows.join(mixed, key, "left_semi").join(nodes, "digest").select(F.col(key).alias("a"), F.col("node").alias("b")).where("a <> b")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "bagminhash")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    signed = written(own.mapInArrow(_signed, "doc_id long, digest binary, bands array<long>"), f"{folder}/signed")
    named = signed.where("doc_id is not null and bands is not null")
    nodes = written(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), f"{folder}/nodes")
    banded = nodes.select("node", "digest", F.explode("bands").alias("band"))
    several = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(several, "band"), f"{folder}/members")
    # Texts of nodes that have candidates. An id whose rows have several texts may have several here.
    wanted = members.select(F.col("node").alias("_n"), F.col("digest").alias("_d")).distinct()
    texts = own.join(wanted, (own.doc_id == wanted._n) & (own.digest == wanted._d), "left_semi").dropDuplicates(["doc_id", "digest"])
    texts = written(texts.select(F.col("doc_id").alias("node"), "text", "digest"), f"{folder}/texts")

    # The first node of a large band has many partners: its text goes to as many places as hold about CELL of them.
    star = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = written(star, f"{folder}/star")
    centres = star.groupBy("a").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cuts"))
    spread = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(centres, "a").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    dealt = star.join(centres, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("cut"))
    pairs = dealt.join(spread, ["a", "cut"]).join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    verified = written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), f"{folder}/verified")
    labels = components(verified, f"{folder}/first")

    marked = members.join(labels, "node", "left").select("band", "node", "digest", "size", F.coalesce("label", "node").alias("label"))
    sizes = texts.select("node", "digest", F.octet_length("text").alias("bytes"))
    marked = written(marked.join(sizes, ["node", "digest"]), f"{folder}/marked")
    split = marked.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("bytes").alias("bytes")).where("lo <> hi").select("band", F.greatest(F.ceil(F.col("bytes") / CELL_BYTES), F.lit(1)).alias("most"))
    crossed = (
        marked.drop("bytes")
        .join(split, "band")
        .withColumn("cuts", F.greatest(F.ceil(F.col("size") / CELL), "most").cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("slot"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "digest", "label")
        .join(texts, ["node", "digest"])
        .select("slot", "side", "node", "label", "text")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = crossed.repartition(n, "slot").sortWithinPartitions("slot", "side", "node").mapInArrow(_crossed, "a long, b long")
    same = same_ids(named, nodes, "doc_id")
    found = components(verified.unionByName(more).unionByName(same), f"{folder}/all")
    final = nodes.select(F.col("digest").alias("_d"), "node").join(found, "node", "left").select("_d", F.coalesce("label", "node").alias("class_id"))
    rows = signed.select("doc_id", "digest").join(final, F.col("digest") == F.col("_d"), "left")
    return rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The document of each class whose doc_id names it, with its own columns; rows with a null doc_id all stay.

    Of rows with equal doc_ids that with the least digest of its text stays, and of equal texts the one whose other
    columns have the least hash.
    """
    kept = classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    others = [F.col(c) for c in docs.columns if c != "text"]
    row = F.struct(F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("digest"), F.xxhash64(F.to_json(F.struct(*others))).alias("rest"))
    # The input's columns travel in one struct, so none of them can clash with a name used here.
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), row.alias("order"))
    own = own.where("id is not null").join(kept, F.col("id") == F.col("_kept"), "left_semi")
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("order"))).where("place = 1")
    return first.select("row.*").unionByName(docs.where(F.col("doc_id").cast("long").isNull()))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS k, count(*) AS c
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w) GROUP BY ALL
), n AS (
  SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 5 * sum(least(a.c, b.c)) >= 4 * (na.n + nb.n - sum(least(a.c, b.c)))
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS v, doc_id AS l FROM w UNION SELECT u.a, r.l FROM r JOIN u ON u.b = r.v
)
SELECT doc_id, class_id FROM documents LEFT JOIN (SELECT v, min(l) AS class_id FROM r GROUP BY v) ON v = doc_id
"""
