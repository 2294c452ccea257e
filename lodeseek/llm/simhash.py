"""SimHash near-dedup by anchor-point covering.

Anchors are pairs of codewords of the perfect binary Golay code of length 23 (covering
radius 3), one for each of two 23-bit stretches of the 64-bit fingerprint: 2^24 anchors.
A fingerprint's home is the anchor within radius 3 in both stretches. It is replicated
to every anchor within the radius plus the threshold: if two fingerprints differ in at
most 2 bits, d1 of them in the first stretch and d2 in the second, then the one lies
within 3 + d1 and 3 + d2 of the other's home, so they meet there. That is at most 69
copies of a distinct fingerprint whatever the corpus, and the last 18 bits take part in
the comparison alone.

A few bits of one fingerprint are too strict for copies with edits: texts that share 0.8
of their shingles of five words differ in 3 to 11 bits. `similar_texts` therefore begins
with the anchors, whose candidates it checks exactly, and then looks for all links that
they leave by the texts' rare shingles (prefix filtering), which finds any kind of edit
alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shuffled, stage, text_of, tidy, unused
from .components import components
from .words import mixed, slices, split_words

SHINGLE, THRESHOLD = 3, 2
GOLAY_BITS, GOLAY_RADIUS = 23, 3
#: Fixed value: the generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101
POINTS = 4096
#: Of similar_texts: words a shingle, similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a set's sketch.
SKETCH = 8
SKETCH_COLUMNS = [f"sketch_{i}" for i in range(SKETCH)]
#: Texts at a rare shingle above which they meet by bands of size.
CROWDED = 64
#: Shingles are counted in 2^BUCKET_BITS buckets, which are added up in chunks and slots; bytes of text taken together.
BUCKET_BITS, CHUNKS, SLOTS, SLICE = 18, 16, 64, 4_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a lower-cased text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k, h = min(shingle, len(words)), xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1, SLICE):
                found = [fingerprint(t.encode().lower(), shingle) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*batch.schema.names[:-1], "fingerprint"]
                )

    return tidy(run)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fingerprint (longs) for each row of docs; null and empty texts have fingerprint 0."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, text_hash long, fingerprint long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's low and high part; for each syndrome the words e + c of weight 3 to 5 at most, and their excess."""
    code = np.zeros(1, np.int64)
    for i in range(12):
        code = np.concatenate([code, code ^ (GOLAY_POLYNOMIAL << i)])

    def syndrome(words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for i in range(11, -1, -1):
            out = np.where(out >> (i + 11) & 1, out ^ (GOLAY_POLYNOMIAL << i), out)
        return out

    low, high = syndrome(np.arange(1 << 12)), syndrome(np.arange(1 << 11) << 12)
    bits = [1 << i for i in range(GOLAY_BITS)]
    leaders = np.array([0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)])
    leader = np.zeros(1 << 11, np.int64)
    leader[syndrome(leaders)] = leaders
    # the home first, then what lies one and two farther than the radius
    width = 22
    words, excess = np.zeros((1 << 11, width), np.int64), np.full((1 << 11, width), 9, np.int64)
    for s, e in enumerate(leader):
        offset = e ^ code
        weight = np.bitwise_count(offset)
        over = np.maximum(weight.astype(np.int64) - GOLAY_RADIUS, 0)
        near = np.flatnonzero(over <= THRESHOLD)
        near = near[np.argsort(weight[near], kind="stable")]
        words[s, : len(near)], excess[s, : len(near)] = offset[near], over[near]
    return low, high, words, excess


def anchors(points: np.ndarray, reach: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (unsigned): index of the fingerprint, anchor up to `reach` bits beyond the radius, and whether it is the home."""
    low, high, words, excess = _golay()
    halves = [(points >> np.uint64(s)).astype(np.int64) & (1 << GOLAY_BITS) - 1 for s in (0, GOLAY_BITS)]
    near, over = [], []
    for half in halves:
        s = low[half & 4095] ^ high[half >> 12]
        near.append(half[:, None] ^ words[s])
        over.append(excess[s])
    i, a, b = np.nonzero(over[0][:, :, None] + over[1][:, None, :] <= reach)
    return i, near[0][i, a] | near[1][i, b] << GOLAY_BITS, (a == 0) & (b == 0)


def _replicas(homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, POINTS):
                points = whole.column(0).to_numpy()[k : k + POINTS]
                i, anchor, home = anchors(points.view(np.uint64))
                if homes_only:
                    i, anchor = i[home], anchor[home]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(points[i])], names=["anchor", "point"])

    return tidy(run)


def near_fingerprints(points: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a, b: the pairs of distinct fingerprints (column point, long, no repeats) that differ in 1 to `threshold` <= 2 bits; once each."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover differences of up to {THRESHOLD} bits")
    homes = points.mapInArrow(_replicas(True), "anchor long, point long").select("anchor", F.col("point").alias("a"))
    visits = points.mapInArrow(_replicas(False), "anchor long, point long").select("anchor", F.col("point").alias("b"))
    visits = shuffled(visits)  # up to 69 rows a point, which Spark's guess takes for one
    met = homes.join(visits, "anchor").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (long), component_id, text_hash, component (its smallest fingerprint) for each row of docs.

    docs: doc_id, text; other columns are ignored. Documents are linked if their
    fingerprints differ in at most `threshold` bits; component_id is the smallest doc_id
    reachable. Copies share a fingerprint and are compared once. Null, empty and wordless
    texts have fingerprint 0 and are linked with each other like any others; rows that
    repeat a doc_id count each; a null doc_id is no component's id unless it has no
    other (then that is null). An empty table gives an empty one.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(marked.groupBy(F.col("fingerprint").alias("point")).agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges = stage(near_fingerprints(distinct.select("point"), threshold), "fingerprint-links")
    of = stage(components(edges), "fingerprint-components") if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    grouped = distinct.join(of, F.col("point") == F.col("node"), "left").select(
        "point", "first_id", F.coalesce("component", "point").alias("component")
    )
    grouped = stage(grouped, "grouped-fingerprints")
    least = grouped.groupBy(F.col("component").alias("c")).agg(F.min("first_id").alias("component_id"))
    named = stage(grouped.join(least, F.col("component") == F.col("c")).select("point", "component_id", "component"), "named-fingerprints")
    for table in (distinct, edges, of, grouped):
        if hasattr(table, "_lodeseek_path"):
            discard(table)
    return marked.join(named, F.col("fingerprint") == F.col("point")).select("doc_id", "fingerprint", "component_id", "text_hash", "component")


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each shingle, the text it is of, and the key of each text; a text shorter than a shingle is one shingle, one without words none."""
    number, words, sizes = split_words(pc.ascii_lower(texts))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    tokens, ends = hashes[number], np.cumsum(sizes)
    keys = np.array([xxhash.xxh64_intdigest(tokens[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())], np.uint64).view(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    width = np.minimum(sizes, shingle)[text]
    starts = np.flatnonzero(np.arange(len(number)) + width <= ends[text])
    total, width = np.zeros(len(starts), np.uint64), width[starts]
    for j in range(shingle):
        inside = width > j
        total[inside] += mixed(hashes, j)[number[starts[inside] + j]]
    return mixed(total + width.astype(np.uint64), shingle), text[starts], keys


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each stretch of hashes: the bits set in over half of them, 0 for none."""
    out, some = np.zeros(len(sizes), np.uint64), sizes > 0
    if not some.any():
        return out
    first = (np.cumsum(sizes) - sizes)[some]
    for bit in range(64):
        n = np.add.reduceat(hashes >> np.uint64(bit) & np.uint64(1), first)
        out[some] |= (2 * n.astype(np.int64) > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each stretch of distinct hashes SKETCH words: every hash turns one bit over.

    Two sets whose sketches differ in d bits differ in at least d elements, so they share
    (n + m - d) / 2 at most.
    """
    out, some = [], sizes > 0
    first = (np.cumsum(sizes) - sizes)[some]
    place = (hashes >> np.uint64(8)) % np.uint64(64 * SKETCH)  # not the bits that order the hashes
    bit = np.uint64(1) << place % np.uint64(64)
    for word in range(SKETCH):
        turned = np.zeros(len(sizes), np.uint64)
        if some.any():
            turned[some] = np.bitwise_xor.reduceat(np.where(place // np.uint64(64) == word, bit, np.uint64(0)), first)
        out.append(turned.view(np.int64))
    return out


def _counts(shingle: int):
    """From text: how many shingles fall into each bucket of hashes, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                found, _, _ = shingle_hashes(batch.column(0), shingle)
                total += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        rows, slot = [part.tobytes() for part in np.split(total, CHUNKS)], TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([slot] * CHUNKS, pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "slot", "n"])

    return tidy(run)


def bucket_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of the texts in each bucket of hashes: how common a shingle is at most."""

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.int64) for b in group.n], axis=0)
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "slot": [group.slot.iloc[0]], "n": [total.tobytes()]})

    schema = "chunk int, slot int, n binary"
    by_slot = rows.select("text").mapInArrow(_counts(shingle), schema).groupBy("chunk", "slot").applyInPandas(added, schema)
    out = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.int64)
    for r in by_slot.groupBy("chunk").applyInPandas(added, schema).collect():  # CHUNKS rows
        out[r.chunk] = np.frombuffer(r.n, np.int64)
    return out.ravel()


def _rare_shingles(common, shingle: int, similarity: float):
    """From doc_id, text_hash, text: doc_id, text_hash, key, number of shingles, fingerprint, and the rarest shingles, any of which a similar text shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = common.value
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                found, text, keys = shingle_hashes(batch.column(2), shingle)
                prints = majority_bits(found, np.bincount(text, minlength=len(keys)))
                order = np.lexsort((found, counts[(found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], text))
                found, text = found[order], text[order]
                fresh = np.ones(len(found), bool)
                fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
                found, text = found[fresh], text[fresh]
                sizes = np.bincount(text, minlength=len(keys))
                at = np.arange(len(found)) - (np.cumsum(sizes) - sizes)[text]
                first = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
                mine = at < first[text]
                offsets = np.concatenate([[0], np.cumsum(np.minimum(first, sizes))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[mine].view(np.int64)))
                columns = [*batch.columns[:2], pa.array(keys), pa.array(sizes.astype(np.int32)), pa.array(prints.view(np.int64)), *map(pa.array, sketches(found, sizes)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "key", "size", "fingerprint", *SKETCH_COLUMNS, "rare"])

    return tidy(run)


def _shingle_sets(shingle: int):
    """From text: key of the words, sorted distinct hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                found, text, keys = shingle_hashes(batch.column(0), shingle)
                ends = np.cumsum(np.bincount(text, minlength=len(keys)))
                sets = [np.unique(part.view(np.int64)) for part in np.split(found, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return tidy(run)


def _can_be_similar(similarity: float):
    """Of a meeting of (size, at) with (other_size, other_at): were this their first shared shingle, enough could follow."""
    after = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    return after + 1e-9 >= (F.col("size") + F.col("other_size")) * (similarity / (1 + similarity))


def _sketches_allow(similarity: float):
    """Of texts with sketches: they can share enough. Turns away most pairs of a group whose edits lie in different places."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in SKETCH_COLUMNS), F.lit(0))
    both = F.col("size") + F.col("other_size")
    return both - apart + 1e-9 >= both * (2 * similarity / (1 + similarity))


def _others(postings: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return postings.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("key", "component", "size", "at", *more)])


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")).distinct()


def anchor_meetings(texts: DataFrame) -> DataFrame:
    """a < b: keys of texts whose fingerprints are close, as links of classes: each text with the smallest key of its
    fingerprint, and the smallest keys of close fingerprints with each other. texts: key, fingerprint."""
    classes = stage(texts.groupBy(F.col("fingerprint").alias("point")).agg(F.min("key").alias("low")), "fingerprint-classes")
    own = texts.join(classes, F.col("fingerprint") == F.col("point")).filter(F.col("key") != F.col("low")).select(F.col("low").alias("a"), F.col("key").alias("b"))
    near = near_fingerprints(classes.select("point"))
    of_a, of_b = (classes.select(F.col("point").alias(side), F.col("low").alias(f"key_{side}")) for side in ("a", "b"))
    apart = near.join(of_a, "a").join(of_b, "b").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    return own.union(apart)


def meetings(postings: DataFrame, similarity: float, salt: int = 0) -> DataFrame:
    """a < b: keys of texts that share a rare shingle and can be similar, one of them the first or the last at that shingle.

    postings: shingle, key, component, size, at. Keys stand in another order for each salt.
    """
    place = F.xxhash64("key", F.lit(salt))
    columns = ("key", "component", "size", "at")
    ends = postings.groupBy("shingle").agg(*[F.struct(*[of(c, place).alias(c) for c in columns]).alias(name) for name, of in (("low", F.min_by), ("high", F.max_by))])
    stands = ends.select("shingle", F.explode(F.array_distinct(F.array("low", "high"))).alias("one")).select("shingle", "one.*")
    met = stands.join(shuffled(_others(postings)), "shingle").filter(F.col("component") != F.col("other_component"))
    return _pairs(met.filter(_can_be_similar(similarity)))


def _band(size) -> Column:
    """Sizes within a twentieth of each other are in one band or in two beside each other."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1.05))


def _bands_to_meet(similarity: float) -> Column:
    """The bands of the sizes with which a text of (size, at) can be similar, were this their first shared shingle; none is possible.

    Both share size - at shingles at most, and similarity / (1 + similarity) of both sizes
    at least: so the more of a text's own comes before the shingle, the smaller its partners.
    """
    size, left = F.col("size").cast("double"), (F.col("size") - F.col("at")).cast("double")
    least = F.ceil(size * similarity - 1e-9)
    most = F.floor(F.least(size / similarity, left * ((1 + similarity) / similarity) - size) + 1e-9)
    return F.when(most >= least, F.sequence(_band(least), _band(most))).otherwise(F.array().cast("array<bigint>"))


def all_meetings(postings: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a < b: keys of all texts of different components that share a rare shingle and can be similar.

    postings as of meetings; texts: key and sketch. At each shingle the texts of the
    largest component meet the others only, so that a large group is not compared with itself.
    Where more than CROWDED texts share a shingle they meet by bands of size: a text only
    those whose size allows a link, so that pages of one template, most of each its own,
    are not compared with each other.
    """
    of_each = postings.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    largest = of_each.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("n"), F.sum("n").alias("here"))
    several = postings.join(largest.filter("n > 1").drop("n"), "shingle").join(texts.select("key", *SKETCH_COLUMNS), "key")
    several = stage(several, "postings-of-several")
    crowded = F.col("here") > CROWDED
    small = several.filter(F.col("component") != F.col("largest"))
    small = small.withColumn("band", F.explode(F.when(crowded, _bands_to_meet(similarity)).otherwise(F.array(F.lit(0).cast("bigint")))))
    others = several.withColumn("band", F.when(crowded, _band(F.col("size"))).otherwise(F.lit(0).cast("bigint")))
    once = (F.col("other_component") == F.col("largest")) | (F.col("key") < F.col("other_key"))
    met = small.join(shuffled(_others(others, (*SKETCH_COLUMNS, "band")).withColumnRenamed("other_band", "band")), ["shingle", "band"])
    met = met.filter((F.col("component") != F.col("other_component")) & once)
    return _pairs(met.filter(_can_be_similar(similarity) & _sketches_allow(similarity)))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets of shingles have a Jaccard similarity of at least `similarity`."""
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared >= similarity * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _joined(of: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component of all texts linked so far. of: the same before (None for no links), links: the new ones, a and b, at least one.

    Only the components that the new links touch are worked on.
    """
    if of is None:
        return stage(components(links), "text-components")
    edges = links
    for side in ("a", "b"):
        placed = of.toDF("node", f"root_{side}")
        edges = edges.join(placed, F.col(side) == F.col("node"), "left").withColumn(side, F.coalesce(f"root_{side}", side)).select("a", "b")
    roots = stage(components(edges.filter("a <> b").distinct()), "text-roots")
    moved = of.join(roots.toDF("root", "to"), F.col("component") == F.col("root"), "left").select("node", F.coalesce("to", "component").alias("component"))
    out = stage(moved.union(roots.join(of.select("node"), "node", "left_anti")), "text-components")
    discard(roots)
    discard(of)
    return out


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id, text_hash, key, component for each row of docs: rows with one component are copies or linked by similar texts.

    docs: doc_id, text; other columns are ignored. A text is its words (between ASCII
    white space, A-Z lower-cased), known by a 64-bit hash; texts without words are one
    text. Two texts are linked if their sets of shingles have a Jaccard similarity of at
    least `similarity`; a text shorter than a shingle is one shingle.

    The first candidates are texts with close fingerprints, met at anchors. The others
    share a rare shingle: shingles are put in one order for all texts, those of rare
    buckets first. A text of n shingles shares `similarity` * n with a similar one at
    least, so one of its first n - similarity * n + 1 shingles is among the first of the
    other: only these are joined, and no link is missed for want of a meeting. The order
    decides how many meet, not which links are found. Rounds keep a large group from
    being all its pairs: every text meets two texts at each of its rare shingles, then two
    others, then all texts there that are not of its component yet and whose sketches do not
    show that they share too little. So the components are those of all links.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(bucket_counts(rows, shingle))
    schema = f"doc_id {id_type}, text_hash long, key long, size int, fingerprint long, {', '.join(c + ' long' for c in SKETCH_COLUMNS)}, rare array<long>"
    marked = stage(rows.mapInArrow(_rare_shingles(common, shingle, similarity), schema), "rare-shingles")
    members = stage(marked.select("doc_id", "text_hash", "key"), "texts-of-documents")
    first = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("first_hash")
    texts = stage(marked.groupBy("key").agg(F.min("doc_id").alias("first_id"), first, *[F.min(c).alias(c) for c in ("fingerprint", *SKETCH_COLUMNS)]), "distinct-texts")
    each = marked.select("key", F.explode("rare").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("shingle")
    shared = stage(shared, "shared-shingles")
    each = marked.select("key", "size", F.posexplode("rare").alias("at", "shingle")).join(shuffled(shared), "shingle")
    postings = stage(each.distinct(), "postings")
    discard(shared)
    discard(marked)

    # the sets of the texts that share a rare shingle with another: no other has a link
    able = texts.join(postings.select("key").distinct(), "key", "left_semi")
    one = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    made = rows.join(shuffled(able.select("first_id", "first_hash")), one, "left_semi").select("text").mapInArrow(_shingle_sets(shingle), "key long, shingles array<long>")
    sets = stage(made.dropDuplicates(["key"]), "shingle-sets")

    compared, of = [], None
    rounds = (
        lambda _: anchor_meetings(able.select("key", "fingerprint")),
        lambda placed: meetings(placed, similarity),
        lambda placed: meetings(placed, similarity, 1),
        lambda placed: all_meetings(placed, able, similarity),
    )
    for meet in rounds:
        if of is None:
            placed = postings.withColumn("component", F.col("key"))
        else:
            joined = postings.join(of, F.col("key") == F.col("node"), "left")
            placed = joined.select("shingle", "key", "size", "at", F.coalesce("component", "key").alias("component"))
        near = meet(placed)
        for before in compared:
            near = near.join(shuffled(before), ["a", "b"], "left_anti")
        compared.append(stage(near, "text-meetings"))
        links = stage(_similar(compared[-1], sets, similarity), "text-links")
        if not links.isEmpty():
            of = _joined(of, links)
        discard(links)
    for table in (postings, sets, texts, *compared):
        discard(table)
    if of is None:
        return members.withColumn("component", F.col("key"))
    named = members.join(of, F.col("key") == F.col("node"), "left")
    return named.select("doc_id", "text_hash", "key", F.coalesce("component", "key").alias("component"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """The rows of docs without their near duplicates: of each group of similar texts the row with the smallest doc_id.

    docs: doc_id, text and any other columns, all returned. Of rows that repeat that
    doc_id within a group one stays, the one with the smallest hash of its text. A null
    doc_id stays only where its group has no other. See similar_texts.
    """
    found = stage(similar_texts(docs, similarity, shingle).select("doc_id", "text_hash", "component"), "similar-texts")
    kept_id, kept_hash, own_hash = (unused(name, docs.columns) for name in ("kept_id", "kept_hash", "own_hash"))
    smallest = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)))
    first = found.groupBy("component").agg(smallest.alias("first")).select(f"first.{kept_id}", f"first.{kept_hash}").distinct()
    kept = docs.withColumn(own_hash, F.xxhash64(text_of())).join(
        shuffled(stage(first, "kept-documents")), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", own_hash]).select(*docs.columns)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
