"""Near duplicates by ProbMinHash, banding and verification.

A text's distinct shingles (five words; a shorter text is one shingle) all weigh the same, however often the text
repeats one. A shingle is a Poisson process with its weight as rate: its points arrive in order of time, each falls on
one of the signature's components, and a component keeps the shingle of its first point. A text is done as soon as no
next point can come before the latest first point. Two texts agree in a component with the probability Jaccard
similarity, which for equal weights is the Jaccard similarity of the shingle sets. Texts that agree in a whole band of
components are candidates; a candidate pair is a link if that same Jaccard similarity, computed, is at least
``threshold``. Classes are the connected components of the links.

Texts with the same words are one node from the start. Within a band's bucket nodes are compared with one leader, not
with each other. Buckets whose nodes ended in different classes get a second leader, the node with the smallest share
of shingles that no other has. What is still apart is compared within the bucket, in blocks, by an inverted index over
its shingles; only links that join classes leave the task. So no pair of a bucket is left out, and no pairs are
emitted. With 32 bands of 5 a pair of similarity 0.8 shares a bucket with a probability over 0.99999.

Null and empty texts have no shingles and are classes of their own. Repeated rows fall into one class. Null keys are
allowed; a class is named by its least key. Only the key column and results are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptline.llm.bpe import binary_column
from scriptline.llm.text import gather, mix, ngram_hashes, slices, utf8, word_hashes
from scriptline.session import written

SHINGLE = 5
BANDS, ROWS = 32, 5
THRESHOLD = 0.8
#: Nodes of a bucket that one task compares with each other; larger buckets are compared block by block.
BLOCK = 4000


def shingles(column: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text, ascending; their counts; offsets of the texts)."""
    hashes, offsets = word_hashes(column)
    grams, at = ngram_hashes(hashes, offsets, size)
    text = np.searchsorted(offsets, at, side="right") - 1
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    placed = [hashes[offsets[i] : offsets[i + 1]] + np.arange(1, lengths[i] + 1).astype(np.uint64) for i in short]
    whole = mix(np.array([np.bitwise_xor.reduce(mix(p)) for p in placed], np.uint64))
    grams, text = np.concatenate([grams, whole]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    first = np.ones(len(grams), bool)
    if len(grams):
        first[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(first)
    return grams[place], np.diff(np.append(place, len(grams))), np.searchsorted(text[place], np.arange(len(offsets)))


def signatures(items: np.ndarray, weight: np.ndarray, offsets: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures: (texts, components) of 32-bit shingle ids, all ones for a text without shingles."""
    texts = len(offsets) - 1
    text = np.repeat(np.arange(texts), np.diff(offsets))
    best = np.full(texts * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    time = np.zeros(len(items))
    live = np.arange(len(items))
    point = 0
    while live.size:
        point += 1
        draw = mix(items[live] + np.uint64(point * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        component = (mix(draw) % np.uint64(size)).astype(np.int64)
        time[live] += -np.log(uniform) / weight[live]
        packed = time[live].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(best, text[live] * size + component, packed | (items[live] >> np.uint64(32)))
        latest = (best.reshape(texts, size).max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
        open_ = np.isnan(latest)[text[live]] | (time[live] < latest[text[live]])
        live = live[open_]
    return (best & np.uint64(0xFFFFFFFF)).reshape(texts, size)


def bands(signature: np.ndarray, number: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per band: (texts, bands)."""
    out = np.repeat(np.arange(number, dtype=np.uint64)[None], len(signature), axis=0)
    parts = signature.reshape(len(signature), number, rows)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.astype(np.int64)


def content_ids(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """128 bits that depend on the sequence of words; None without words."""
    hashes, offsets = word_hashes(column)
    place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    for j, salt in enumerate((np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))):
        if len(full):
            out[full, j] = mix(np.add.reduceat(mix(hashes * salt + mix(place + salt)), offsets[full]))
    raw, filled = out.tobytes(), np.diff(offsets) > 0
    return [raw[16 * i : 16 * i + 16] if filled[i] else None for i in range(len(out))]


def sketch(docs: DataFrame) -> DataFrame:
    """(key, cid, bands) of rows (key, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                items, _, offsets = shingles(part.column("text"))
                found = bands(signatures(items, np.ones(len(items)), offsets))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(content_ids(part.column("text")), pa.binary()), listed], ["key", "cid", "bands"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, cid binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, items) for the content ids of ``wanted`` (key, cid): 32-bit shingle hashes, ascending, little endian."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = pa.array(content_ids(part.column("text")), pa.binary())
                items, _, offsets = shingles(part.column("text"))
                column = binary_column((items >> np.uint64(32)).astype("<u4"), offsets)
                same = pa.array([a == b for a, b in zip(found.to_pylist(), part.column("cid").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("cid"), column], ["cid", "items"]).filter(same)

    rows = docs.join(wanted, docs["key"].eqNullSafe(wanted["key"])).select("cid", "text")
    return rows.mapInArrow(run, "cid binary, items binary").dropDuplicates(["cid"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least this Jaccard similarity, with it."""

    def run(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    found.append(0.0)
                    continue
                common = len(np.intersect1d(x, y))
                found.append(common / (len(x) + len(y) - common))
            alike = np.array(found, np.float64)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike)], ["a", "b", "similarity"])
            yield out.filter(pa.array(alike >= threshold))

    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def rarity(sets: DataFrame) -> DataFrame:
    """(cid, n, own): the shingles of each node, and how many of them no other node has."""

    def spread(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("items"))
            items = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
            which = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(which)), pa.array(items)], ["cid", "item"])

    own = sets.mapInArrow(spread, "cid binary, item long").groupBy("item").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).where("n = 1")
    counted = sets.select("cid", (F.octet_length("items") / 4).cast("long").alias("n"))
    return counted.join(own.groupBy("cid").agg(F.count("*").alias("own")), "cid", "left").select("cid", "n", F.coalesce("own", F.lit(0)).alias("own"))


def reachable(a: str, b: str, threshold: float) -> F.Column:
    """Whether two nodes can have this similarity, as they share no shingle that only one node has."""
    common = F.least(F.col(f"{a}.n") - F.col(f"{a}.own"), F.col(f"{b}.n") - F.col(f"{b}.own"))
    return common >= F.lit(threshold - 1e-9) * (F.col(f"{a}.n") + F.col(f"{b}.n") - common)


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, cid, label): the members (band, cid) of buckets that hold more than one class."""
    known = labels.select(F.col("node").alias("cid"), "label")
    placed = members.select("band", "cid").join(known, "cid", "left").select("band", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return written(placed.join(mixed.select("band"), "band"), "apart")


def joining_links(sets: list[np.ndarray], labels: list[bytes], threshold: float) -> list[tuple[int, int, float]]:
    """Links (i, j, similarity) between different labels, as many as join all that can be joined."""
    items, which = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    postings = owner[np.argsort(which, kind="stable")]
    number = np.bincount(which, minlength=len(items))
    begin = np.cumsum(number) - number
    group = np.unique(np.array(labels, object), return_inverse=True)[1]
    out, place = [], np.cumsum(sizes) - sizes
    for i in range(len(sets)):
        own = which[place[i] : place[i] + sizes[i]]
        common = np.bincount(gather(postings, begin[own], number[own]), minlength=len(sets))
        alike = common / (sizes[i] + sizes - common)
        for j in np.flatnonzero((alike >= threshold) & (group != group[i])):
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, int(j), float(alike[j])))
    return out


def within_buckets(apart: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity) that join classes of a bucket of (band, cid, label), from all pairs of it."""
    sizes = apart.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = apart.join(sizes, "band").select("band", "cid", "label", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    dealt = dealt.select("band", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "cid", "label")

    def compare(rows: pa.Table) -> pa.Table:
        cids = rows.column("cid").to_pylist()
        found = joining_links([np.frombuffer(x, "<u4") for x in rows.column("items").to_pylist()], rows.column("label").to_pylist(), threshold)
        pairs = [(min(cids[i], cids[j]), max(cids[i], cids[j]), s) for i, j, s in found]
        columns = [pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.float64()))]
        return pa.table(columns, names=["a", "b", "similarity"])

    return dealt.join(sets, "cid").groupBy("band", "x", "y").applyInArrow(compare, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the links (a, b): the least node of each connected component.

    Labels go to neighbours and then jump to the label of the label; every round is written to the shared folder.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("step"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        now = written(moved.join(jump, "step").select("node", F.least("step", "far").alias("label"), "was"), "labels")
        if now.where(F.col("label") != F.col("was")).isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


def links(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (key, cid), links (a, b, similarity) between content ids, labels (node, label) of linked content ids)."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = written(sketch(source), "sketches")
    nodes = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    buckets = written(nodes.select("cid", "key", F.explode("bands").alias("band")), "buckets")
    shared = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("leader")).where("n > 1")
    members = written(buckets.join(shared.select("band", "leader"), "band").select("band", "cid", "key", "leader"), "members")
    sets = written(shingle_sets(source, members.groupBy("cid").agg(F.min("key").alias("key"))), "shingles")
    members = members.select("band", "cid", "leader")
    tried = written(members.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    found = written(verified(tried, sets, threshold), "links")
    labels = components(found)
    apart = mixed_buckets(members, labels)
    if not apart.isEmpty():
        counts = written(rarity(sets.join(apart.select("cid").distinct(), "cid")), "counts")
        # the rest has more own shingles than a link allows
        able = apart.join(counts.where(F.col("n") - F.col("own") >= F.lit(threshold - 1e-9) * F.col("n")), "cid")
        able = written(able.select("band", F.struct("cid", "label", "n", "own").alias("node")), "able")
        leaders = able.groupBy("band").agg(F.min_by("node", F.struct(F.col("node.own") / F.col("node.n"), "node.cid")).alias("other"))
        pairs = able.join(leaders, "band").where((F.col("node.label") != F.col("other.label")) & reachable("node", "other", threshold))
        pairs = pairs.select(F.least("node.cid", "other.cid").alias("a"), F.greatest("node.cid", "other.cid").alias("b")).distinct()
        found = written(found.unionByName(verified(pairs.join(tried, ["a", "b"], "left_anti"), sets, threshold)), "links")
        labels = components(found)
        apart = mixed_buckets(able.select("band", "node.cid"), labels)
        found = written(found.unionByName(within_buckets(apart, sets, threshold)).dropDuplicates(["a", "b"]), "links")
        labels = components(found)
    return rows.select("key", "cid"), found, labels


def classes(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_rows): the least key of the row's class, and how many rows the class has."""
    rows, _, labels = links(docs, threshold, key, text)
    placed = rows.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("key", F.coalesce("label", "cid").alias("label"))
    wordless = placed.where(F.col("label").isNull()).select("key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_rows"))
    placed = placed.where(F.col("label").isNotNull())
    named = placed.groupBy("label").agg(F.min("key").alias("class_id"), F.count("*").alias("class_rows"))
    return placed.join(named, "label").select("key", "class_id", "class_rows").unionByName(wordless).withColumnRenamed("key", key)


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that have a near duplicate with a lesser key (of equal keys, of lesser content id).

    Of rows with equal key and words one stays; rows without words all stay.
    """
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text)
    rows, _, labels = links(docs, threshold, key, text)
    placed = rows.where(F.col("cid").isNotNull()).join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    first = F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "cid")).alias("first")
    chosen = placed.groupBy(F.coalesce("label", "cid").alias("label")).agg(first)
    chosen = chosen.select(F.col("first.key").alias("chosen_key"), F.col("first.cid").alias("chosen_cid"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, names[place]):
                ids = pa.array(content_ids(part.column(place)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*names, "cid"])

    source = docs.toDF(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    named = source.mapInArrow(run, f"{kinds}, cid binary")
    own = F.col(names[docs.columns.index(key)])
    same = (F.col("cid") == F.col("chosen_cid")) & own.eqNullSafe(F.col("chosen_key"))
    kept = named.join(chosen, same, "left_semi").dropDuplicates(["cid", names[docs.columns.index(key)]])
    wordless = named.where(F.col("cid").isNull())
    return kept.unionByName(wordless).drop("cid").toDF(*docs.columns)
