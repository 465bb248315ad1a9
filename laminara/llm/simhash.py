"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most two bits, their high segments
differ in at most one bit, or their low segments are equal. So each fingerprint probes the table of high segments at
the 33 points of its Hamming ball of radius 1, and the table of low segments at its own value; matches are verified on
all 64 bits. A table entry with more than ``HOT`` different fingerprints is not expanded into pairs: the fingerprints
that stand in it or probe it are grouped by the 65 points of their full ball of radius 1 instead. Two fingerprints
share such a point if and only if they differ in at most two bits, and at most 65 fingerprints share one.

Two bits of a fingerprint stand for almost equal texts. ``keep_one`` therefore goes on to texts at a Jaccard similarity
of 0.8 or more, which lie up to some fifteen bits apart, too far for balls within segments: there the candidates come
from bands of min-wise hashes of the same shingles, and each is verified on the whole sets of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import Stored, by_ids, components, read_table, release, small_batches

HOT = 64
#: Bands of min-wise hashes, and hashes in a band: of pairs at a similarity of 0.8, (1 - 0.8 ** 5) ** 24 = 0.00007 are missed.
BANDS, IN_BAND = 24, 5
#: Hashes in a band of the levels for crowds. A level has as many bands as miss no more than the first one does.
LEVELS = (15, 24)
#: A key is crowded if pairing its documents would take more than so many pairs for each of them, at the first levels and
#: at that of LEVELS[0], where keys are costly to make.
CROWD, LATE_CROWD = 4, 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def simhash(text: str | None, n: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit integer.

    A-Z become a-z, words are separated by ASCII white space, every shingle of ``n`` words counts as often as it
    occurs, a text of fewer words is one shingle, and a text without words (or null) has fingerprint zero.
    """
    import numpy as np
    import xxhash

    return fingerprint(shingle_hashes(text, n, seed))


def shingle_hashes(text: str | None, n: int, seed: int = 42):
    """The XXH64 of every shingle of ``n`` words as an unsigned array; none for a text without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shifted = [words[i:] for i in range(n)] if len(words) >= n else [[b" ".join(words)]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(s), seed) for s in zip(*shifted, strict=False)], np.uint64)


def fingerprint(hashes) -> int:
    """The bits set in over half of the hashes."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; other columns are not read. Repeated ids stay repeated."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t, n) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_pairs(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints at two or fewer differing bits, up to connectivity.

    ``fps`` has one column ``fp`` of different longs. Pairs found by probing are all verified on 64 bits; for crowded
    table entries the links lead to the smallest fingerprint of each ball point, which reaches the same components.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    offset = F.lit(1 << 32)
    table = fps.select("fp", F.explode(F.array(high, low + offset)).alias("key"))
    ball = F.expr("transform(sequence(0, 32), i -> shiftrightunsigned(fp, 32) ^ if(i = 32, 0L, shiftleft(1L, i)))")
    probes = fps.select("fp", F.explode(F.concat(ball, F.array(low + offset))).alias("key"))
    crowded = Stored(table.groupBy("key").count().where(F.col("count") > hot).select("key"))
    any_crowded = not crowded.df.isEmpty()
    thin = table.join(crowded.df, "key", "left_anti") if any_crowded else table
    pairs = (
        probes.withColumnRenamed("fp", "u")
        .join(thin.withColumnRenamed("fp", "v"), "key")
        .where("u < v and bit_count(u ^ v) <= 2")
        .select("u", "v")
    )
    if not any_crowded:
        return pairs
    members = probes.join(crowded.df, "key", "left_semi").select("fp").distinct()
    points = members.select("fp", F.explode(F.expr("transform(sequence(0, 64), i -> fp ^ if(i = 64, 0L, shiftleft(1L, i)))")).alias("point"))
    centres = points.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.unionByName(points.join(centres, "point").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(fp, component) for the different fingerprints ``nodes`` (fp, ...) with all their columns."""
    found = components(near_pairs(nodes.select("fp")))
    if found is None:
        return nodes.withColumn("component", F.col("fp"))
    return nodes.join(found.df.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, n_same) for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over fingerprints at two or fewer differing bits, n_same
    the number of rows with the same fingerprint. Rows with a null doc_id keep a null id and take part with their
    fingerprint; where a whole component has none but null ids, component_id is null. Texts that are null or empty
    have fingerprint zero and are linked like any other. An empty table gives an empty result.
    """
    stored = Stored(fingerprints(docs, n))
    nodes = Stored(stored.df.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")))
    tagged = fingerprint_groups(nodes.df)
    lowest = tagged.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = Stored(tagged.join(lowest, "component").select("fp", "component_id", "n_same"))
    nodes.drop()
    return stored.df.join(ids.df, "fp").select("doc_id", "fp", "component_id", "n_same")


def bands_for(in_band: int) -> int:
    """Bands of so many hashes that miss no more pairs at a similarity of 0.8 than ``BANDS`` of ``IN_BAND``."""
    if in_band == IN_BAND:
        return BANDS
    return math.ceil(BANDS * math.log(1 - 0.8**IN_BAND) / math.log(1 - 0.8**in_band))


def band_names(hashes, in_band: int):
    """The name of each band of min-wise hashes of different shingles; equal bands have equal names."""
    import numpy as np

    bands = bands_for(in_band)
    draw = np.random.default_rng(7 if in_band == IN_BAND else in_band)
    turn, factor = (draw.integers(0, 1 << 63, bands * in_band, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least, step = np.full(bands * in_band, ~np.uint64(0)), max(8, (512 * BANDS * IN_BAND) // (bands * in_band))
    for i in range(0, len(hashes), step):
        least = np.minimum(least, ((hashes[None, i : i + step] ^ turn[:, None]) * factor[:, None]).min(axis=1))
    name = np.arange(bands, dtype=np.uint64)
    for k in range(in_band):
        name = (name ^ least[k::in_band]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def signatures(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, row, fp, size, bands): fingerprint, number of different shingles, and band names of each text.

    ``docs`` has doc_id, row and text. Equal bands have equal names; a text without words has none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            fps, sizes, bands = [], [], []
            for text in b.column(2).to_pylist():
                hashes = shingle_hashes(text, n)
                fps.append(fingerprint(hashes) if len(hashes) else 0)
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                bands.append(band_names(hashes, IN_BAND) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row", "fp", "size", "bands"])

    return docs.select("doc_id", "row", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, row long, fp long, size int, bands array<long>")


def longer_bands(sets: DataFrame, in_band: int) -> DataFrame:
    """(doc_id, size, place, key): the band names of sets for a level with so many hashes in a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for i in range(b.num_rows):
                names = band_names(b.column(1)[i].values.to_numpy().view(np.uint64), in_band)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), b.column(0)[i].as_py())), pa.array(np.full(len(names), len(b.column(1)[i].values), np.int32)), pa.array(names)], ["doc_id", "size", "key"])

    return sets.select("doc_id", "set").mapInArrow(run, "doc_id long, size int, key long").select("doc_id", "size", F.lit(0).alias("place"), "key")


def shingle_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, set): the different hashes of the shingles of each text of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            sets = [np.unique(shingle_hashes(t, n)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "set"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, set array<long>")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, size, place, key): the shingles of each set by which it can be similar to another one.

    All shingles are put in one order, the rarest first. Two sets at a Jaccard similarity of ``percent`` or more share
    at least that part of either, so the first shingle they share stands among the first ``size`` less that part, plus
    one, of both: no such pair is missed. Shingles of one set only come first and are not listed; place counts them.
    """
    flat = sets.select("doc_id", F.size("set").alias("size"), F.explode("set").alias("key"))
    often = flat.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    lists = flat.join(often, "key").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("sets", "key"))).alias("s"))
    alone = F.col("size") - F.size("s")
    most = F.lit(1) + F.col("size") - F.floor((F.col("size") * percent + 99) / 100).cast("int")
    lists = lists.select("doc_id", "size", alone.alias("alone"), F.slice("s.key", F.lit(1), F.greatest(F.lit(0), most - alone)).alias("keys"))
    return lists.select("doc_id", "size", "alone", F.posexplode("keys").alias("at", "key")).select("doc_id", "size", (F.col("alone") + F.col("at")).alias("place"), "key")


def reachable(keys: DataFrame, percent: int, spent: list[Stored]) -> DataFrame:
    """The entries ``keys`` (doc_id, size, place, key) of ``prefixes`` by which a set can be similar to another one of the
    key; ``spent`` gets a stored table that the result is read from.

    Sets that share no shingle before this one share no more than what either has from here on. So a set of size s with r
    shingles from here on is similar to none larger than r * (100 + percent) / percent - s, here its bound, and the smaller
    set of a pair has a bound of its own size or more. What goes are entries whose bound lies below the smallest such set of
    their key that is not far too small to be similar. Of sets of about one size these are the ones with over a ninth of
    their shingles before this one (at 80 percent), as copies have that were edited too much to be similar.
    """
    bound = F.expr(f"(size - place) * {100 + percent} div {percent} - size")
    # Sizes of similar sets lie in one class or in two neighbours; the margin keeps rounding out of this.
    span = F.floor(F.log(F.col("size")) / math.log(1.04 * 100 / percent)).cast("int")
    keys = keys.withColumns({"bound": bound, "span": span})
    least = keys.where("bound >= size").groupBy("key", "span").agg(F.min("size").alias("least"))
    least = Stored(least.withColumn("span", F.explode(F.array("span", F.col("span") + 1))).groupBy("key", "span").agg(F.min("least").alias("least")))
    spent.append(least)
    return keys.join(least.df, ["key", "span"]).where("bound >= least").drop("bound", "span", "least")


def similar_rows(docs: DataFrame, signed: DataFrame, n: int = 5, percent: int = 80, joined: list | None = None) -> Stored | None:
    """(doc_id) of the documents that have one of smaller id at a Jaccard similarity of ``percent`` or more of their
    shingles; None if there is none.

    ``docs`` has the texts (doc_id, text), ``signed`` the signatures (doc_id, size, bands) of those that take part; ids
    differ. Candidates share a band. Two rounds compare each document with the smallest one left in each of its bands
    and take out those found, so that a large group of copies falls to its smallest document. What is then left is
    compared with all smaller candidates, level by level: by bands, by ``prefixes`` that are ``reachable``, then by bands of more hashes. A level
    pairs the documents of its keys, but for crowded ones; documents of crowded keys go on to the next level, which would
    find each of their pairs too. So no level makes more than ``CROWD`` (``LATE_CROWD``) pairs for each entry of its keys, however many
    documents one template has made, and only the last takes crowds as they are. ``joined`` gets the numbers of rows that
    the levels' joins make. Whole shingle sets are made for candidates only.
    """
    keys = Stored(signed.select("doc_id", "size", F.explode("bands").alias("key")))
    shared = keys.df.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    members = Stored(keys.df.join(shared, "key", "left_semi"))
    keys.drop()
    ids = Stored(members.df.select("doc_id").distinct())
    if ids.df.isEmpty():
        members.drop()
        ids.drop()
        return None
    sets = Stored(shingle_sets(by_ids(docs.select("doc_id", "text"), ids.df, "left_semi"), n))
    release(docs.sparkSession)
    fits = F.least("u_size", "v_size") * 100 >= F.greatest("u_size", "v_size") * percent

    def similar(pairs: DataFrame) -> Stored:
        u, v = (sets.df.select(F.col("doc_id").alias(x), F.col("set").alias(f"{x}_set")) for x in "uv")
        both = F.size(F.array_intersect("u_set", "v_set"))
        close = 100 * both >= percent * (F.size("u_set") + F.size("v_set") - both)
        pairs = pairs.where("u < v").where(fits).select("u", "v").distinct()
        return Stored(pairs.join(u, "u").join(v, "v").where(close).select(F.col("v").alias("doc_id")).distinct())

    left, gone, spent = members.df, [], [ids, members, sets]
    for _ in range(2):
        pivot = left.groupBy("key").agg(F.min(F.struct("doc_id", "size")).alias("p"))
        pairs = left.join(pivot, "key").select(F.col("p.doc_id").alias("u"), F.col("p.size").alias("u_size"), F.col("doc_id").alias("v"), F.col("size").alias("v_size"))
        gone.append(similar(pairs))
        left = left.join(gone[-1].df, "doc_id", "left_anti")
    asking = Stored(left.select("doc_id").distinct().withColumn("asks", F.lit(True)))
    # What two sets share by prefixes lies at or behind the first shingle they share, and is this part of both sizes at least.
    reach = F.least(F.col("u_size") - F.col("u_place"), F.col("v_size") - F.col("v_place"))
    reaches = reach * (100 + percent) >= percent * (F.col("u_size") + F.col("v_size"))
    inside = sets.df
    for level in (IN_BAND, "prefixes", *LEVELS):
        if level == IN_BAND:
            keys = members.df.withColumn("place", F.lit(0))
        else:
            keys = prefixes(inside, percent) if level == "prefixes" else longer_bands(inside, level)
        keys = Stored(keys.select("doc_id", "size", "place", "key").join(asking.df, "doc_id", "left"))
        if level == "prefixes":
            spent.append(keys)
            keys = Stored(reachable(keys.df, percent, spent))
        counts = keys.df.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count("asks").alias("ask")).where("all > 1 and ask > 0")
        crowded = F.col("all") * F.col("ask") > (LATE_CROWD if level in LEVELS else CROWD) * (F.col("all") + F.col("ask")) if level != LEVELS[-1] else F.lit(False)
        counts = Stored(counts.select("key", crowded.alias("crowded")))
        some = keys.df.join(counts.df.where("not crowded"), "key", "left_semi")
        u, v = (d.select("key", F.col("doc_id").alias(x), F.col("size").alias(f"{x}_size"), F.col("place").alias(f"{x}_place")) for x, d in (("u", some), ("v", some.where("asks"))))
        pairs = u.join(v, "key")
        if joined is not None:
            joined.append(pairs.count())
        gone.append(similar(pairs.where(reaches) if level == "prefixes" else pairs))
        crowd = Stored(keys.df.join(counts.df.where("crowded"), "key", "left_semi").select("doc_id").distinct())
        spent += [keys, counts, crowd]
        if crowd.df.isEmpty():
            break
        inside = sets.df.join(crowd.df, "doc_id", "left_semi")
    found = gone[0].df
    for g in gone[1:]:
        found = found.unionByName(g.df)
    out = Stored(found.distinct())
    for t in (*gone, *spent, asking):
        t.drop()
    release(docs.sparkSession)
    return out


def keep_one(docs: DataFrame, n: int = 5, percent: int | None = 80) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all their columns.

    The documents of smallest id of the groups that fingerprints of shingles of ``n`` words form stay, but those that
    have one of smaller id among these at a similarity of ``percent`` or more; None leaves this step out. Of rows that
    share an id the one with the smallest hash of all columns stands for it, and the others go, as do all but one of
    equal rows. Rows with a null id have no place in the order of ids: all of them stay. Texts without words are one
    group. Only what goes is joined with the texts, so these are not shuffled while the ids that go are few.
    """
    named = docs.where("doc_id is not null")
    row = F.xxhash64(*docs.columns)
    signed = Stored(signatures(named.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text"), n))
    first = signed.df.groupBy("doc_id").agg(F.min(F.struct("row", "fp", "size", "bands")).alias("s"), F.count(F.lit(1)).alias("rows"))
    first = Stored(first.select("doc_id", "s.*", "rows"))
    signed.drop()
    nodes = Stored(first.df.groupBy("fp").agg(F.min("doc_id").alias("first")))
    kept = Stored(fingerprint_groups(nodes.df).groupBy("component").agg(F.min("first").alias("doc_id")).select("doc_id"))
    losers = first.df.select("doc_id").join(kept.df, "doc_id", "left_anti")
    some = None
    if percent is not None:
        some = similar_rows(named.withColumn("doc_id", F.col("doc_id").cast("long")), first.df.join(kept.df, "doc_id", "left_semi"), n, percent)
        if some is not None:
            losers = losers.unionByName(some.df)
    gone = Stored(losers)
    again = Stored(first.df.where("rows > 1").select("doc_id", "row"))
    for t in (nodes, kept, first, some):
        if t is not None:
            t.drop()
    release(docs.sparkSession)
    out = by_ids(named, gone.df, "left_anti")
    if not again.df.isEmpty():
        tag = "row"
        while tag in docs.columns:
            tag += "_"
        chosen = again.df.select(F.col("row").alias(tag))
        repeated = by_ids(named, again.df.select("doc_id"), "left_semi").withColumn(tag, row)
        repeated = by_ids(by_ids(repeated, chosen, "left_semi"), gone.df, "left_anti").dropDuplicates(["doc_id"])
        out = by_ids(out, again.df.select("doc_id"), "left_anti").unionByName(repeated.select(docs.columns))
    return out.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint as 16 hex digits and component of every document."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")
