"""N-gram Jaccard self-join by MinHash banding.

Texts whose sets of five-word shingles have a Jaccard similarity of at least the threshold are linked. Texts with one and the
same set form a class; a class is compared once. Each class gets bands x rows MinHash values; classes that agree in a band
meet in a shuffle on (band, hash of its values). Bands and rows are chosen so that a pair at the threshold meets with at
least the target recall. All pairs that meet are verified on their whole shingle sets.

Classes that meet are joined into candidate components by star edges (one per class and band, never all pairs), and each
component's sets are verified in one task; a component with more than CHUNK_CLASSES classes or CHUNK_BYTES bytes is cut into
chunks, and every pair of chunks is verified in a task of its own. A component of more than MOST_CHUNKS chunks may be a long
chain in which few meet: it is verified by (band, value) instead, with chunks only where so many classes meet in one, if
that sends fewer rows; a pair that meets in several bands counts in the first. So work follows the pairs that meet: a set is
shuffled once a band where few share a value with it, and else about as often as chunks of classes meet it. A task returns a
count of links for each class and a spanning forest of the links, so rows out grow with classes, not with pairs.

Words are runs of characters other than blanks; a text of one to four words has one shingle, all of it.
Defined results: null and empty texts have no shingles, no links, and are classes of their own. Rows with one set (repeated
rows, copies, rows with one id) are linked to each other. A null id takes part but can't name a class while other ids can.
An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, bound_batches, combine, joined, materialize, mix, span_hashes, word_bounds
from rasterloom.llm.components import connected_components

CHUNK_CLASSES, CHUNK_BYTES = 128, 4 << 20
#: Chunks of a component up to which it isn't asked whether verifying it by band would send less.
MOST_CHUNKS = 8
#: Classes up to which a Bloom filter of their ids is broadcast, and its bits an id (before the next power of two).
FILTER_IDS, BITS_PER_ID = 4_000_000, 16
#: Ids up to which the table of what goes is broadcast.
BROADCAST_IDS = 1_000_000
#: Bytes of text hashed together, at some forty times as much memory, in each of an executor's Python workers.
_TEXT_CHUNK = 1 << 18


def choose_bands(threshold: float, target_recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, enough for the recall at the threshold, stay within most_hashes."""
    best = None
    for rows in range(1, 33):
        meet = threshold**rows
        bands = 1 if meet >= target_recall else math.ceil(math.log(1 - target_recall) / math.log1p(-meet))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands within most_hashes reach the target recall")
    return best


def shingle_sets(texts: list[bytes], size: int):
    """For each text its sorted distinct shingle hashes."""
    for first, last in batches_of(texts, _TEXT_CHUNK):
        data, at = joined(texts[first:last])
        starts, ends = word_bounds(data)
        words = span_hashes(data, starts, ends)
        upto = np.searchsorted(starts, at)
        n = max(0, len(words) - size + 1)
        grams = words[:n].copy()
        for k in range(1, size):
            grams = combine(grams, words[k : n + k])
        for a, b in zip(upto[:-1], upto[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                few = words[a : a + 1]
                for k in range(a + 1, b):
                    few = combine(few, words[k : k + 1])
                yield mix(few + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, *, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, key (a digest of the shingle set; null without shingles), bytes of the set, hashes (of each band)."""
    rng = np.random.default_rng(20_240_601)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    schema = docs.select(F.col(id_col).alias("id")).schema.add("key", "binary").add("bytes", "long").add("hashes", "binary")

    def sign(batches):
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for found in shingle_sets([t or b"" for t in batch.column("text").to_pylist()], size):
                sizes.append(8 * len(found))
                if not len(found):
                    keys.append(None)
                    hashes.append(None)
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                # (an odd multiple of a shingle's hash, finalised by its high bits) is a permutation of the hashes for each row
                least = np.empty(len(odd), np.uint64)
                for k in range(0, len(odd), 16):
                    product = found[None, :] * odd[k : k + 16, None]
                    least[k : k + 16] = (product ^ (product >> np.uint64(32))).min(axis=1)
                band = least.reshape(bands, rows)
                value = band[:, 0]
                for r in range(1, rows):
                    value = combine(value, band[:, r])
                hashes.append(value.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary())], ["id", "key", "bytes", "hashes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(sign, schema)


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, candidates: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidate pairs (a boolean matrix) have a Jaccard similarity of at least the threshold: exact on the sets."""
    n_left = np.array([len(x) for x in left])
    other = left if right is None else right
    n_other = np.array([len(x) for x in other])
    small, large = np.minimum.outer(n_left, n_other), np.maximum.outer(n_left, n_other)
    candidates = candidates & (small >= threshold * large - 1e-9)
    pairs = np.argwhere(candidates)
    out = np.zeros(candidates.shape, bool)
    if not len(pairs):
        return out
    everything = left if right is None else left + right
    ids, inverse, times = np.unique(np.concatenate(everything), return_inverse=True, return_counts=True)
    dense = 2.0 * (times > 1).sum() * len(left) * len(other) / 2e10
    sparse = len(pairs) * 2e-5 + (small + large)[candidates].sum() * 1.5e-8
    if dense < sparse:
        shared = np.cumsum(times > 1) - 1
        column, keep = shared[inverse], (times > 1)[inverse]
        owner = np.repeat(np.arange(len(everything)), [len(x) for x in everything])
        column, owner = column[keep], owner[keep]
        both = np.zeros(candidates.shape, np.float32)
        width = 4096
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for first in range(0, int(shared[-1]) + 1, width):
            a, b = np.searchsorted(column, (first, first + width))
            block = np.zeros((len(everything), width), np.float32)
            block[owner[a:b], column[a:b] - first] = 1
            both += block[: len(left)] @ (block if right is None else block[len(left) :]).T
        common = both[candidates]
    else:
        common = np.array([len(np.intersect1d(left[i], other[j], assume_unique=True)) for i, j in pairs])
    union = (n_left[pairs[:, 0]] + n_other[pairs[:, 1]]) - common
    out[candidates] = common >= threshold * union - 1e-9
    return out


def _meet(left: np.ndarray, right: np.ndarray, band: int = -1) -> np.ndarray:
    """Which pairs of rows agree in any band, or in this band and none before it."""
    out = np.zeros((len(left), len(right)), bool)
    for k in range(left.shape[1] if band < 0 else band):
        out |= left[:, k, None] == right[None, :, k]
    return out if band < 0 else ~out & (left[:, band, None] == right[None, :, band])


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            kept.append((int(i), int(j)))
    return kept


def _banded(bands: int):
    """A row (band, value) for each band of hashes."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.cast("int").alias("band"), F.substr("hashes", 8 * k + 1, F.lit(8)).alias("value"))))


def _dealt(members: DataFrame, bands: int) -> DataFrame:
    """Where each of members (key, root, copies, bytes, hashes) is verified: root, band, chunks, chunk, key, copies, hashes.

    Rows of one (root, band) are compared chunk by chunk; band is -1 for a whole component, else root is the band's value.
    """
    count, size = F.count("*").alias("n"), F.sum("bytes").alias("all_bytes")
    n_chunks = F.greatest(F.ceil(F.col("n") / CHUNK_CLASSES), F.ceil(F.col("all_bytes") / CHUNK_BYTES)).cast("int").alias("chunks")
    chunk = F.pmod(F.xxhash64("key"), "chunks").cast("int").alias("chunk")
    names = ["root", "band", "chunks", chunk, "key", "copies", "hashes"]
    sizes = members.groupBy("root").agg(count, size).select("root", "n", n_chunks)
    placed = members.join(sizes.drop("n"), "root").withColumn("band", F.lit(-1))
    large = sizes.where(F.col("chunks") > MOST_CHUNKS)
    if not large.limit(1).count():
        return placed.select(*names)
    wide = members.join(large.select("root"), "root").select("root", "key", "copies", "bytes", "hashes", _banded(bands).alias("b"))
    wide = wide.select(F.col("root").alias("component"), "key", "copies", "bytes", "hashes", "b.band", F.col("b.value").alias("root"))
    meet = wide.groupBy("component", "band", "root").agg(count, size).where("n > 1").select("component", "band", "root", "n", n_chunks)
    rows = meet.groupBy("component").agg(F.sum(F.col("n") * F.col("chunks")).alias("rows"))
    cheaper = materialize(large.join(rows, F.col("root") == F.col("component")).where(F.col("rows") < F.col("n") * F.col("chunks")).select("component"), "join-by-band")
    whole = placed.join(cheaper, F.col("root") == F.col("component"), "left_anti").select(*names)
    return whole.unionByName(wide.join(cheaper, "component", "left_semi").join(meet.drop("n"), ["component", "band", "root"]).select(*names))


def _classes(docs: DataFrame, *, id_col: str, text_col: str, size: int = 5, threshold: float = 0.8, target_recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """signatures() of docs, and key, root (one key for all that links connect), class_id and n_links for each shingle set."""
    bound_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, target_recall)
    signed = materialize(signatures(docs, id_col=id_col, text_col=text_col, size=size, bands=bands, rows=rows), "join-signatures")
    classes = materialize(signed.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("bytes").alias("bytes"), F.min("hashes").alias("hashes")), "join-classes")
    met = classes.select("key", _banded(bands).alias("b")).select("key", "b.band", "b.value")
    first = met.groupBy("band", "value").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = met.join(first, ["band", "value"]).where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    grouped = connected_components(edges)
    members = materialize(grouped.join(classes, grouped.node == classes.key).select("key", "root", "least", "copies", "bytes", "hashes"), "join-members")
    chunked = _dealt(members, bands)
    # the sets themselves, from one text of each class that met another
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    wanted = members.select("key", F.col("least").alias("id"))
    spread = chunked.join(_sets(texts, wanted, size), "key")
    meeting = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("chunk", k).alias("low"), F.greatest("chunk", k).alias("high"))))
    tasks = spread.select("root", "band", "chunk", "key", "copies", "hashes", "grams", meeting.alias("m")).select("root", "band", "m.low", "m.high", "chunk", "key", "copies", "hashes", "grams")

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band, low, high = key[1:]
        pdf = pdf.sort_values("key").reset_index(drop=True)
        at = [np.flatnonzero(pdf["chunk"] == c) for c in dict.fromkeys((low, high))]
        if min(map(len, at)) == 0:
            return pd.DataFrame({"key": [], "links": [], "to": []}, dtype=object)
        hashes = np.stack([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        grams = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        copies, keys = pdf["copies"].to_numpy(), pdf["key"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        left, right = at[0], at[-1]
        candidates = _meet(hashes[left], hashes[right], band)
        if low == high:
            candidates = np.triu(candidates, 1)
        found = _linked([grams[i] for i in left], None if low == high else [grams[i] for i in right], candidates, threshold)
        links[left] += found @ copies[right]
        links[right] += found.T @ copies[left]
        pairs = np.argwhere(found)
        forest = _forest(np.column_stack((left[pairs[:, 0]], right[pairs[:, 1]])), len(pdf))
        some = np.flatnonzero(links)
        return pd.DataFrame({"key": [*keys[some], *(keys[i] for i, _ in forest)], "links": [*links[some].tolist(), *[0] * len(forest)], "to": [*[None] * len(some), *(keys[j] for _, j in forest)]}, dtype=object)

    verified = materialize(tasks.groupBy("root", "band", "low", "high").applyInPandas(verify, "key binary, links long, to binary"), "join-links")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    joined_up = connected_components(verified.where("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b")))
    labelled = classes.join(joined_up, classes.key == joined_up.node, "left").select("key", "least", "copies", F.coalesce("root", "key").alias("root"))
    named = materialize(labelled.join(links, "key", "left").select("key", "least", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "join-named")
    names = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return signed, named.join(names, "root").select("key", "root", "class_id", "n_links")


def _rows(signed: DataFrame, final: DataFrame) -> DataFrame:
    """id, class_id, n_links for each row of signed."""
    out = signed.where("key is not null").select("id", "key").join(final, "key").select("id", "class_id", "n_links")
    return out.unionByName(signed.where("key is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, class_id (least id among the texts that links connect), n_links (other rows linked to this one), a row for each row.

    The options size, threshold and target_recall are those of _classes.
    """
    return _rows(*_classes(docs, id_col=id_col, text_col=text_col, **options)).withColumnRenamed("id", id_col)


def _bit_set(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n hashed ids with two probes each, BITS_PER_ID bits an id; the driver gets its words."""
    bits = 1 << max(12, (BITS_PER_ID * n - 1).bit_length())
    probe = F.explode(F.array(*[F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 21 * k), F.lit(bits)) for k in (0, 1)]))
    words = ids.select(probe.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key and grams (the packed shingle set) for each wanted class; a class is known by its set's digest.

    Up to FILTER_IDS classes, a broadcast Bloom filter of their ids picks the texts while they are scanned, so that only sets
    are shuffled; beyond it, texts are joined by id. Either way the last join on the digest is exact.
    """
    spark = texts.sparkSession
    n = wanted.limit(FILTER_IDS + 1).count()
    some, chosen = texts.select("text", F.xxhash64("id").alias("h")), None
    if n <= FILTER_IDS:
        chosen = spark.sparkContext.broadcast(_bit_set(wanted, n))
    else:
        ids = wanted.select(F.col("id").alias("wanted id"))
        some = texts.join(ids, F.col("id").eqNullSafe(F.col("wanted id")), "left_semi").select("text", F.xxhash64("id").alias("h"))

    def run(batches):
        for batch in batches:
            if chosen is not None:
                words = chosen.value
                h = batch.column("h").to_numpy().view(np.uint64)
                there = np.ones(len(h), bool)
                for k in (0, 1):
                    probe = (h >> np.uint64(21 * k)) & np.uint64(64 * len(words) - 1)
                    there &= (words[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63)) & np.uint64(1)).astype(bool)
                batch = batch.filter(pa.array(there))
            keys, grams = [], []
            for found in shingle_sets([t or b"" for t in batch.column("text").to_pylist()], size):
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                grams.append(found.tobytes())
            yield pa.record_batch({"key": pa.array(keys, pa.binary()), "grams": pa.array(grams, pa.binary())})

    found = some.mapInArrow(run, "key binary, grams binary")
    # rows of one id can hold several texts, and the filter lets some others through: only wanted classes stay, once each
    return found.join(wanted.select("key").hint("merge"), "key", "left_semi").groupBy("key").agg(F.min("grams").alias("grams"))


def _one_each(rows: DataFrame, final: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """Of rows whose id is null or stands in several rows: those that stay, told by id and shingle set.

    A class named by such an id keeps its row of that id with the least key; rows without an id leave one of their class, besides
    the one with an id. Rows without shingles leave one of each id, and all without an id. Among rows of one id and set, the
    least hash of the whole row stays, so a recomputation chooses the same.
    """
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = packed.select("row", "id").schema.add("key", "binary")

    def sign(batches):
        for batch in batches:
            sets = shingle_sets([t or b"" for t in batch.column("text").to_pylist()], size)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(keys, pa.binary())], ["row", "id", "key"])

    keyed = materialize(packed.mapInArrow(sign, schema), "join-unclear")
    nameless = "id is null and key is null"
    one = keyed.where(f"NOT ({nameless})").groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    placed = one.join(final.select("key", "root", "class_id"), "key", "left").where("id is null or key is null or id = class_id")
    first = placed.groupBy("root", "id").agg(F.min_by("row", "key").alias("by key"), F.first("row").alias("only"))
    found = first.select(F.coalesce("by key", "only").alias("row"))  # without a key there is one row of an id
    return found.unionByName(keyed.where(nameless).select("row")).select("row.*")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, **options) -> DataFrame:
    """docs with one row of each class: the one with the least id, and one without an id where there are such rows.

    What goes is told by id, which is little beside the texts: up to BROADCAST_IDS ids the texts aren't shuffled. Where an id is
    null or stands in several rows, it is told by id and shingle set.
    """
    bound_batches(docs.sparkSession)
    signed, final = _classes(docs, id_col=id_col, text_col=text_col, size=size, **options)
    named = _rows(signed, final).where("id is not null").groupBy(F.col("id").alias("other id"))
    told = named.agg(F.max(F.col("id") == F.col("class_id")).alias("first"), F.count("*").alias("rows"))
    # ids that go, and ids that stand in several rows
    others = materialize(told.where(~F.col("first") | (F.col("rows") > 1)).select("other id", (F.col("rows") > 1).alias("several")), "join-others")
    several, nulls = others.where("several").limit(1).count() > 0, signed.where("id is null").limit(1).count() > 0
    if others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        others = F.broadcast(others)
    same = F.col(id_col) == F.col("other id")
    once = docs.where(F.col(id_col).isNotNull()).join(others, same, "left_anti")
    if not several and not nulls:
        return once
    unclear = docs.join(others.where("several"), same, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    return once.unionByName(_one_each(unclear, final, id_col=id_col, text_col=text_col, size=size))
