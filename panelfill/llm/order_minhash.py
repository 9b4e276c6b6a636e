"""Near duplicates by order-preserving min-hash sketches and banded alignment.

Words are those of ``decontaminate``: lower-case letters, digits and non-ASCII characters. A document is the sequence of
its five-word shingles (one shingle of all words if there are fewer). Equal shingles are told apart by the number of
their occurrence. Each of ``SKETCHES`` hash functions picks the ``PICKED`` smallest labelled shingles of a document and
keeps them in text order; the hash of that tuple is a bucket key, which texts share the more likely the smaller their
edit distance. Texts of at most ``SHORT`` shingles also get exact keys, their sequence with each choice of shingles left out
that the threshold allows, so that of two such texts no pair is lost. Texts that share a key are aligned: similarity is the number of aligned shingles M of the best alignment
in a band wide enough for the threshold, M / (n + m - M). Links are similarities of 0.8 or more, classes their
connected components.

Within a bucket texts are first compared with one of them only. Buckets that then hold several classes are compared
exhaustively, so no candidate of another class is left out. Pairs of one class are never listed. Buckets of more than
``WIDE`` rows are compared in tiles: a matrix product counts the shingles that each pair of texts shares, at most that many
can be aligned, and only pairs that reach the threshold by this bound and are of two classes yet are aligned. A pair of tiles
gives no more links than it has texts, so the rows that are made do not grow with the square of a bucket.

Defined cases: texts without words (null, empty, signs only) form one class; equal word sequences are one text for all
comparisons; a class is named after its smallest ``doc_id``, null if it has none; an empty table gives an empty table;
other columns are carried where documents are returned.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelfill.llm.common import as_bytes, mixed, text_slices, windows_of
from panelfill.llm.components import components, packed
from panelfill.llm.decontaminate import Scanner, LOWER
from panelfill.sources.storage import stored

BLOCK = 1 << 20
SHINGLE = 5
SKETCHES = 24
PICKED = 5
THRESHOLD = 0.8
SHORT = 12  # texts of at most so many shingles have exact keys
# The places kept when 0, 1, ... shingles are left out, by the number of shingles; M of n are M / n similar
KEPT = {n: [np.array(list(combinations(range(n), n - i))) for i in range(n // 5 + 1)] for n in range(4, SHORT + 1)}
AGREEMENT = 0.6  # share of equal picks below which a pair is not aligned; at the threshold it is 0.83, deviating by 0.03
SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SKETCH = T.StructType([T.StructField("_digest", T.BinaryType()), T.StructField("_shingles", T.LongType()),
                       T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_parts", T.ArrayType(T.LongType())),
                       T.StructField("_even", T.ArrayType(T.LongType())), T.StructField("_picks", T.ArrayType(T.IntegerType()))])
PAIRS = 2000  # that a task aligns; fewer tasks than partitions where pairs are few
LISTS = 20_000  # rows of picks in one partition
BITS = 1 << 26  # of the bitmap that keeps most unwanted texts from being moved; 8 MB at any size of the corpus
WIDE = 16  # rows of a bucket up to which its pairs are listed
TILE, TILE_SHINGLES = 2048, 1 << 20  # rows and shingles of one tile of a wider bucket
COLUMNS = 4096  # shingles counted by one matrix product
ROW = ["_k1", "_k2"]  # hashes that name a row by its id and text


def shingles_of(texts: list[bytes], scanner: Scanner) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes of all texts in a row, where each text's begin (one more at the end), and digests of the words."""
    block = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    hashes, starts, ends = scanner._words(block)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    raw, out = hashes.tobytes(), []
    digests = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
    full = windows_of(hashes, SHINGLE)
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append(full[a:b - SHINGLE + 1] if b - a >= SHINGLE else windows_of(hashes[a:b], b - a) if b > a else full[:0])
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]), digests


def labelled(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tell equal shingles of a text apart by the number of their occurrence."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((shingles, text))
    new = np.ones(len(order), bool)
    new[1:] = (shingles[order][1:] != shingles[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.flatnonzero(new)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = (np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))).astype(np.uint64)
    return mixed(shingles + occurrence * np.uint64(0xA0761D6478BD642F))


def sketches(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (texts x SKETCHES) and picks (texts x SKETCHES * PICKED) of texts that have shingles."""
    marks, count, n = labelled(shingles, bounds), len(bounds) - 1, np.diff(bounds)
    keys, picks = np.zeros((count, SKETCHES), np.uint64), np.zeros((count, SKETCHES, PICKED), np.uint64)
    top = np.uint64(2 ** 64 - 1)
    for s in range(SKETCHES):
        hashes = mixed(marks ^ SEEDS[s])
        found, place = np.zeros((count, PICKED), np.uint64), np.full((count, PICKED), 1 << 62)
        for k in range(PICKED):
            least = np.minimum.reduceat(hashes, bounds[:-1])
            at = np.flatnonzero(hashes == np.repeat(least, n))
            text = np.searchsorted(bounds, at, "right") - 1
            text, first = np.unique(text, return_index=True)
            own = (least[text] != top)
            found[text[own], k], place[text[own], k] = least[text[own]], at[first[own]]
            hashes[at[first]] = top
        ordered = np.take_along_axis(found, np.argsort(place, 1, kind="stable"), 1)
        key = np.full(count, SEEDS[s])
        for k in range(PICKED):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + ordered[:, k])
        keys[:, s], picks[:, s] = key, found
    return keys, picks.reshape(count, -1)


def exact_keys(shingles: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Exact keys of short texts at the threshold 0.8, none for others. ``parts``: the key of the whole sequence, then those
    with some shingles left out; two texts are similar if the whole of one is a part of the other. ``even``: keys with one
    of at least nine left out, at which all texts that share one are similar. Other ways to be similar need 13 shingles."""
    n, none = np.diff(bounds), np.zeros(0, np.uint64)
    parts, even = [none] * len(n), [none] * len(n)
    for size, choices in KEPT.items():
        at = np.flatnonzero(n == size)
        if not len(at):
            continue
        own, made = shingles[bounds[at][:, None] + np.arange(size)], []
        for kept in choices:
            key = np.full((len(at), len(kept)), kept.shape[1], np.uint64)
            for place in kept.T:
                key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + own[:, place])
            made.append(key)
        for text, keys in zip(at, np.concatenate(made, 1)):
            parts[text] = keys
        if size > 8:
            for text, keys in zip(at, mixed(made[1] ^ SEEDS[0])):
                even[text] = keys
    return parts, even


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(values))


def sketched(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The ``wanted`` columns of the documents or of ``SKETCH``: digest of the words, number of shingles, bucket keys, exact
    keys and picked hashes."""
    carried = [c for c in wanted if c not in SKETCH.names]
    made = [c for c in wanted if c in SKETCH.names]
    read = docs.select(*dict.fromkeys([*carried, "text"]))
    schema = T.StructType([*[read.schema[c] for c in carried], *[SKETCH[c] for c in made]])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner({})
        for batch in batches:
            for lo, hi in text_slices(batch.column("text"), BLOCK):
                part = batch.slice(lo, hi - lo)
                shingles, bounds, digests = shingles_of([t or b"" for t in as_bytes(part.column("text"))], scanner)
                some = np.flatnonzero(np.diff(bounds))
                keys, picks = sketches(shingles, bounds[np.append(some, len(bounds) - 1)]) if len(some) else (np.zeros((0, SKETCHES)),) * 2
                size = np.zeros(len(digests), np.int64)
                size[some] = 1
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size * width)]).astype(np.int32)), pa.array(values))
                         for width, values in ((SKETCHES, keys.astype(np.uint64).view(np.int64).ravel()),
                                               (SKETCHES * PICKED, picks.astype(np.uint64).astype(np.uint32).view(np.int32).ravel()))]
                exact = [_lists(rows) for rows in exact_keys(shingles, bounds)]
                own = dict(zip(SKETCH.names, [pa.array(digests, pa.binary()), pa.array(np.diff(bounds)), lists[0], *exact, lists[1]]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], *[own[c] for c in made]], [*carried, *made])

    return read.mapInArrow(sketch, schema)


def aligned(a: list[int], b: list[int], threshold: float) -> float:
    """Similarity of two shingle sequences from the best alignment within the band that the threshold allows; 0 if it
    cannot reach the threshold."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    need = threshold / (1 + threshold) * (len(a) + len(b))  # M / (n + m - M) >= threshold
    head = 0
    for x, y in zip(a, b):
        if x != y:
            break
        head += 1
    tail, most = 0, min(len(a), len(b)) - head
    while tail < most and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    p, q = a[head:len(a) - tail], b[head:len(b) - tail]
    if head + tail + sum((Counter(p) & Counter(q)).values()) < need - 1e-9:
        return 0.0
    band, where = int(len(a) + len(b) - 2 * need) + 1, {}
    for i, x in enumerate(p):
        where[x] = where.get(x, 0) | 1 << i
    full, window = (1 << len(p)) - 1, (1 << 2 * band + 1) - 1
    free = full  # one bit per place of p, cleared along the best alignment so far
    for j, y in enumerate(q):
        hit = where.get(y)
        if hit:
            near = window << j - band if j >= band else window >> band - j
            step = free & hit & near
            free = (free + step | free - step) & full
    matched = head + tail + len(p) - free.bit_count()
    return matched / (len(a) + len(b) - matched)


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float, slim: DataFrame | None = None) -> DataFrame:
    """The pairs ``a``-``b`` whose texts reach the threshold. Cheap bounds come first: lengths, then shared picks; with
    ``slim``, the texts' rows without the texts, they are tested before any text is moved."""
    sides = [texts.select(F.col("_digest").alias(s), *[F.col(c).alias(f"_{s}{c}") for c in ("text", "_shingles", "_picks")]) for s in "ab"]
    likely = ((F.least("_a_shingles", "_b_shingles") >= threshold * F.greatest("_a_shingles", "_b_shingles"))
              & (F.size(F.array_intersect("_a_picks", "_b_picks")) >= AGREEMENT * F.size(F.array_distinct("_a_picks"))))
    if slim is not None:
        bare = [slim.select(F.col("_digest").alias(n), *[F.col(c).alias(f"_{n}{c}") for c in ("_shingles", "_picks")]) for n in "ab"]
        pairs = packed(pairs.join(bare[0], "a").join(bare[1], "b").where(likely).select("a", "b"), "pairs")
        likely = F.lit(True)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, last = Scanner({}), (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i in range(len(a)):
                if last[0] != b[i]:
                    last = b[i], shingles_of([batch.column("_tb")[i].as_py().encode()], scanner)[0].tolist()
                own = shingles_of([batch.column("_ta")[i].as_py().encode()], scanner)[0].tolist()
                if aligned(own, last[1], threshold) >= threshold:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.binary()) for x in (a, b)], ["a", "b"])

    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS))
    return (pairs.join(sides[0], "a").join(sides[1], "b").where(likely)
            .select("a", "b", F.col("_atext").alias("_ta"), F.col("_btext").alias("_tb")).coalesce(tasks).mapInArrow(align, "a binary, b binary"))


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted rows, which are distinct. A bitmap of hashes, of at most ``BITS`` bits and therefore broadcast, lets all wanted
    rows and few others pass before texts are moved."""
    bit = F.pmod("_k1", F.lit(BITS)) + 1
    bitmap = (wanted.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")))
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    likely = (docs.select("text", *ROW, bit.alias("_bit")).withColumn("_bucket", F.bitmap_bucket_number("_bit"))
              .join(F.broadcast(bitmap), "_bucket").where(F.getbit(byte, (place % 8).cast("int")) == 1))
    # A semi-join would be moved before the bitmap. Rows that are there several times give one text.
    return likely.join(wanted, ROW).groupBy(*ROW).agg(F.first("text").alias("text")).select("text")


def classes(docs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node`` (a digest) and ``class`` (the smallest digest of its component) of every text that is linked to another.

    ``docs`` are the named documents, ``texts`` a written table with one row for each digest. Only texts that share a key
    are read again, and only then are their picks made.
    """
    keyed = texts.select("_digest", F.explode(F.array_distinct(F.concat("_keys", "_even"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = packed(keyed.join(shared, "key"), "buckets")
    parts = buckets.rdd.getNumPartitions()
    hubs = buckets.groupBy("key").agg(F.min("_digest").alias("hub"))
    whole = texts.where(F.size("_parts") > 0).select(F.get("_parts", F.lit(0)).alias("key"), F.col("_digest").alias("hub"))
    without = texts.select("_digest", F.explode(F.array_distinct(F.slice("_parts", 2, SHORT * SHORT))).alias("key"))
    held = packed(without.join(whole, "key").select(F.greatest("_digest", "hub").alias("a"), F.least("_digest", "hub").alias("b")), "held").distinct()
    used = buckets.select("_digest").union(held.select("a")).union(held.select("b")).coalesce(parts).distinct()
    wanted = packed(texts.select("_digest", "_least").join(used, "_digest", "left_semi")
                    .select(*[F.col(f"_least.{k}").alias(k) for k in ROW]), "wanted")
    own = stored(sketched(_rows_of(docs, wanted), ["text", "_digest", "_shingles", "_picks"]), "texts")
    tested = buckets.join(hubs, "key").where("_digest <> hub").select(F.col("_digest").alias("a"), F.col("hub").alias("b"))
    tested = packed(tested.union(held).coalesce(parts).distinct(), "tested")
    slim = packed(own.select("_digest", "_shingles", "_picks"), "picks", LISTS)
    links = packed(_similar(tested, own, threshold), "similar")
    found = components(links)
    apart = _apart(buckets, found)
    wide = apart.where(F.col("n") > WIDE)
    if wide.limit(1).count():
        links = packed(links.union(_wide_links(wide, own, slim, threshold)), "similar")
        found = components(links)
        apart = _apart(buckets, found)
    narrow = apart.where(F.col("n") <= WIDE)
    others = narrow.select("key", F.col("_digest").alias("hub"), F.col("class").alias("_other"))
    pairs = narrow.where("class <> main").join(others, "key").where(F.col("class") != F.col("_other"))
    fresh = pairs.select(F.greatest("_digest", "hub").alias("a"), F.least("_digest", "hub").alias("b")).distinct()
    fresh = packed(fresh.join(tested, ["a", "b"], "left_anti"), "fresh")
    more = packed(_similar(fresh, own, threshold, slim), "links")
    return components(packed(links.union(more), "similar")) if more.limit(1).count() else found


def _apart(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several classes, with the class of each, the largest of its bucket (``main``) and
    the number of the bucket's rows (``n``)."""
    placed = buckets.join(found, buckets["_digest"] == found["node"], "left").select(
        "key", "_digest", F.coalesce("class", "_digest").alias("class"))
    groups = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return packed(placed.join(main.where("k > 1").drop("k"), "key"), "apart")


def shared_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of marks that each of ``a`` shares with each of ``b``; marks of one text are distinct."""
    flat = [np.concatenate(side) for side in (a, b)]
    text = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (a, b)]
    known, out = np.intersect1d(*flat), np.zeros((len(a), len(b)), np.float32)
    if not len(known):
        return out
    place = [np.minimum(np.searchsorted(known, x), len(known) - 1) for x in flat]
    for i in range(2):
        held = np.flatnonzero(known[place[i]] == flat[i])
        held = held[np.argsort(place[i][held], kind="stable")]
        place[i], text[i] = place[i][held], text[i][held]
    for lo in range(0, len(known), COLUMNS):
        sides = []
        for i, side in enumerate((a, b)):
            part = slice(*np.searchsorted(place[i], [lo, lo + COLUMNS]))
            sides.append(np.zeros((len(side), min(COLUMNS, len(known) - lo)), np.float32))
            sides[i][text[i][part], place[i][part] - lo] = 1
        out += sides[0] @ sides[1].T
    return out


def tile_links(texts: list[bytes], own: np.ndarray, loose: np.ndarray, threshold: float, scanner: Scanner) -> list[tuple[int, int]]:
    """Links between the ``loose`` texts and the others, enough to join all that are linked; ``own`` are the classes so far."""
    shingles, bounds, _ = shingles_of(texts, scanner)
    marks = labelled(shingles, bounds)
    rows, n, own = [np.flatnonzero(loose), np.flatnonzero(~loose)], np.diff(bounds), own.copy()
    if not len(rows[0]) or not len(rows[1]):
        return []
    shared = shared_shingles(*[[marks[bounds[i]:bounds[i + 1]] for i in side] for side in rows])
    likely = shared >= threshold / (1 + threshold) * (n[rows[0]][:, None] + n[rows[1]][None, :]) - 1e-6
    links = []
    for at, i in enumerate(rows[0]):
        open_ = np.flatnonzero(likely[at] & (own[rows[1]] != own[i]))
        open_ = open_[np.argsort(-shared[at][open_], kind="stable")]
        one = shingles[bounds[i]:bounds[i + 1]].tolist() if len(open_) else []
        while len(open_):
            j, open_ = rows[1][open_[0]], open_[1:]
            if aligned(shingles[bounds[j]:bounds[j + 1]].tolist(), one, threshold) >= threshold:
                links.append((i, j))
                own[own == own[j]] = own[i]
                open_ = open_[own[rows[1][open_]] != own[i]]
    return links


def _wide_links(wide: DataFrame, own: DataFrame, slim: DataFrame, threshold: float) -> DataFrame:
    """Links ``a``-``b`` between the classes of wide buckets. Texts outside a bucket's largest class (loose ones) meet all
    of its texts, tile by tile; where one tile holds the loose ones, the others are moved once."""
    rows = wide.withColumn("_loose", F.col("class") != F.col("main"))

    def tiles(some: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(some) / TILE, F.sum(F.when(some, F.col("_shingles"))) / TILE_SHINGLES, F.lit(1)))

    sizes = rows.join(slim.select("_digest", "_shingles"), "_digest").groupBy("key").agg(tiles(F.lit(True)).alias("_all"), tiles(F.col("_loose")).alias("_few"))
    # Texts come last, by their digests, so that those of one bucket are not brought together before they are in tiles.
    rows, h = packed(rows.join(sizes, "key"), "tiles").join(own.select("_digest", "text"), "_digest"), F.xxhash64("_digest")
    carried = ["_digest", "class", "text"]
    sides = [rows.where("_loose").select("key", F.pmod(h, "_few").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("_j"), F.lit(True).alias("_first"), *carried),
             rows.select("key", F.explode(F.sequence(F.lit(0), F.col("_few") - 1)).alias("_i"), F.pmod(h, "_all").alias("_j"), F.lit(False).alias("_first"), *carried)]

    def link(table: pa.Table) -> pa.Table:
        names, classes_ = table.column("_digest").to_pylist(), table.column("class").to_pylist()
        numbers = {c: i for i, c in enumerate(dict.fromkeys(classes_))}
        texts = [t.encode() for t in table.column("text").to_pylist()]
        links = tile_links(texts, np.array([numbers[c] for c in classes_]), table.column("_first").to_numpy(), threshold, Scanner({}))
        return pa.table([pa.array([names[p[i]] for p in links], pa.binary()) for i in range(2)], ["a", "b"])

    return sides[0].union(sides[1]).groupBy("key", "_i", "_j").applyInArrow(link, "a binary, b binary").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _named(docs: DataFrame) -> DataFrame:
    """The documents' texts, ids and the hashes that name their rows; all columns of a row as ``_row``."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text.alias("text"),
                       F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("_k2"))


def _classified(docs: DataFrame, rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketched ``rows`` of the named documents, and each digest with its class, the smallest id of the class, the
    digest that is kept of it and the row with the smallest id of the digest."""
    sketch = stored(sketched(rows, [*[c for c in rows.columns if c != "text"], "_digest", "_shingles", "_keys", "_parts", "_even"]), "sketch")
    texts = stored(sketch.groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", *ROW)).alias("_least"),
                                                 *[F.first(c).alias(c) for c in ("_keys", "_parts", "_even")]), "digests")
    found = classes(docs, texts, threshold)
    linked = packed(texts.select("_digest", "_least").join(found, F.col("_digest") == F.col("node")).select("_digest", "_least", "class"), "linked")
    kept = linked.groupBy("class").agg(F.min("_least._id").alias("class_id"), F.min_by("_digest", F.struct("_least", "_digest")).alias("_kept"))
    several = packed(linked.join(kept, "class").select("_digest", "class_id", "_kept"), "several")
    alone = F.col("_kept").isNull()  # of a text that is linked to no other
    return sketch, texts.select("_digest", "_least").join(several, "_digest", "left").select(
        "_digest", "_least", F.when(alone, F.col("_least._id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("_kept", "_digest").alias("_kept"))


def with_class(docs: DataFrame, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """The documents with ``class_id``, the smallest ``doc_id`` of the near duplicates of each, in place of a column of
    that name. ``columns`` are those to return, all by default."""
    docs = _named(docs)
    names = [c for c in columns or docs.schema["_row"].dataType.names if c != "class_id"]
    rows = docs.withColumn("_row", F.struct(*[F.col(f"_row.`{c}`") for c in names]))
    sketch, named = _classified(docs, rows, threshold)
    return sketch.join(named.select("_digest", "class_id"), "_digest").select("_row.*", "class_id")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest ``doc_id``; repeated rows of it count once."""
    docs = _named(docs)
    _, named = _classified(docs, docs.drop("_row"), threshold)
    kept = named.where(F.col("_digest") == F.col("_kept")).select(*[F.col(f"_least.{k}").alias(k) for k in ROW])
    return docs.select("_row", *ROW).join(stored(kept, "kept"), ROW).groupBy(*ROW).agg(F.min("_row").alias("_row")).select("_row.*")
