"""Groups of spelling variants: words one edit apart, found by dynamic programming over sorted word lists.

Words are put in order, and the length of the prefix that each shares with the one before (LCP) tells where a new prefix
begins. Rows of the edit matrix, three cells wide around the diagonal, are worked out once per prefix and asked word and
serve all words of the range that shares the prefix; where a prefix is more than one edit from an asked word, its range is
skipped for that word. Letter after letter, this is done for all ranges of a batch of lists and all asked words at once.

A list need not hold all words. One edit leaves the first or the second half of a word as it is, so words are dealt out
by either half, and the list of a half holds the words that share it. A list longer than ``SPLIT`` is dealt out again by
the halves of what is left of its words, and so on: no list depends on how many words share a beginning, and none is cut.

Defined cases: null texts have no words; a null ``doc_id`` is written as the empty text where words are cut; repeated
rows count again; an empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelfill.llm.common import SpanHasher, as_bytes, byte_values, runs, text_slices
from panelfill.sources.storage import stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5         # a form is at least so many times as frequent
CUT = 199         # one in so many words of a document loses a letter
SPLIT = 20_000    # words of a list
BATCH = 40_000    # words of lists that are scanned together
ASKED = 10_000    # words that are asked for at once
JUMPS = 6         # the count grows by RATIO with every step to a form, so 2^6 steps pass any 64-bit count
BLOCK = 8 << 20   # bytes of text whose words are counted at once
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def letter_runs(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a-z and U+00C0 to U+00FF in UTF-8."""
    lead = block == 0xC3
    letter = (block >= 0x61) & (block <= 0x7A) | lead
    letter[1:] |= lead[:-1] & (block[1:] >= 0x80) & (block[1:] < 0xC0)
    return runs(letter)


def counted_words(ids: list[str], texts: list[bytes], hasher: SpanHasher, values: np.ndarray, least: int, cut: int) -> Counter:
    """Counts of the words of some documents, after the cut.

    The checksum of ``<doc_id>:<word>`` is that of the word, moved by its length onto that of the beginning, so it costs a
    look at each distinct word and at each length in a document instead of one at each word of each document.
    """
    raw = b" ".join(texts).translate(LOWER) + b" "
    block = np.frombuffer(raw, np.uint8)
    starts, ends = letter_runs(block)
    size = ends - starts
    long = size >= least
    starts, ends, size = starts[long], ends[long], size[long]
    if not len(starts):
        return Counter()
    doc = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), starts, "right")
    hasher.load(block, values)
    _, where, word = np.unique(hasher.of(starts, ends), return_index=True, return_inverse=True)
    words = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
    check = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    # One number for each length in each document.
    pairs, pair = np.unique(doc << 32 | size, return_inverse=True)
    moved = np.empty(len(pairs), np.int64)
    seeds, zeros = {}, {}
    for i, p in enumerate(pairs.tolist()):
        d, n = p >> 32, p & 0xFFFFFFFF
        if d not in seeds:
            seeds[d] = zlib.crc32(f"{ids[d]}:".encode())
        if n not in zeros:
            zeros[n] = (blank := bytes(n), zlib.crc32(blank))
        moved[i] = zlib.crc32(zeros[n][0], seeds[d]) ^ zeros[n][1]
    h = moved[pair] ^ check[word]
    hit = h % cut == 0
    total = Counter(dict(zip(words, np.bincount(word[~hit], minlength=len(words)).tolist())))
    for i in np.flatnonzero(hit).tolist():
        whole = words[word[i]].decode()
        at = int(h[i]) % len(whole)
        total[(whole[:at] + whole[at + 1:]).encode()] += 1
    return total


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, cut: int = CUT) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``least`` letters that occur ``least_count`` times or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, values = SpanHasher(), byte_values(12)
        for batch in batches:
            ids, column = batch.column("_id").to_pylist(), batch.column("_text")
            for lo, hi in text_slices(column, BLOCK):
                texts = [raw or b"" for raw in as_bytes(column.slice(lo, hi - lo))]
                total = counted_words(ids[lo:hi], texts, hasher, values, least, cut)
                kept = [(w, n) for word, n in total.items() if n and len(w := word.decode()) >= least]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text").cast("string").alias("_text"))
    return (read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def common_prefixes(code: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Letters that each word shares with the one before; 0 where a list begins."""
    shared = np.zeros(len(size), np.int64)
    alive = np.flatnonzero(~new)
    depth = 0
    while len(alive):
        alive = alive[(size[alive] > depth) & (size[alive - 1] > depth)]
        alive = alive[code[at[alive] + depth] == code[at[alive - 1] + depth]]
        depth += 1
        shared[alive] = depth
    return shared


def one_edit(words: list[str], new: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (asked word, word of its list) of all pairs at an edit distance of exactly one.

    ``words`` are lists one after the other, each in order; ``new`` marks where a list begins, ``asked`` the words that
    are asked for.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(size) - size
    code = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.int32), 0)
    shared = common_prefixes(code, at, size, new)
    heads = np.flatnonzero(new)
    list_end = np.append(heads[1:], len(words))[np.cumsum(new) - 1]
    list_head = heads[np.cumsum(new) - 1]
    found = []
    for part in np.array_split(np.flatnonzero(asked), -(-int(asked.sum()) // ASKED) or 1):
        # A row at depth d holds the distances of a prefix of d letters to d - 1, d and d + 1 letters of the asked word;
        # 2 stands for more than one edit, also where there are not that many letters. [low, high) is the prefix's range.
        row = np.full((len(part), 3), 2, np.int8)
        row[:, 1] = 0
        row[size[part] >= 1, 2] = 1
        low, high = list_head[part], list_end[part]
        empty = np.flatnonzero((size[low] == 0) & (size[part] == 1))
        found.append((part[empty], low[empty]))
        depth = 0
        while len(part):
            begins = np.flatnonzero(new | (shared <= depth))  # where a prefix of depth + 1 letters, or a shorter word, begins
            first = np.searchsorted(begins, low)
            n = np.searchsorted(begins, high) - first
            ends = np.cumsum(n)
            old = np.repeat(np.arange(len(part)), n)
            place = first[old] + np.arange(len(old)) - (ends - n)[old]
            low, high = begins[place], np.append(begins[1:], len(words))[place]
            there = size[low] > depth
            old, low, high = old[there], low[there], high[there]
            part, before = part[old], row[old]
            letter, left = code[at[low] + depth], size[part]
            row = np.full((len(part), 3), 2, np.int8)
            for o in range(3):  # the asked word's first depth + o letters
                j = depth + o
                cost = np.full(len(part), 2, np.int8)
                if j:
                    cost = before[:, o] + (code[at[part] + np.minimum(j - 1, left)] != letter)
                if o < 2:
                    cost = np.minimum(cost, before[:, o + 1] + 1)
                if o:
                    cost = np.minimum(cost, row[:, o - 1] + 1)
                row[:, o] = np.where(left >= j, np.minimum(cost, 2), 2)
            depth += 1
            ended = np.flatnonzero(size[low] == depth)  # a word that is the prefix itself heads its range
            o = left[ended] - depth + 1
            inside = (o >= 0) & (o <= 2)
            ended, o = ended[inside], o[inside]
            hit = ended[row[ended, o] == 1]
            found.append((part[hit], low[hit]))
            go_on = row.min(axis=1) < 2
            part, row, low, high = part[go_on], row[go_on], low[go_on], high[go_on]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def halved(dealt: DataFrame) -> DataFrame:
    """Deal words out by the first and by the second half of what is left of them.

    ``key`` names the halves a list shares, ``at`` is where a word's rest begins and ``size`` the length of the rest of
    the shorter word of a pair; ``extra`` is 1 for words that take part as the longer one.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    tail = F.col("size") - half
    first = F.struct(F.concat("key", F.lit("<"), F.substr("word", F.col("at"), half)).alias("key"), (F.col("at") + half).alias("at"), tail.alias("size"))
    second = F.struct(F.concat("key", F.lit(">"), F.substr("word", F.col("at") + half + F.col("extra"), tail)).alias("key"),
                      F.col("at").alias("at"), half.alias("size"))
    return dealt.select("word", "extra", F.explode(F.array(first, second)).alias("_h")).select("_h.key", "word", "extra", "_h.at", "_h.size")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each list; rows come sorted by list, then by the rest of the word."""
    def pairs(keys: list[str], words: list[str], extra: list[int], rests: list[str]) -> Iterator[pa.RecordBatch]:
        new = np.array([True] + [a != b for a, b in zip(keys, keys[1:])])
        longer = np.array(extra, bool)
        a, b = one_edit(rests, new, ~longer)
        # Words of equal length are asked for from either side; the longer ones only by the shorter.
        back = longer[b]
        name = np.array(words, object)
        for lo in range(0, len(a), 1 << 16):
            x, y, z = (v[lo:lo + (1 << 16)] for v in (a, b, back))
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.concatenate([name[x], name[y[z]]]), pa.string()),
                                              "near": pa.array(np.concatenate([name[y], name[x[z]]]), pa.string())})

    held: tuple[list, ...] = ([], [], [], [])
    for batch in batches:
        for h, c in zip(held, ("key", "word", "extra", "rest")):
            h += batch.column(c).to_pylist()
        if len(held[0]) > BATCH:
            whole = len(held[0])
            while whole and held[0][whole - 1] == held[0][-1]:
                whole -= 1
            if whole:  # the last list may go on in the next batch
                yield from pairs(*[h[:whole] for h in held])
                held = tuple(h[whole:] for h in held)
    if held[0]:
        yield from pairs(*held)


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """``word`` and ``near``: all pairs of different words one edit apart, in both directions. ``words`` holds each word once."""
    asked = words.where(F.length("word") > 0).select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))
    dealt = asked.select((F.length("word") - F.col("extra")).alias("size"), "word", "extra", F.lit(1).alias("at"))
    dealt = halved(dealt.withColumn("key", F.col("size").cast("string")))
    done = []
    while True:
        # Lists whose words have nothing left to halve hold one letter each at most: as many words as there are letters.
        dealt = stored(dealt, "word-lists")
        long = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("size").alias("_left"))
                      .where((F.col("_n") > split) & (F.col("_left") > 1)).select("key"), "long-lists")
        if long.isEmpty():
            done.append(dealt)
            break
        done.append(dealt.join(long, "key", "left_anti"))
        dealt = halved(dealt.join(long, "key", "left_semi"))
    lists = done[0]
    for d in done[1:]:
        lists = lists.unionByName(d)
    rest = F.substr("word", F.col("at"), F.col("size") + F.col("extra"))
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (lists.select("key", "word", "extra", rest.alias("rest")).repartition(partitions, "key")
             .sortWithinPartitions("key", "rest").mapInArrow(_scan, "word string, near string"))
    return found.distinct()


def with_forms(words: DataFrame, split: int = SPLIT, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of a vocabulary (``word``, ``n``).

    A word's form is its most frequent near word if that is ``ratio`` times as frequent; roots follow forms to the end.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    counted = near_words(words, split).join(words.select(F.col("word").alias("near"), F.col("n").alias("_m")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_m")).alias("m"), "near")).alias("_best"))
    is_form = -F.col("_best.m") >= ratio * F.col("n")
    judged = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("_best.near")).alias("form"), F.when(is_form, -F.col("_best.m")).alias("form_n")), "forms")
    # Words that have a form point at it; each round points twice as far.
    steps = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        steps = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
        if steps.join(ahead.select("root"), "root", "left_semi").isEmpty():
            break
    return judged.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
