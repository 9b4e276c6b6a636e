"""Byte-pair encoding and decoding with a transducer of frequent words.

Frequent words, counted over all documents, are compiled with their token ids into a minimal acyclic automaton:
words share suffixes, the numbers on a word's arcs add up to the place of its ids, and the arcs are plain sorted arrays
that every worker maps into memory. Words that the automaton does not accept are merged exactly by the vocabulary's
merge rules. Decoding joins the bytes of the ids.

Defined cases: a null text is an empty one with no ids and decodes to an empty text; equal rows give equal results;
an empty table gives an empty table; the strings of special tokens in a text become their ids, as the library does
it; other columns are carried. Which words are in the automaton changes the speed, never the result.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelfill.llm.common import text_slices
from panelfill.llm.pretokens import BLOCK, Splitter, byte_letters, encoder, ragged, release
from panelfill.sources.storage import stored

VOCABULARY = "byte_bpe_50k.json"
LEXICON_WORDS = 1 << 16
MAX_WORD = 64


class Lexicon:
    """Minimal acyclic automaton over the bytes of words; accepted words yield their ids."""

    PARTS = (("arcs", np.int64), ("targets", np.int32), ("skips", np.int32), ("final", np.uint8), ("bounds", np.int64), ("ids", np.int32))

    def __init__(self, **parts: np.ndarray):
        self.parts = parts

    @classmethod
    def compiled(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Build from words and their ids: sorted words one by one, equal right-hand sides are shared as they close."""
        words, shared = sorted(entries), {}
        arcs: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        path, last = [0], b""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                same = shared.setdefault((ends[state], tuple(arcs[state].items())), state)
                arcs[path[-1]][last[len(path) - 1]] = same

        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            close(common)
            for byte in word[common:]:
                arcs.append({})
                ends.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            ends[path[-1]], last = True, word
        close(0)
        below: dict[int, int] = {}
        numbered: dict[int, int] = {}
        todo = [(0, False)]
        while todo:  # number of words below each state, children first
            state, ready = todo.pop()
            if ready:
                below[state] = ends[state] + sum(below[t] for t in arcs[state].values())
            elif state not in numbered:
                numbered[state] = len(numbered)
                todo.append((state, True))
                todo += [(t, False) for t in arcs[state].values() if t not in numbered]
        rows = []
        for state, number in numbered.items():
            skip = int(ends[state])
            for byte, target in sorted(arcs[state].items()):
                rows.append((number << 8 | byte, numbered[target], skip))
                skip += below[target]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(numbered), np.uint8)
        final[[numbered[s] for s in numbered if ends[s]]] = 1
        sizes = [len(entries[w]) for w in words]
        return cls(arcs=table[:, 0], targets=table[:, 1].astype(np.int32), skips=table[:, 2].astype(np.int32), final=final,
                   bounds=np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                   ids=np.array([x for w in words for x in entries[w]], np.int32))

    def packed(self) -> bytes:
        head = np.array([len(self.parts[n]) for n, _ in self.PARTS], np.int64).tobytes()
        return head + b"".join(self.parts[n].astype(t).tobytes() for n, t in self.PARTS)

    @classmethod
    def mapped(cls, packed: bytes) -> Lexicon:
        """Arrays over a memory map of a file that leaves no name behind."""
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(view, np.int64, len(cls.PARTS))
        at, parts = sizes.nbytes, {}
        for (name, kind), size in zip(cls.PARTS, sizes.tolist()):
            parts[name] = np.frombuffer(view, kind, size, at)
            at += parts[name].nbytes
        return cls(**parts)

    def ids_of(self, words: list[str]) -> list[list[int] | None]:
        """Ids of each word, None where the automaton does not accept it. All words step through it together."""
        raw = [w.encode() for w in words]
        text = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        state, place = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        arcs, targets, skips = (self.parts[n] for n in ("arcs", "targets", "skips"))
        alive = np.flatnonzero((size <= MAX_WORD) & (size > 0)) if len(arcs) else np.zeros(0, np.int64)
        accepted = []
        for step in range(MAX_WORD + 1):
            done = size[alive] == step
            over = alive[done]
            accepted.append(over[self.parts["final"][state[over]] == 1])
            alive = alive[~done]
            if not len(alive):
                break
            key = state[alive] << 8 | text[start[alive] + step]
            arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            hit = arcs[arc] == key
            alive, arc = alive[hit], arc[hit]
            state[alive] = targets[arc]
            place[alive] += skips[arc]
        out: list[list[int] | None] = [None] * len(raw)
        bounds, ids = self.parts["bounds"], self.parts["ids"]
        for i in np.concatenate(accepted).tolist() if accepted else ():
            out[i] = ids[bounds[place[i]]:bounds[place[i] + 1]].tolist()
        return out


def frequent_words(docs: DataFrame, size: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words of all documents, under the vocabulary's word rule.

    Each task counts all its words and hands over the 2 * size most frequent, so what is gathered is bounded by the
    number of tasks; a word that is frequent overall is frequent in some task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, hashes, counts, words = Splitter(spaced=True), np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for batch in batches:
            column = batch.column("text")
            for lo, hi in text_slices(column, BLOCK):
                texts = [t for t in column.slice(lo, hi - lo).to_pylist() if t and splitter.simple(t)]
                block = "\0".join(texts) + "\0"
                if not splitter.sure(splitter.codes(block)):  # texts with a doubtful character go to the library whole
                    block = "\0".join(t for t in texts if splitter.sure(splitter.codes(t))) + "\0"
                starts, ends, found = splitter.words(splitter.codes(block))
                own, where, n = np.unique(found, return_index=True, return_counts=True)
                hashes, back = np.unique(np.concatenate([hashes, own]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(hashes)).astype(np.int64)
                if len(hashes) > 16 * size:  # keep the more frequent half of what was seen
                    top = np.sort(np.argsort(-counts, kind="stable")[:8 * size])
                    hashes, counts = hashes[top], counts[top]
                for h, i in zip(own.tolist(), where.tolist()):
                    if h not in words and ends[i] - starts[i] <= MAX_WORD:
                        words[h] = block[starts[i]:ends[i]]
                if len(words) > 32 * size:
                    words = {h: w for h in hashes.tolist() if (w := words.get(h)) is not None}
        top = np.argsort(-counts, kind="stable")[:2 * size]
        found = Counter({words[h]: c for h, c in zip(hashes[top].tolist(), counts[top].tolist()) if h in words})
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def compiled_lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = LEXICON_WORDS) -> bytes:
    """The packed automaton of at most ``size`` words; its size is bounded by ``size`` and not by the documents."""
    words = [r["word"] for r in stored(frequent_words(docs, size), "words").select("word").collect()]
    own = encoder(vocabulary, spaced=True)
    raw = [w.encode() for w in words]
    return Lexicon.compiled({w: i for w, i in zip(raw, own._encode_words(words)) if len(w) <= MAX_WORD}).packed()


def with_ids(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = LEXICON_WORDS, decode: bool = False) -> DataFrame:
    """The documents with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers), and with ``decoded``,
    the text made of these ids, if asked for."""
    spark = docs.sparkSession
    lexicon = compiled_lexicon(docs, vocabulary, size)
    packed, key = spark.sparkContext.broadcast(lexicon), hashlib.sha256(lexicon).hexdigest()
    kept = [f for f in docs.schema.fields if f.name not in ("n_tokens", "ids", "decoded")]
    names = [f.name for f in kept]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType(kept + added[:2 + decode])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, True, key, lambda: Lexicon.mapped(packed.value))
        back = Decoder(vocabulary) if decode else None
        for batch in batches:
            at = 0
            for sizes, ids in own.encode(batch.column("text")):
                raw = packed_lists(sizes, ids.astype("<u4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, len(sizes)) for c in names] + [pa.array(sizes.astype(np.int64)), raw]
                    + ([back.texts(sizes, ids)] if decode else []), schema=pa_schema(batch, names, decode))
                at += len(sizes)
        del own, back
        release()  # workers outlive their tasks, and later stages need the memory

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(encode, schema)


def pa_schema(batch: pa.RecordBatch, names: list[str], decode: bool) -> pa.Schema:
    added = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary()), pa.field("decoded", pa.string())]
    return pa.schema([batch.schema.field(n) for n in names] + added[:2 + decode])


def packed_lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary value for each range of consecutive numbers."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


class Decoder:
    """Texts from ids; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        letters = byte_letters()[1]
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def texts(self, sizes: np.ndarray, ids: np.ndarray) -> pa.Array:
        raw = self.bytes[ragged(self.start[ids], self.size[ids])].tobytes()
        per_text = np.concatenate([[0], np.cumsum(self.size[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist())], pa.string())


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``."""
    names = [c for c in tokens.columns if c != "decoded"]
    schema = T.StructType([tokens.schema[n] for n in names] + [T.StructField("decoded", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(vocabulary)
        for batch in batches:
            raw = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()]
            raw = [x[x < len(own.size)] for x in raw]
            texts = own.texts(np.array([len(x) for x in raw], np.int64), np.concatenate([*raw, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, "decoded"])

    return tokens.select(*[f"`{n}`" for n in names]).mapInArrow(decode, schema)
