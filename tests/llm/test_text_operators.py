"""Text operators against brute force on small odd tables: nulls, empty and long texts, repeated rows, extra columns."""

import collections
import hashlib
import random
import re
import struct
import zlib

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelfill.llm import (
    chat, components, decontaminate, lexicon_bpe, line_crf, order_minhash, pii, quality_rules, suffix_levels, token_files, url_rules)
from panelfill.sources.storage import scratch_path

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [a + b for a in ("ba", "ré", "to", "Li", "x") for b in ("n", "ss", "ë", "mo", "", "q9")]
    free = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, long = free(120), free(6000)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one two", base, base, " ".join(near), base + " " + PASSAGE + ".", "Mail a.b@c-d.org, call +1 (555) 010-9999!",
             "card 4111 1111 1111 1111 and ip 10.0.0.255 or 300.1.1.1", long, long + " tail", PASSAGE.upper(), "it's <|endoftext|> İ  x\u00a0y", "a\n\na\nb\n" * 9,
             " ".join(["same"] * 60), "日本語 text 混ざる", "###$$$ !!!" * 20]
    return [(i, t, "en", f"s{i % 2}", i) for i, t in enumerate(texts)] + [(None, base, "en", "s", 1), (4, base, "en", "s0", 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({"score": F.lit("clash"), "ids": F.lit("clash"), "key": F.lit(1)}).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (10, PASSAGE + " upsilon"), (2, "one two"), (3, None), (4, "..."), (1, PASSAGE)], "item_id long, text string")


def test_decontamination(docs, bench, rows):
    own = collections.defaultdict(set)
    for item, text in ((1, PASSAGE), (10, PASSAGE + " upsilon"), (2, "one two")):
        w = words(text)
        for i in range(max(1, len(w) - 12)):
            own[tuple(w[i:i + 13])].add(str(item))
    want = collections.Counter()
    for doc, text, *_ in rows:
        w, hit, items = words(text), set(), set()
        for size in {len(k) for k in own}:
            for i in range(len(w) - size + 1):
                if (found := own.get(tuple(w[i:i + size]))):
                    hit |= set(range(i, i + size))
                    items |= found
        want[doc, len(w), len(hit), tuple(sorted(items))] += 1
    for max_bytes in (1 << 28, 600):  # one broadcast, and several parts
        got = decontaminate.find_passages(docs, bench, max_bytes=max_bytes).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    clean = decontaminate.without_spans(docs, bench).where("doc_id = 7").first().text
    assert "omicron" not in clean and clean.endswith(".")
    assert decontaminate.find_passages(docs.limit(0), bench).count() == 0
    assert decontaminate.without_documents(docs, bench.limit(0)).count() == len(rows)


def test_repeats(docs, rows):
    order = sorted((r[:2] for r in rows), key=lambda r: (r[0] is None, r[0]))
    first, want = {}, collections.Counter()
    for doc, text in order:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i:i + 50], 1e9 if doc is None else doc)
    for doc, text in order:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first[raw[i:i + 50]] < (1e9 if doc is None else doc):
                gone[i:i + 50] = [True] * 50
        want[doc, len(raw), bytes(b for b, g in zip(raw, gone) if not g)] += 1
    got = suffix_levels.without_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == want
    assert suffix_levels.without_repeats(docs.limit(0)).count() == 0


def test_levels_merge_geometrically():
    import numpy as np
    levels = suffix_levels.Levels()
    for i in range(7):
        levels.add(np.array([i, 100 + i], np.uint64), np.array([i, i], np.int64))
    assert [s for s, *_ in levels.levels] == [4, 2, 1]
    assert levels.scan(np.array([3, 6, 50], np.uint64), np.array([9, 6, 9], np.int64)).tolist() == [True, False, False]


def test_token_files(spark, docs, rows):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, partition_bytes=4000)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r) for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert {(r.doc_id, r.start, r.n_tokens) for r in token_files.read_index(spark, path).collect()} == {w[:3] for w in want}


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_lexicon_coding(docs, rows, size):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)] += 1
    coded = lexicon_bpe.with_ids(docs, size=size, decode=True)
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in coded.collect()) == want
    again = lexicon_bpe.decoded(coded.drop("decoded"))
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in again.collect()) == want


def test_lexicon_is_minimal():
    lexicon = lexicon_bpe.Lexicon.compiled({b"tapping": [1, 2], b"topping": [3], b"tap": []})
    assert len(lexicon.parts["final"]) == 10  # a trie has 15 states; both endings share theirs
    mapped = lexicon_bpe.Lexicon.mapped(lexicon.packed())
    assert mapped.ids_of(["topping", "tapping", "tap", "ta", "", "tappings"]) == [[3], [1, 2], [], None, None, None]


def test_near_duplicates(docs, rows):
    got = {(r.doc_id, r.text): r.class_id for r in order_minhash.with_class(docs).collect()}
    class_of = lambda i: got[i, next(r[1] for r in rows if r[0] == i)]
    assert [class_of(i) for i in (0, 1, 2, 4, 5, 6, 10, 11, None)] == [0, 0, 0, 4, 4, 4, 10, 10, 4]
    assert class_of(3) == 3 and class_of(15) == 15
    kept = order_minhash.without_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and len(kept[0]) == len(docs.columns)


def test_short_near_duplicates(spark):
    rng, texts = random.Random(7), []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(8 + group % 9)]
        texts += [base, base + ["end"], ["front"] + base, base[:-1] + ["other"], ["front"] + base + ["end"]]
    texts += [[rng.choice("ab") for _ in range(n)] for n in range(8, 17) for _ in range(12)]  # repeated shingles, inner runs
    texts += [["v"] + ["ha"] * n + ["w"] for n in range(5, 15)]
    scanner, docs = order_minhash.Scanner({}), [" ".join(t) for t in texts]
    shingles = [order_minhash.shingles_of([t.encode()], scanner)[0].tolist() for t in docs]
    name = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            short = max(len(shingles[i]), len(shingles[j])) <= order_minhash.SHORT
            if name[i] != name[j] and short and order_minhash.aligned(shingles[i], shingles[j], 0.8) >= 0.8:
                name = [min(name[i], name[j]) if n in (name[i], name[j]) else n for n in name]
    short = [i for i in range(len(docs)) if len(shingles[i]) <= order_minhash.SHORT]
    frame = spark.createDataFrame([(i, docs[i]) for i in short], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.with_class(frame).collect()}
    assert got == {i: name[i] for i in short}
    assert got[0] == got[1] == got[2] == 0  # 8 against 9 words, and 9 against 10 below
    assert got[5] == got[6] == got[7] == 5


def test_alignment():
    a = list(range(100))
    assert order_minhash.aligned(a, a, 0.8) == 1.0
    assert order_minhash.aligned(a, a[:50] + [-1] + a[51:], 0.8) == pytest.approx(99 / 101)
    assert order_minhash.aligned(a, a[50:] + a[:50], 0.8) < 0.8  # same shingles, other order
    assert order_minhash.aligned([], [], 0.8) == 1.0 and order_minhash.aligned([], a, 0.8) == 0.0


def test_components(spark):
    chain = [(bytes([i + 1]), bytes([i])) for i in range(30)] + [(b"y", b"x"), (b"y", b"y")]
    got = {bytes(r.node): bytes(r["class"]) for r in components.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert all(got[bytes([i])] == b"\0" for i in range(31)) and got[b"y"] == b"x"


def test_quality(spark, docs):
    train = [(100 + i, ("### $$$ %%% &&&\n" if i % 2 else "Some plain words, as people write.\n") * (1 + i % 7)) for i in range(200)]
    frame = spark.createDataFrame(train, "doc_id long, text string")
    labels = frame.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (100, None)], "doc_id long, quality int"))
    model = line_crf.train(frame, labels)
    scored = line_crf.with_score(frame, model).withColumn("held", line_crf.held_out()).where("held").collect()
    assert len(scored) > 20 and all((r.score >= 0.3) == (r.doc_id % 2 == 0) for r in scored)
    odd = line_crf.with_score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and {r.score for r in odd if not (r.text or "").strip()} == {model.prior}
    nothing = line_crf.train(frame, labels.limit(0))
    assert line_crf.with_score(frame, nothing).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)


def test_quality_rules(docs, rows):
    got = {(r.doc_id, r.text): r for r in quality_rules.with_verdict(docs).collect()}
    for doc, text, *_ in rows:
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        windows = collections.defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i:i + 8])].append(i)
        again = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        r = got[doc, text]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and (r.rejected_by is None) == r.kept


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
             (3, 1, "assistant", "yes"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "x"), (6, 5, None, "z"), (7, 0, "user", "hi"), (7, 1, "assistant", "no")]
    turns += [(8, i, "user", f"t{i}") for i in range(3000)] + [(9, i, "user", f"t{i}") for i in range(2500)]
    got = chat.rendered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part) for r in got] == [(2, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (8, 1), (8, 2)]
    assert got[0].text == "<|user|>\nhi\n<|assistant|>\nyes\n" and got[3].text == "<|" + "|>\nz\n"
    assert "".join(r.text for r in got if r.conv_id == 8) == "".join(f"<|user|>\nt{i}\n" for i in range(3000))


def test_urls(spark):
    urls = {"http://a.example.org/es/1": ("example.org/es/", "block"), "http://EXAMPLE.org/en/19?x": ("example.org/en/1", "block"), "x://org": (None, "allow"),
            "https://casino.net/": (None, "block"), "https://casinos.net/": (None, "allow"), None: (None, "allow"), "no scheme.com/de/": (None, "allow"),
            "http://notorg/": (None, "allow"), "http://x.com/de/#": ("com/de/", "block"), "": (None, "allow")}
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string")
    got = url_rules.with_verdict(frame).collect()
    assert len(got) == 2 * len(urls) and all((r.rule, r.verdict) == urls[r.url] for r in got)


def test_urls_that_rules_must_not_miss(spark):
    block = ["https://casino7.net/", "https://a.casino777win.org.net/x", "http://my-casino.net/", "http://x.net/out?url=http://y.net",
             "http://x.net/redirect?a=1&url=https%3A//y.net", "https://cheap-pill.net/", "https://cheap-pills.net/", "http://XXX.net", "http://a-porn.net/xxx"]
    allow = ["https://casinos.net/", "https://mycasino7.net/", "https://cheappills.net/", "http://x.net/about?url=http://y.net", "http://x.net/out?curl=http://y.net"]
    many = [f"http://{t}.net/redirect/url/casino/{t}" for t in ("cheap", "out", "url", "redirect", "casino", "pills")] * 3  # tokens of all frequencies
    for extra in ([], many, ["http://pills.net/"], ["http://cheap.net/a", "http://url.net/", "http://url.net/2"]):
        urls = [*block, *allow, *[u for u in extra if "//casino." not in u]]
        got = url_rules.with_verdict(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
        assert {r.url for r in got if r.verdict == "block"} == set(block) and len(got) == len(urls)
    rule = url_rules.PatternRule("odd", "[0-9]{9}")
    got = url_rules.with_verdict(spark.createDataFrame([("http://a.net/123456789",), ("http://a.net/1",), (None,)], "url string"), [], [rule]).collect()
    assert [r.pattern for r in got] == ["odd", None, None]


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in pii.with_spans(docs.where("doc_id is not null")).withColumn("listed", pii.listed("base")).collect()}
    assert got[8].listed == "email:5:16,phone:23:40" and got[9].listed == "card:5:24,ip:32:42"
    assert got[0].listed == "" and len(got) == 18
    clean = {r.doc_id: r.text for r in pii.redacted(docs).where("doc_id in (8, 9, 3)").collect()}
    assert clean[8] == "Mail <email>, call <phone>!" and clean[9] == "card <card> and ip <ip> or 300.1.1.1" and clean[3] == "one two"
    many = spark.createDataFrame([(1, " ".join(f"u{i}@h{i}.net" for i in range(700)))], "doc_id long, text string")
    spans = pii.with_spans(many).first().base
    text = many.first().text
    assert [text[s.start:s.end] for s in spans] == text.split()
    seeds = [(i, f"Call reaches 4111 1111 1111 1111 or owner 4{i:03d}111111111111 now") for i in range(40)]
    found = pii.with_spans(spark.createDataFrame(seeds, "doc_id long, text string"), confidence=0.05, support=1).first()
    assert len(found.spans) >= len(found.base)


def test_all_learned_patterns_are_used(spark):
    key = lambda p: "k" + "".join("abcdefghij"[int(d)] for d in f"{p:04d}")
    seeds = [(f"{p}.{k}", f"{key(p)} 4{k}11111111111{p:04d} end") for p in range(2100) for k in range(10)]
    fresh = [(f"{p}", f"{key(p)} 4999{p:04d} end") for p in range(2100)]  # too short for a card, same shape; each key has one valid card
    frame = spark.createDataFrame(seeds + fresh, "doc_id string, text string")
    got = pii.with_spans(frame, confidence=0.05, support=1).where("doc_id not like '%.%'").collect()
    assert len(got) == 2100 and all([(s.start, s.end) for s in r.spans] == [(6, 14)] for r in got)


def test_unseen_identifiers_are_found(spark):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03d}")

    def card(i):
        body = f"41112222{i:07d}"
        return body + str(-sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(body)) % 10)

    blocks = lambda c: " ".join(c[k:k + 4] for k in range(0, 16, 4))
    wrong = lambda c: c[:-1] + str((int(c[-1]) + 1) % 10)
    rows = []
    for i in range(40):
        mail = f"{name(i)}@{name(i + 1)}.org"
        rows += [f"Kontakt: {mail} bitte", f"{mail} wrote this", f"card {blocks(card(i))} was used", f"Room 12 4x {mail} end", f"mailbox ({name(i)}.{'x' * 70}@{mail[4:]})"]
    planted = [("Kontakt: anna@host bitte", "anna@host"), ("Kontakt: anna at host bitte", "anna at host"), ("anna@host wrote this", "anna@host"),
               (f"card {blocks(wrong(card(77)))} was used", blocks(wrong(card(77)))), ("Room 12 4x anna@host end", "anna@host"),
               (f"mailbox ({'y' * 80}@host).", "y" * 80 + "@host"), ("please look at this room 12 of 1990", None)]
    frame = spark.createDataFrame(list(enumerate(rows + [t for t, _ in planted])), "doc_id long, text string")
    got = {r.text: [(s.kind, r.text[s.start:s.end]) for s in r.spans] for r in pii.with_spans(frame).collect()}
    for text, value in planted:
        assert [v for _, v in got[text]] == ([value] if value else []), text
    assert got[planted[0][0]][0][0] == 0 and got[planted[3][0]][0][0] == 2
    assert all(len(got[t]) == 1 for t in rows)
