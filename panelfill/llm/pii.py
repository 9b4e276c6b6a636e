"""Personal data: fixed detectors seed a bootstrapped search for identifiers in the same contexts.

Fixed detectors find e-mail addresses, IP addresses, payment card and phone numbers. They are the seeds, each by its own
bounds. Candidates are all words with a digit or ``@``, runs of up to ``RUN`` such words with one blank between them (as
many as a card number has digits), and two words around a written-out ``at``, without the signs around them and as far as
they touch no seed. A lexical pattern is the word in front (none at the start of a text) together with the shape: 9 for
digits, a and A for letters, repeats squeezed; a@a for names around ``@`` or ``at``. Patterns and words form a graph; a
word has one shape, so only shapes that some seed has can matter, and others are left out. In each round a pattern's
confidence is the mean score of its words, smoothed by one unknown word, and a word's score is that of its best pattern;
seeds keep a score of one. Patterns that end with a high confidence and enough different seeds mark the candidates they
hold, of nested ones the outer. Only DataFrame functions are used; positions are code points, ends exclusive.

Defined cases: a null text is an empty one without spans; equal rows get equal spans, and count each in the graph as a
word counts once per pattern; spans may start at one place in two kinds and are listed by start, then kind; an empty
table gives an empty table; other columns are carried. Texts of any length are read whole; no expression backtracks
over more than one word. Values and shapes above 64 characters are compared by their hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelfill.llm.common import names_apart
from panelfill.sources.storage import stored

KINDS = ["email", "ip", "card", "phone"]
# The detectors. Possessive forms and guards only keep the search linear, they match the same spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
AT = r"(?i)(?<!\S)\S++\x20(?:at|\(at\)|\[at\])\x20\S++"
RUN = 19
LEAD, TRAIL = r"""^[("'<\[{]++""", r"""[)"'>\]},.;:!?]++$"""
TAKEN = ["base", "spans", "words", "_text", "_m", "_g", "_s", "_e", "_k1", "_k2", "_own", "_more", "_cut", "_far", *[f"_{k}" for k in KINDS]]
ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 3
STEP = 128


def _running(sizes: str) -> Column:
    """Running sums of an array column, block by block, so that long arrays take no quadratic time."""
    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"),
                           lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(STEP))
    blocks = F.transform(starts, lambda b: sums(F.slice(sizes, b, STEP)))
    totals = F.transform(starts, lambda b: F.aggregate(F.slice(sizes, b, STEP), F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, sums(totals), lambda own, end: F.transform(own, lambda x: x + end - F.element_at(own, -1))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and its digits added, is divisible by ten."""
    places = F.sequence(F.lit(1), F.length(digits))
    worth = F.transform(places, lambda i: F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        return lambda v: F.length(_digits(v)).between(14, 19) & _luhn(_digits(v))
    if kind == "phone":
        return lambda v: F.length(_digits(v)).between(10, 15)
    return lambda v: F.lit(True)


def _last_word(front: Column) -> Column:
    """The last word, in lower case and without blanks and opening signs behind it."""
    return F.lower(F.substring_index(F.rtrim(F.translate(front, "\n\t\r\x0b\f", "     "), F.lit(" ([{<\"'")), " ", -1))


def _matches(docs: DataFrame, name: str, pattern: str, may: Column) -> DataFrame:
    """Adds ``name``: all matches with ``start``, ``end``, ``value``, ``before`` (text back to the last match) and ``word``, the
    word in front.

    The text is split at the matches; lengths of the pieces and matches add up to the positions.
    """
    text = F.col("_text")
    docs = docs.withColumn("_m", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("_g", F.when(F.size("_m") > 0, F.slice(F.split(text, pattern, -1), 1, F.size("_m"))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("_s", F.zip_with("_g", "_m", lambda g, m: F.length(g) + F.length(m)))
    docs = docs.withColumn("_e", F.when(F.size("_s") > 0, _running("_s")).otherwise(F.array().cast("array<int>")))
    front = lambda x, i: F.concat(F.right(F.coalesce(F.get("_m", i - 1), F.lit("")), F.lit(80)), F.right(x["_g"], F.lit(80)))
    found = F.transform(F.arrays_zip("_m", "_g", "_e"), lambda x, i: F.struct(
        (x["_e"] - F.length(x["_m"])).alias("start"), x["_e"].alias("end"), x["_m"].alias("value"), x["_g"].alias("before"),
        _last_word(front(x, i)).alias("word")))
    return docs.withColumn(name, found).drop("_m", "_g", "_s", "_e")


def _valid_spans(matches: str, number: int, valid: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(matches, lambda s: valid(s["value"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["word"].alias("word")))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: valid spans of the fixed detectors as structs of start, kind number, end, value and word in
    front, in order."""
    text = F.col("_text")
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
           "phone": text.rlike(r"\+[0-9]")}
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind in KINDS:
        out = _matches(out, f"_{kind}", PATTERNS[kind], may[kind])
    spans = [_valid_spans(f"_{kind}", number, _valid(kind)) for number, kind in enumerate(KINDS)]
    return out.withColumn("base", F.array_sort(F.concat(*spans))).drop(*[f"_{k}" for k in KINDS])


def _shape(value: Column) -> Column:
    """A name around ``@`` or ``at`` is a@a, whatever letters, digits and signs within names it has."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, "[0-9]", "9"), r"\p{Ll}", "a"), r"\p{Lu}", "A"), r"(.)\1+", "$1")
    mail = F.regexp_replace(F.regexp_replace(value, r"(?i)\x20(?:at|\(at\)|\[at\])\x20", "@"), r"[\p{L}0-9._%+-]++", "a")
    return _short(F.when(mail.contains("@"), mail).otherwise(plain))


def _short(value: Column) -> Column:
    return F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)


def _bare(start: Column, value: Column, word: Column) -> Column:
    """A candidate without the signs around it."""
    lead, trail = F.length(F.regexp_extract(value, LEAD, 0)), F.length(F.regexp_extract(value, TRAIL, 0))
    return F.struct((start + lead).alias("start"), (start + F.length(value) - trail).alias("end"),
                    F.regexp_replace(F.regexp_replace(value, LEAD, ""), TRAIL, "").alias("value"), word.alias("word"))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``words``: the seeds with their kind and the candidates with none, with position, value and word in front."""
    out = _matches(docs, "_own", WORD, F.col("_text").rlike("[0-9@]"))
    out = _matches(out, "_at", AT, F.col("_text").rlike(r"(?i)\x20(?:at|\(at\)|\[at\])\x20"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    out = out.withColumn("_own", F.transform("_own", lambda s: F.struct(
        s["start"].alias("start"), s["value"].alias("value"), s["before"].alias("before"), s["word"].alias("word"), free(s).alias("free"))))
    joined = lambda i: F.coalesce((F.get("_own", i)["before"] == " ") & F.get("_own", i)["free"], F.lit(False))
    runs = F.flatten(F.transform("_own", lambda w, i: F.transform(
        F.filter(F.sequence(F.lit(1), F.when(w["free"] & joined(i + 1), F.lit(RUN)).otherwise(F.lit(1))),
                 lambda n: w["free"] & ((n == 1) | F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: joined(i + k)))),
        lambda n: _bare(w["start"], F.array_join(F.transform(F.slice("_own", i + 1, n), lambda x: x["value"]), " "), w["word"]))))
    fresh = F.filter(F.concat(runs, F.transform(F.filter("_at", free), lambda s: _bare(s["start"], s["value"], s["word"]))),
                     lambda s: s["start"] < s["end"])
    word = lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["word"].alias("word"),
                                    kind.cast("int").alias("kind"))
    return out.withColumn("words", F.concat(F.transform("base", lambda b: word(b, b["kind"])),
                                            F.transform(fresh, lambda s: word(s, F.lit(None))))).drop("_own", "_at")


def _texts(docs: DataFrame) -> DataFrame:
    """Adds two hashes that name a text."""
    return docs.withColumns({"_k1": F.xxhash64("_text"), "_k2": F.xxhash64(F.lit(1), "_text")})


def text_words(docs: DataFrame) -> DataFrame:
    """The seeds and candidates of all different texts, one in a row, as a written table."""
    # explode() would push a test of the whole expression down to the texts, where lambdas compute its parts again
    rows = (_texts(with_words(with_base_spans(docs))).select("_k1", "_k2", F.explode_outer("words").alias("w"))
            .where("w is not null").select("_k1", "_k2", "w.*").withColumn("shape", _shape(F.col("value"))))
    rows = stored(rows.select("_k1", "_k2", "start", "end", "kind", _short(F.col("value")).alias("value"), "shape",
                              F.concat("word", F.lit(" "), "shape").alias("pattern")), "candidates")
    shapes = rows.where(F.col("kind").isNotNull()).select("shape").distinct()
    return stored(rows.join(shapes, "shape", "left_semi").drop("shape").distinct(), "words")


def learned_patterns(docs: DataFrame, **options) -> DataFrame:
    """``pattern`` and ``kind`` of all patterns that end with a high confidence, as a written table."""
    return _learned(text_words(docs), **options)


def _learned(rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    graph = stored(rows.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pattern-graph")
    score = F.col("kind").isNotNull().cast("double")
    patterns = None
    for _ in range(rounds):
        if patterns is not None:
            words = graph.join(patterns.select("pattern", "confidence"), "pattern").groupBy("value").agg(F.max("confidence").alias("score"))
            scored = graph.join(words, "value", "left").withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        else:
            scored = graph.withColumn("score", score)
        patterns = stored(scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count("kind").alias("seeds"), F.mode("kind", True).alias("kind")), "patterns")
    return stored(patterns.where((F.col("confidence") >= confidence) & (F.col("seeds") >= support))
                  .select("pattern", "kind"), "learned")


@names_apart(*TAKEN)
def with_spans(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``base`` and ``spans``, structs of start, kind number and end; ``spans`` has the learned ones too."""
    names = docs.columns
    words = text_words(docs)
    fresh = words.where(F.col("kind").isNull()).drop("kind").join(_learned(words, **options), "pattern")
    earlier = Window.partitionBy("_k1", "_k2").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    fresh = fresh.withColumn("_far", F.max("end").over(earlier)).where(F.col("_far").isNull() | (F.col("end") > F.col("_far")))
    more = stored(fresh.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_more")), "learned-spans")
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = _texts(with_base_spans(docs)).withColumn("base", slim(F.col("base"))).join(more, ["_k1", "_k2"], "left")
    spans = F.when(F.col("_more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_more")))
    return out.select(*[f"`{n}`" for n in names], "base", spans.alias("spans"))


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


@names_apart(*TAKEN)
def redacted(docs: DataFrame, **options) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; a span that starts inside an earlier one is
    part of it. Texts without spans are unchanged."""
    found, names = with_spans(docs, **options), docs.columns
    kind = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit(">"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    last = lambda a: F.get(a, F.size(a) - 1)
    joined = F.aggregate("spans", empty, lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < last(a)["end"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), last(a)["kind"].alias("kind"),
                                                               F.greatest(last(a)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(s))))
    found = found.withColumn("_cut", F.when(F.size("spans") > 0, joined))
    ends = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda s: s["end"]))
    pieces = F.zip_with("_cut", F.slice(ends, 1, F.size("_cut")), lambda s, e: F.concat(F.substr("text", e + 1, s["start"] - e), kind(s)))
    tail = F.substr("text", F.element_at(ends, -1) + 1, F.length("text"))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))).select(*[f"`{n}`" for n in names])
