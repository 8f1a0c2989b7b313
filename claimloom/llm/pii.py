"""Personal data: format patterns, and identifiers found by bootstrapped contexts.

Base spans come from four formats (email, ip, card, phone), leftmost and non-overlapping each.
Those are seeds; so is a word of at least KEY_CHARS characters that mixes digits and letters (a
key or token is an identifier by its shape). The words before an instance make its patterns: the
last two, the last three, and the last one together with the instance's shape (digits,
hexadecimal or mixed, and the power of two of its length), as one word alone says too little.
Spark scores the bipartite graph of patterns and instances in rounds:

  pattern score  = (sum of its known instances' scores) / (all its distinct instances + SMOOTH)
  instance score = noisy-or of the scores of its patterns

where an instance is what stands after a pattern: a seed, with score 1, or a word of at least
LEAST_CHARS characters that holds a digit, from 0 on: what has no digit is never discovered. A
pattern needs LEAST_SUPPORT distinct seeds. Instances after patterns that end at or above
CONFIDENCE, single words at or above CONFIDENCE_ONE, are new spans of kind `id`; they never
overlap base spans. A key that no confident
pattern precedes is none.

All of it is DataFrame expressions. A text is split and matched by one pattern at a time, so a
match's code-point position is the sum of the lengths before it, and its context is made of the
last words of the pieces before it (a word that an earlier match of the kind cuts is two). Running
sums are taken within blocks of about the root of their number, then over the blocks, so that a
text with n matches costs n to the power 1.5 of cheap steps, not its square: a text of 1 MB that is
all numbers takes seconds.

Nulls and empty texts have no spans. Repeated rows each get a row. Rows without an id get a
row too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import let, written

NEW = "id"

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the contract's patterns: the same matches without backtracking, so that
#: long runs cost linear time and no stack. A run of an e-mail's local part or of an ip's
#: first digits is tried at its first character, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",  # shorter runs have too few digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that lacks these has no match, and isn't split.
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"), "phone": lambda t: t.contains("+")}

#: Words of context before an instance, at most.
CONTEXT = 3
LEAST_SUPPORT = 3
CONFIDENCE = 0.8
#: Of a single word and a shape.
CONFIDENCE_ONE = 0.95
SMOOTH = 1.0
ROUNDS = 3

LEAST_CHARS = 4
#: A word of digits and letters of this length is a seed.
KEY_CHARS = 20
#: A digit-bearing word, tried once for each run of word characters.
WORD = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]++"
#: What a word of a context is made of; anything else parts words.
PART = r"[^\p{L}\p{N}=:#]+"

SPAN = "array<struct<start:int,kind:int,end:int,text:string,patterns:array<string>>>"


def running(values: Column, start: int, op) -> Column:
    """The running op (a sum, a maximum) of an array of ints: within blocks, then over the blocks."""

    def over(v: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        first = F.struct(F.lit(start).alias("at"), F.expr("cast(array() as array<int>)").alias("got"))

        def scan(a: Column) -> Column:
            step = lambda acc, x: let(op(acc["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(acc["got"], y).alias("got")))
            return F.aggregate(a, first, step, lambda acc: acc["got"])

        own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), block), lambda i: scan(F.slice(v, i, block)))
        before = lambda blocks: F.concat(F.array(F.lit(start)), scan(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(start)))))
        return let(own, lambda blocks: F.flatten(F.zip_with(blocks, F.slice(before(blocks), F.lit(1), F.size(blocks)), lambda b, x: F.transform(b, lambda y: op(x, y)))))

    return let(values, over)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(values, lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        plain = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _tail(piece: Column) -> Column:
    """The last CONTEXT words of a piece of text, lower-cased."""
    words = F.filter(F.split(F.lower(piece), PART), lambda w: w != "")
    return let(words, lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT, F.lit(0)) + 1, CONTEXT))


def _shape(text: Column) -> Column:
    """Digits, hexadecimal or mixed, and the power of two of the length."""
    kind = F.when(text.rlike("^[0-9]++$"), "d").when(text.rlike("^[0-9a-fA-F]++$"), "h").otherwise("x")
    return F.concat(kind, F.floor(F.log2(F.length(text))).cast("string"))


def _patterns(words: Column, text: Column) -> Column:
    """Patterns of an instance after these words: a blank starts the one that has its shape."""
    n = F.size(words)
    last = lambda k: F.array_join(F.slice(words, F.greatest(n - k, F.lit(0)) + 1, k), " ")
    return F.array_compact(F.array(F.when(n >= 1, F.concat(F.lit(" "), last(1), F.lit(" "), _shape(text))), F.when(n >= 2, last(2)), F.when(n >= 3, last(3))))


def located(text: Column, pattern: str, rank: int, hint: Column) -> Column:
    """All matches of the pattern with code-point positions and patterns, in order.

    Every match has a word of its own, so the words of the CONTEXT matches before and the pieces
    between suffice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), F.length(h).alias("long"), F.length(g).alias("gap"), _tail(g).alias("before"), _tail(h).alias("own")))

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["long"] + x["gap"]), 0, lambda a, b: a + b)
        none = F.array().cast("array<string>")
        earlier = lambda i, field: F.coalesce(F.when(i >= 0, F.get(p, i)[field]), none)
        words = lambda x, i: F.concat(*(w for k in range(CONTEXT, 0, -1) for w in (earlier(i - k, "before"), earlier(i - k, "own"))), x["before"])
        one = lambda x, end, patterns: F.struct((end - x["long"]).alias("start"), F.lit(rank).alias("kind"), end.alias("end"), x["hit"].alias("text"), patterns.alias("patterns"))
        return let(ends, lambda e: F.transform(p, lambda x, i: one(x, F.get(e, i), let(words(x, i), lambda w: _patterns(w, x["hit"])))))

    return F.when(hint, let(pieces, spans)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def base_spans(text: Column) -> Column:
    """Valid spans of all base kinds, by start, then kind."""

    def of(rank: int, kind: str) -> Column:
        return F.filter(located(text, PATTERNS[kind], rank, HINTS[kind](text)), lambda s: _valid(kind, s["text"]))

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS))))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _free(words: Column, base: Column) -> Column:
    """The words that overlap no base span: both in one order, with the last end before and the next start after.

    Words don't overlap one another, so what a base span overlaps it starts before or inside.
    """
    flat = lambda c, is_word: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(is_word).alias("word"), s["end"].alias("end"), s["text"].alias("text"), s["patterns"].alias("patterns")))

    def of(every: Column) -> Column:
        ends = running(F.transform(every, lambda s: F.when(s["word"], 0).otherwise(s["end"])), 0, F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["word"], 2**31 - 1).otherwise(s["start"]))), 2**31 - 1, F.least))
        return let(ends, lambda e: let(starts, lambda b: F.filter(every, lambda s, i: s["word"] & (F.get(e, i) <= s["start"]) & (F.get(b, i) >= s["end"]))))

    return F.when((F.size(words) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(flat(base, False), flat(words, True))), of)).otherwise(flat(words, True))


def _instances(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["text"]).alias("instance"), s["patterns"].alias("patterns")))


def marked(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """Row key, the named columns, base spans and candidate instances, as a written table.

    The key is given once, here: what is joined by it later comes from this table alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *[docs[c] for c in columns], text.alias("__text")).withColumn("__base", base_spans(F.col("__text")))
    words = F.filter(located(F.col("__text"), WORD, len(KINDS), F.col("__text").rlike("[0-9]")), lambda s: F.length(s["text"]) >= LEAST_CHARS)
    free = let(F.col("__base"), lambda base: let(words, lambda w: _free(w, base)))
    rows = rows.withColumn("__seeds", _instances(F.col("__base"))).withColumn("__words", _instances(free))
    drop_text = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return written(rows.select("__row", *columns, drop_text.alias("__base"), "__seeds", "__words"))


def patterns(rows: DataFrame) -> DataFrame:
    """(pattern, score) of the graph that marked() rows span, after ROUNDS rounds."""
    one = lambda column, seed: rows.select(F.explode(column).alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", seed.alias("seed"))
    word = F.col("s.instance")
    key = (F.length(word) >= KEY_CHARS) & word.rlike("[0-9]") & word.rlike("[a-z]")
    edges = one("__seeds", F.lit(1)).union(one("__words", key.cast("int"))).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    strong = edges.groupBy("pattern").agg(F.sum("seed").alias("support")).where(F.col("support") >= LEAST_SUPPORT).select("pattern")
    edges = written(edges.join(strong, "pattern"))
    seeds = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("known"))
    for last in (k == ROUNDS - 1 for k in range(ROUNDS)):
        scored = written(edges.join(seeds, "instance").groupBy("pattern").agg((F.sum("known") / (F.count("*") + SMOOTH)).alias("score")))
        if last or scored.limit(1).count() == 0:
            return scored
        hope = 1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(1 - 1e-9)))))
        seeds = edges.join(scored, "pattern").groupBy("instance").agg(F.when(F.max("seed") == 1, 1.0).otherwise(hope).alias("known"))
    return scored


def discovered(rows: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(__row, __new): spans of the instances that confident patterns find."""
    least = F.when(F.startswith("pattern", F.lit(" ")), max(confidence, CONFIDENCE_ONE)).otherwise(confidence)
    good = patterns(rows).where(F.col("score") >= least).select("pattern")
    words = rows.select("__row", F.explode("__words").alias("s")).select("__row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    return words.join(good, "pattern").groupBy("__row").agg(F.collect_set(span).alias("__new"))


def _found(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns with __base and __spans, arrays of (start, kind, end), end exclusive."""
    rows = marked(docs, columns, text_col)
    # Written first, so that its true size decides how it is joined.
    found = rows.join(written(discovered(rows)), "__row", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return found.select(*columns, "__base", F.array_sort(F.concat("__base", F.coalesce("__new", none))).alias("__spans"))


def find(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns with base and spans; columns of those names give way."""
    own = [c for c in columns if c not in ("base", "spans")]
    return _found(docs, own, text_col).select(*own, F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, as <KIND>."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in (*KINDS, NEW)))

    def cut(chars: Column, spans: Column) -> Column:
        piece = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
        put = lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, F.greatest(s["start"] - at, F.lit(0))), F.element_at(names, s["kind"] + 1))).otherwise("")
        upto = lambda e, i: F.when(i > 0, F.get(e, i - 1)).otherwise(0)
        told = lambda e: F.concat(F.array_join(F.transform(spans, lambda s, i: put(s, upto(e, i))), ""), let(upto(e, F.size(e)), lambda at: piece(at, F.size(chars))))
        return let(running(F.transform(spans, lambda s: s["end"]), 0, F.greatest), told)

    return let(F.split(text, ""), lambda chars: let(spans, lambda s: cut(chars, s)))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, with their own columns, personal data in the text replaced by its kind."""
    found = _found(docs, docs.columns, text_col)
    some = F.size("__spans") > 0
    out = found.withColumn(text_col, F.when(some, redact(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(some, F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.select(*docs.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of find()'s rows."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        id_col, *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(joined(F.col("base"), (*KINDS, NEW)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), (*KINDS, NEW)).alias("spans"),
    )
