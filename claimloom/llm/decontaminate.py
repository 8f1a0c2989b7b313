"""Benchmark decontamination by template canonicalisation.

Texts become templates: words are lower-cased, a number becomes a placeholder, one with a unit
after it the placeholder of what that measures (mass, length, time, money ...), and so does a run of names (capitalised words, but for the STARTERS that begin a
sentence), so that a slot is one token whatever its value. Beside its template (form 0) a text
has a plain form (1), where names are words in lower case, so that a copy in another case counts
too. Windows of WIDTH tokens are hashed in documents and benchmark items alike and joined by
hash; an item of fewer tokens is hashed at its own length. For every matched pair the names are
compared: within an item, a name must always stand for the same name in the document, so that a
re-parameterised question counts and a chance mix of placeholders doesn't; numbers vary freely.

A window of less than LITERALS words besides placeholders says nothing. Where the others cover
at least half of a form's tokens they alone are compared; where they don't in the plain form
(an item of numbers, say), the rest is hashed with its values as they stand (form 2), so that a
verbatim copy is found, whatever its length; an item of one or two bare values isn't looked for. A document is
contaminated by an item when matched windows in nearby alignments (NEAR) cover at least SHARE of
the tokens that the item's windows cover, or when RUN tokens in a row match. Where they cover
half of a template, the text around them is looked at in windows of FINE tokens (with a word each): covering
SHARE of the whole item is enough, so that an inserted or changed word costs little more than
itself wherever it stands.

Before the join, windows are tested against a bitmap, two bits for each of the benchmark's
hashes; it has BITS_EACH bits a hash, BITS at least and MOST_BITS (16 MB) at most, and it only
ever drops windows that can't match. The join itself is by hash on both sides.

All of it is DataFrame expressions. A null or empty text has no windows. The placeholders' own
characters count as spaces in a text. Repeated rows each get their answer by id. Rows without an
id never match. Empty tables give no rows, or no contamination. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import let, written

WIDTH = 5
SHARE = 0.8
RUN = 13
#: Least and most bits of the bitmap (16 MB); between them, so many for each of the items' windows.
BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 27, 32
#: Words that an item's window must have besides its placeholders.
LITERALS = 2
#: An item of placeholders alone is looked for if it has so many: fewer values stand in any text.
LEAST_VALUES = 3
#: Width of the windows that are looked at around matches of half an item.
FINE = 3
#: Alignments whose positions differ by up to this are counted together: slots that change their length shift what follows.
NEAR = 8

#: Unit words that follow a number, by what they measure (fixed values).
UNITS = {
    "share": ("%", "percent"),
    "mass": ("kg", "g", "mg", "lb", "lbs", "oz", "grams", "kilograms", "pounds", "ounces"),
    "length": ("km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "meters", "metres"),
    "volume": ("l", "ml", "liters", "litres", "gallons"),
    "time": ("hours", "hour", "hrs", "minutes", "minute", "min", "seconds", "second", "sec", "days", "day", "weeks", "week", "months", "month", "years", "year"),
    "money": ("dollars", "dollar", "usd", "eur", "euros", "cents"),
    "speed": ("mph", "kmh"),
    "angle": ("degrees",),
    "power": ("watts", "volts"),
    "area": ("acres",),
}

#: Words that begin a sentence without being names (fixed values).
STARTERS = ("a", "after", "all", "an", "and", "are", "as", "at", "before", "both", "but", "by", "calculate", "can", "compute", "consider", "could", "describe", "determine", "did", "do", "does", "during", "each", "every", "explain", "find", "for", "from", "given", "had", "has", "have", "he", "her", "here", "his", "how", "if", "in", "is", "it", "its", "let", "many", "may", "might", "most", "no", "not", "of", "on", "one", "or", "our", "prove", "she", "should", "show", "since", "so", "some", "suppose", "that", "the", "their", "then", "there", "these", "they", "this", "those", "three", "to", "two", "until", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whose", "why", "will", "with", "would", "write", "you", "your")

#: Placeholders: characters of private use, which count as spaces where a text has them.
NUM, NAME = "\ue000", "\ue001"
#: One for a number with each kind of unit.
MEASURES = {kind: chr(0xE002 + i) for i, kind in enumerate(UNITS)}
SLOTS = (NUM, NAME, *MEASURES.values())
#: Groups repeat possessively: the same matches, but Java's engine then loops instead of recursing, whatever their number.
_NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
_END = rf"(?![\p{{L}}\p{{N}}{NUM}])"
_UNITS = {kind: "(?i:" + "|".join(u if u == "%" else u + _END for u in units) + ")" for kind, units in UNITS.items()}
#: A capitalised word inside a sentence (after a word, a comma or the like), or at its beginning unless that is a starter.
_NAME = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}])(?:(?<=[^.!?\s]\s{{1,2}})|(?!(?i:{'|'.join(STARTERS)})(?![\p{{L}}\p{{M}}])))[\p{{L}}\p{{M}}]++"
_NAMES = rf"{_NAME}(?:\s{{1,2}}{_NAME})*+"
_MEASURE = rf"{_NUMBER}(?:\s?(?:{'|'.join(_UNITS.values())}))?"
_WORD = rf"[\p{{L}}\p{{M}}]+|[{SLOTS[0]}-{SLOTS[-1]}]"


def cleaned(text: Column) -> Column:
    """The text without the placeholders' characters."""
    return F.when(text.rlike(f"[{SLOTS[0]}-{SLOTS[-1]}]"), F.translate(text, "".join(SLOTS), " " * len(SLOTS))).otherwise(text)


def _numbered(text: Column) -> Column:
    """Numbers as placeholders; those with a unit after them then become their kind's, a pass that looks at placeholders alone."""
    out = F.regexp_replace(text, _NUMBER, NUM)
    for kind, units in _UNITS.items():
        out = F.regexp_replace(out, rf"{NUM}\s?{units}", MEASURES[kind])
    return F.when(text.rlike("[0-9]"), out).otherwise(text)


def template(text: Column) -> Column:
    """Tokens with typed placeholders for numbers (with their unit) and runs of names; other words in lower case.

    The replacements run over the whole text, not word by word: a text costs a few passes.
    """
    return F.regexp_extract_all(F.lower(F.regexp_replace(_numbered(cleaned(text)), _NAMES, NAME)), F.lit(_WORD), F.lit(0))


def plain(text: Column) -> Column:
    """The same with names left as words in lower case."""
    return F.regexp_extract_all(F.lower(_numbered(cleaned(text))), F.lit(_WORD), F.lit(0))


def exact(text: Column) -> Column:
    """The plain form's tokens with numbers as they stand."""
    return F.regexp_extract_all(F.lower(cleaned(text)), F.lit(rf"{_MEASURE}|{_WORD}"), F.lit(0))


def values(text: Column) -> Column:
    """The template's tokens as they stand in the text."""
    return F.regexp_extract_all(cleaned(text), F.lit(rf"{_NAMES}|{_MEASURE}|{_WORD}"), F.lit(0))


def windows(marks: Column, width: int, mark: str | None = None) -> Column:
    """Hashes of the windows of a token array, in order; a mark sets them apart from those of other forms.

    Tokens are hashed once each, windows from their hashes. Fewer tokens than the width make one window.
    """
    own = [F.lit(mark)] if mark else []

    def of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        return F.when(F.size(h) > 0, F.transform(places, lambda i: F.xxhash64(*own, *(F.get(h, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(marks, lambda m: F.xxhash64(m)), of)


def _covered(at: Column, width: Column) -> Column:
    """How many tokens the windows at the sorted places cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda acc, p: F.struct((p + width).alias("end"), (acc["n"] + F.least(width, p + width - acc["end"])).alias("n")), lambda acc: acc["n"])


def _names(marks: Column, words: Column, at: Column, width: Column) -> Column:
    """The names that a window's placeholders stand for, in order."""
    pairs = F.arrays_zip(F.slice(marks, at, width).alias("m"), F.slice(words, at, width).alias("w"))
    return F.transform(F.filter(pairs, lambda p: p["m"] == NAME), lambda p: F.lower(F.regexp_replace(p["w"], r"\s+", " ")))


def _longest(at: Column) -> Column:
    """How many of the sorted places follow one another without a gap, at most."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(acc: Column, p: Column) -> Column:
        n = F.when(p == acc["last"] + 1, acc["n"] + 1).otherwise(1)
        return F.struct(p.alias("last"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    return F.aggregate(at, start, step, lambda acc: acc["most"])


def _bits(h: Column, bits: int) -> tuple[Column, Column]:
    """A hash's two places in the bitmap."""
    return F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))


def _bitmap(items: DataFrame, bits: int) -> Column:
    """A scalar of `bits` bits as longs: those of the items' window hashes."""
    bit = items.select(F.explode("hashes").alias("h")).select(F.explode(F.array(*_bits(F.col("h"), bits))).alias("bit")).distinct()
    words = bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("value"))
    filled = words.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("value", F.lit(0)).alias("value"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda s: s["value"]).alias("bitmap")).scalar()


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, run: int = RUN, bits: int | None = None, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, matched, total, share): contaminated documents with the items found in them, and the tokens that match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    size = F.least(F.size("marks"), F.lit(width))
    is_slot = lambda m: m.isin(*SLOTS)
    literals = lambda i: F.size(F.filter(F.slice("marks", i + 1, width), lambda m: ~is_slot(m)))
    # An item has its template (form 0) and, where that has names, its plain form (1); a poor one its values too (2).
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), template(text).alias("t"), plain(text).alias("p"), exact(text).alias("exact"), values(text).alias("words"))
    made = F.array(F.struct(F.lit(0).alias("form"), F.col("t").alias("marks")), F.struct(F.lit(1).alias("form"), F.col("p").alias("marks")))
    items = items.select("item_id", "words", "exact", F.array_contains("t", NAME).alias("named"), F.inline(made))
    every = F.transform(windows(F.col("marks"), width), lambda h, i: F.struct(h.alias("h"), i.alias("pos"), literals(i).alias("literals")))
    items = items.withColumn("every", every).withColumn("told", F.filter("every", lambda s: s["literals"] >= LITERALS))
    covered = lambda of: _covered(F.transform(of, lambda s: s["pos"]), size)
    items = items.withColumn("rich", (F.size("marks") > 0) & (2 * covered(F.col("told")) >= F.size("marks")))
    as_stands = F.transform(F.arrays_zip("every", windows(F.col("exact"), width, "=").alias("e")), lambda s: F.struct(F.when(s["every"]["literals"] >= LITERALS, s["every"]["h"]).otherwise(s["e"]).alias("h"), s["every"]["pos"].alias("pos"), s["every"]["literals"].alias("literals")))
    poor = (F.col("form") == 1) & ~F.col("rich") & (F.size("marks") >= LEAST_VALUES)
    items = items.where(F.when(F.col("form") == 0, F.col("rich")).otherwise((F.col("rich") & F.col("named")) | poor))
    items = items.withColumn("told", F.when(poor, as_stands).otherwise(F.col("told"))).withColumn("form", F.when(poor, 2).otherwise(F.col("form")))
    items = written(items.select("item_id", "form", "marks", "words", "told", size.alias("width"), covered(F.col("told")).alias("total"), F.transform("told", lambda s: s["h"]).alias("hashes")))
    parts = items.select("item_id", "form", "marks", "words", "width", "total", F.explode("told").alias("s"))
    parts = parts.select("item_id", "form", "width", "total", F.col("s.pos").alias("pos"), F.col("s.h").alias("h"), F.when(F.col("form") == 0, _names(F.col("marks"), F.col("words"), F.col("s.pos") + 1, F.col("width"))).otherwise(none).alias("item_names"))
    short = sorted(r[0] for r in items.where(F.col("width") < width).select("width").distinct().collect())  # fewer than width values
    valued = items.where("form = 2").limit(1).count() > 0

    # Windows leave a document as (id, text hash, form, position, hash), and most end at the bitmap.
    key = [F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")]
    if bits is None:
        n = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
        bits = min(MOST_BITS, max(BITS, 1 << (n * BITS_EACH).bit_length()))
    bitmap = _bitmap(items, bits)
    is_set = lambda bit: F.getbit(F.element_at(bitmap, (F.shiftright(bit, 6) + 1).cast("int")), (bit % 64).cast("int")) == 1
    known = docs.where(F.col(id_col).isNotNull())
    marks = known.select(*key, template(text).alias("marks"), plain(text).alias("plain"), (F.when(text.rlike("[0-9]"), exact(text)).otherwise(none) if valued else none).alias("exact"))
    each = lambda of, form, n, mark=None: F.transform(windows(of, n, mark), lambda h, i: F.struct(F.lit(form).alias("doc_form"), F.lit(n).alias("width"), i.alias("at"), h.alias("h")))
    every = lambda of, form: F.concat(*(each(of, form, n) for n in (width, *short)))
    told = F.when(F.array_contains("marks", NAME), F.concat(every(F.col("marks"), 0), every(F.col("plain"), 1))).otherwise(every(F.col("marks"), 0))
    if valued:
        told = F.concat(told, *(each(F.col("exact"), 2, n, "=") for n in (width, *short)))
    # Outer: else a filter on the array's size is pushed below, and takes its whole making along.
    seen = marks.select("id", "text_hash", told.alias("told")).select("id", "text_hash", F.explode_outer("told").alias("s")).select("id", "text_hash", "s.doc_form", "s.at", "s.h")
    first, second = _bits(F.col("h"), bits)
    matched = written(seen.where(is_set(first) & is_set(second)).join(parts, "h").distinct())

    # Names are read again from the few texts that matched; written first, so that their true number decides the join.
    chosen = written(matched.select("id", "text_hash").distinct())
    texts = known.select(*key, text.alias("text")).join(chosen, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    texts = written(texts.select("id", "text_hash", template(F.col("text")).alias("marks"), values(F.col("text")).alias("words")))
    found = matched.join(texts, ["id", "text_hash"])
    doc_names = F.when(F.col("doc_form") == 0, _names(F.col("marks"), F.col("words"), F.col("at") + 1, F.col("width"))).otherwise(none)
    # Windows of a poor item match its document's plain form or values, whose places are the same.
    hits = found.withColumn("doc_names", doc_names).withColumn("shift", F.col("at") - F.col("pos")).withColumn("doc_form", F.when(F.col("form") == 2, 2).otherwise(F.col("doc_form")))

    # An alignment of an item in a document is the difference of positions; besides each alone (kind 0), those
    # in a range of 2 * NEAR are taken together (1, and 2 with the ranges moved by half).
    near = 2 * NEAR
    groups = F.array(*(F.struct(F.lit(k).alias("kind"), g.cast("long").alias("place")) for k, g in enumerate((F.col("shift"), F.floor(F.col("shift") / near), F.floor((F.col("shift") + NEAR) / near)))))
    names = F.arrays_zip(F.col("item_names").alias("i"), F.col("doc_names").alias("d"))
    lined = hits.withColumn("names", names).withColumn("group", F.explode(groups)).groupBy("id", "text_hash", "item_id", "form", "doc_form", "group").agg(
        F.first("total").alias("total"), F.first("width").alias("width"), F.array_sort(F.collect_set("pos")).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("names"))).alias("pairs"), F.min("shift").alias("first"), F.max("shift").alias("last"),
    )
    # Consistent: each of the item's names stands for one name of the document.
    same = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    lined = written(lined.where(same).withColumn("matched", _covered(F.col("at"), F.col("width"))).drop("pairs"))
    # Plain forms have no names to compare, so their places must follow one another.
    places = F.when((F.col("form") > 0) & (F.col("doc_form") > 0), _longest(F.col("at"))).otherwise(F.size("at"))
    enough = (F.col("matched") >= share * F.col("total")) | ((F.col("group.kind") == 0) & (places >= run - width + 1))
    half = lined.where(~enough & (F.col("group.kind") > 0) & (F.col("form") == 0) & (F.col("doc_form") == 0) & (2 * F.col("matched") >= F.col("total")))
    half = half.join(items.select("item_id", "form", F.col("marks").alias("own")), ["item_id", "form"]).join(texts.drop("words"), ["id", "text_hash"])
    start = F.greatest(F.col("first") - NEAR, F.lit(0))
    around = F.slice("marks", start + 1, F.col("last") + F.size("own") + NEAR - start)
    half = half.where(F.size("own") >= FINE).select("id", "item_id", "own", windows(F.col("own"), FINE).alias("fine"), windows(around, FINE).alias("theirs"))
    at = F.filter(F.sequence(F.lit(0), F.size("fine") - 1), lambda i: F.array_contains("theirs", F.get("fine", i)) & F.exists(F.slice("own", i + 1, FINE), lambda m: ~is_slot(m)))
    half = half.select("id", "item_id", _covered(at, F.lit(FINE)).alias("matched"), F.size("own").alias("total"))
    lined = lined.where(enough).select("id", "item_id", "matched", "total").unionByName(half.where(F.col("matched") >= share * F.col("total")))
    best = lined.groupBy("id", "item_id").agg(F.max_by(F.struct("matched", "total"), F.col("matched") / F.col("total")).alias("m")).select("id", "item_id", "m.*")
    return best.select(F.col("id").alias(id_col), "item_id", F.col("matched").cast("long"), F.col("total").cast("long"), (F.col("matched") / F.col("total")).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, without contaminated documents."""
    gone = written(matches(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("__gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
