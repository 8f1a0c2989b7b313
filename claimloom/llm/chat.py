"""Chat formatting of heterogeneous records by schema fingerprints.

A record is one JSON text in whatever layout its source uses. Its nested field paths and types,
as schema_of_variant gives them in canonical order, are hashed into a fingerprint. Fingerprints
select declarative mappings (where the turns are, what the role and text fields are called, or
which flat fields make which turn): the first that a record of that schema fits, each field at
its own depth; the mapping that was selected extracts canonical turns. The distinct fingerprints are a small written table, so
Spark decides by its true size how it meets the records. A text that is a list of parts
(`[{"type": "text", "text": ...}]`, or of plain texts) is its parts' texts joined. Roles stay as they are but in
layouts that declare other names for them.

Every record has a status: `ok`, `incomplete` (a field that its layout needs is null, missing
or an object; its turn has an empty text), `unknown layout`, or `malformed` (no JSON). Texts that a
variant refuses (a key that comes twice in an object, or more than 128 MB) are read by the
layouts' typed schemas instead; their fingerprint stays null, and lists of parts stay JSON
text there.

The template marks each turn as `<turn>role`, a line feed, the text, `</turn>` and a line feed.
Inside roles and texts `\\` is doubled and the two control strings are written `<\\turn>` and
`<\\/turn>`, and a line feed inside a role stands after a backslash. So control strings never
occur raw, and dropping each escaping backslash gives the text back. The loss mask is the list
of code-point spans of the assistant turns' texts. A conversation becomes one text, so its
turns meet in one row.

Null texts are empty, null roles too. Turns are ordered by number, then role, then text; rows
that repeat a turn stay. Null conversation ids form one conversation. A conversation of empty
texts has turns with empty texts. An empty table gives no rows. Other columns are ignored.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import written

OPEN, CLOSE = "<turn>", "</turn>"
TURNS = "array<struct<role:string,text:string>>"

#: Other names of the canonical roles, in the layout that uses them.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How one family of records is laid out.

    needs: field paths that a record's schema must have, as `a.b` and `a[].b`.
    turns, role, text: path of a list of turns, and its fields; or
    flat: (role, path) for each turn in order, an empty or missing one being left out unless it is needed.
    roles: canonical roles by the layout's own names for them.
    """

    name: str
    needs: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    flat: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("turns", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=tuple(ROLES.items())),
    Layout("instruction", ("instruction", "output"), flat=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "response"), flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), flat=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), flat=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def escape(text: Column) -> Column:
    for plain, marked in (("\\", "\\\\"), (OPEN, "<\\turn>"), (CLOSE, "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fingerprinted(records: DataFrame, json_col: str) -> DataFrame:
    """Adds __record (variant), __paths (its schema in canonical order) and fingerprint."""
    record = F.try_parse_json(F.col(json_col))
    paths = F.schema_of_variant(F.col("__record"))
    return records.withColumn("__record", record).withColumn("__paths", paths).withColumn("fingerprint", F.xxhash64("__paths"))


def _at(value: Column, path: str) -> Column:
    """What stands at a path, by true nesting; null where nothing does."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def _list(value: Column) -> Column:
    """The elements of a list, null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def _fits(record: Column, layout: Layout) -> Column:
    """Whether a record has the fields that a layout needs: each where it is said to be, at no other depth."""
    if layout.turns:
        has = lambda field: F.exists(_list(_at(record, layout.turns)), lambda t: _at(t, field).isNotNull())
        return F.coalesce(has(layout.role) & has(layout.text), F.lit(False))
    out = F.lit(True)
    for path in layout.needs:
        out = out & _at(record, path).isNotNull()
    return out


def selected(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds __layout: one choice for each distinct schema, the first that fits, joined back by fingerprint."""
    fit = [F.bool_or(_fits(F.col("__record"), x)).alias(f"fit{i}") for i, x in enumerate(layouts)]
    choice = F.lit(None).cast("string")
    for i, x in reversed(list(enumerate(layouts))):
        choice = F.when(F.col(f"fit{i}"), F.lit(x.name)).otherwise(choice)
    known = written(records.groupBy("fingerprint").agg(*fit).select("fingerprint", choice.alias("__layout")))
    return records.join(known, "fingerprint", "left")


def _text(value: Column) -> Column:
    """A text, or the joined texts of a list of parts, from a variant; null if it is null, absent or an object.

    Parts are texts, or objects with a `text`; other parts (an image) have none.
    """
    one = lambda p: F.coalesce(F.when(F.try_variant_get(p, "$", "map<string,variant>").isNull(), F.try_variant_get(p, "$", "string")).otherwise(F.try_variant_get(p, "$.text", "string")), F.lit(""))
    joined = F.array_join(F.transform(_list(value), one), "")
    plain = F.when(F.try_variant_get(value, "$", "map<string,variant>").isNull(), F.try_variant_get(value, "$", "string"))
    return F.when(F.is_variant_null(value), F.lit(None).cast("string")).otherwise(F.coalesce(joined, plain))


def _flat(layout: Layout, read) -> Column:
    """The turns of a flat layout; needed ones stay though they are empty."""
    each = [F.struct(F.lit(role).alias("role"), F.coalesce(read(path), F.lit("")).alias("text"), F.lit(path in layout.needs).alias("needed")) for role, path in layout.flat]
    return F.transform(F.filter(F.array(*each), lambda t: t["needed"] | (t["text"] != "")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _role_name(layout: Layout, role: Column) -> Column:
    """The canonical role of a layout's own name for it."""
    known = [F.create_map(*(F.lit(v) for pair in layout.roles for v in pair))[role]] if layout.roles else []
    return F.coalesce(*known, role, F.lit(""))


def _turn(layout: Layout, read):
    """An element of a layout's list as a canonical turn."""
    return lambda t: F.struct(_role_name(layout, read(t, layout.role)).alias("role"), F.coalesce(read(t, layout.text), F.lit("")).alias("text"))


def turns(record: Column, layout: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a record under the layout selected for it."""
    out = F.lit(None).cast(TURNS)
    for x in layouts:
        if x.turns:
            got = F.transform(_list(_at(record, x.turns)), _turn(x, lambda t, field: _text(_at(t, field))))
        else:
            got = _flat(x, lambda path: _text(_at(record, path)))
        out = F.when(layout == x.name, got.cast(TURNS)).otherwise(out)
    return out


def lacking(record: Column, layout: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Whether a field that the record's layout needs is null, absent or of a kind that isn't a text."""
    out = F.lit(False)
    for x in layouts:
        if x.turns:
            # A record of a schema that another made fit may have no list here.
            lacks = F.coalesce(F.exists(_list(_at(record, x.turns)), lambda t: _text(_at(t, x.role)).isNull() | _text(_at(t, x.text)).isNull()), F.lit(True))  # noqa: B023
        else:
            lacks = F.lit(False)
            for path in x.needs:
                lacks = lacks | _text(_at(record, path)).isNull()
        out = F.when(layout == x.name, lacks).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _typed(json: Column, path: str, kind: str) -> Column:
    """The value at a path of a JSON text, read as its type; no variant is made."""
    for part in reversed(path.split(".")):
        kind = f"struct<`{part}`:{kind}>"
    out = F.from_json(json, kind)
    for part in path.split("."):
        out = out[part]
    return out


def refused(json: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """(layout, turns) of a record that no variant holds: the first layout whose fields it has."""
    out = F.lit(None).cast(f"struct<layout:string,turns:{TURNS}>")
    for x in reversed(layouts):
        if x.turns:
            listed = _typed(json, x.turns, f"array<struct<`{x.role}`:string,`{x.text}`:string>>")
            fits = F.exists(listed, lambda t: t[x.role].isNotNull() & t[x.text].isNotNull())  # noqa: B023
            got = F.transform(listed, _turn(x, lambda t, field: t[field]))
        else:
            fits = F.lit(True)
            for path in x.needs:
                fits = fits & _typed(json, path, "string").isNotNull()
            got = _flat(x, lambda path: _typed(json, path, "string"))
        out = F.when(fits, F.struct(F.lit(x.name).alias("layout"), got.cast(TURNS).alias("turns"))).otherwise(out)
    return out


def formatted(turns: Column) -> Column:
    """The template's text."""
    one = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escape(t["text"]), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def _role(part: Column) -> Column:
    """The escaped role of a part: up to the first line feed that no backslash escapes."""
    return F.regexp_extract(part, rf"(?s)^{OPEN}((?:[^\\\n]|\\.)*+)\n", 1)


def loss_mask(text: Column) -> Column:
    """Code-point spans (start, end) of the assistant texts in a formatted text, in order."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("got"))

    def step(acc: Column, part: Column) -> Column:
        # A part is a whole turn without its end mark and line feed.
        end = acc["at"] + F.length(part)
        begin = acc["at"] + len(OPEN) + F.length(_role(part)) + 1
        mine = F.startswith(part, F.lit(f"{OPEN}assistant\n"))
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + len(CLOSE) + 1).alias("at"), F.when(mine, F.concat(acc["got"], span)).otherwise(acc["got"]).alias("got"))

    return F.aggregate(parts(text), start, step, lambda acc: acc["got"])


def parts(text: Column) -> Column:
    """Turns of a formatted text, still escaped, each from its open mark to before its end mark."""
    return F.filter(F.split(text, f"{CLOSE}\n"), lambda p: p != "")


def parsed(text: Column) -> Column:
    """Turns read back from a formatted text."""

    def one(p: Column) -> Column:
        role = _role(p)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + len(OPEN) + 2, F.length(p))).alias("text"))

    return F.transform(parts(text), one)


def _record(listed: Column, layout: Layout) -> Column:
    """JSON of a list of (role, text) turns in a layout that can hold them."""
    if layout.turns:
        return F.to_json(F.struct(F.transform(listed, lambda t: F.struct(t["role"].alias(layout.role), t["text"].alias(layout.text))).alias(layout.turns)))
    first = lambda role: F.get(F.filter(listed, lambda t: t["role"] == role), F.lit(0))["text"]
    return F.to_json(F.struct(*(first(role).alias(path) for role, path in layout.flat if path != "input")))


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", layouts: tuple[Layout, ...] = LAYOUTS[:1]) -> DataFrame:
    """One JSON record for each conversation of a table with a row for each turn.

    Of several layouts the id's remainder chooses one that holds the conversation unchanged: a flat
    one takes one user turn, then one assistant turn; one with its own role names takes none that
    those would replace; the first takes any.
    """
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("__turns"))
    roles = F.transform("__turns", lambda t: t["role"])
    json = _record(F.col("__turns"), layouts[0])
    for i, x in enumerate(layouts[1:], 1):
        holds = F.lit(True) if x.turns else roles == F.array(F.lit("user"), F.lit("assistant"))
        if x.roles:
            holds = ~F.arrays_overlap(roles, F.array(*(F.lit(own) for own, _ in x.roles)))
        json = F.when((F.pmod("conv_id", F.lit(len(layouts))) == i) & holds, _record(F.col("__turns"), x)).otherwise(json)
    return listed.select("conv_id", json.alias("json"))


#: Columns of the result beside the record's own.
RESULT = ("fingerprint", "layout", "status", "chat", "loss")


def chat(records: DataFrame, json_col: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout, status, chat (the formatted text) and loss (spans of the assistant texts).

    Of the input's columns the JSON goes, and so do those that have one of these names.
    """
    own = [c for c in records.columns if c not in RESULT and c != json_col]
    known = selected(fingerprinted(records.select(*own, F.col(json_col).alias("__json")), "__json"), layouts)
    parsed, record = F.col("__record").isNotNull(), F.col("__record")
    known = known.withColumn("__refused", F.when(~parsed & F.col("__json").isNotNull(), refused(F.col("__json"), layouts)))
    layout = F.coalesce("__layout", "__refused.layout")
    lacks = F.when(parsed, lacking(record, F.col("__layout"), layouts)).otherwise(False)
    status = F.when(layout.isNotNull(), F.when(lacks, "incomplete").otherwise("ok")).when(parsed, "unknown layout").otherwise("malformed")
    told = F.coalesce(turns(record, F.col("__layout"), layouts), F.when(~parsed, F.col("__refused.turns")), F.array().cast(TURNS))
    out = known.select(*own, "fingerprint", layout.alias("layout"), status.alias("status"), formatted(told).alias("chat"))
    return out.withColumn("loss", loss_mask(F.col("chat")))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back from the formatted texts."""
    back = chats.withColumn("turns", parsed(F.col("chat")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("chat"), s["start"] + 1, s["end"] - s["start"]))), "")
    back = back.withColumn("lost", lost)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), F.length("chat").cast("long").alias("formatted_chars"),
        "status",
    )
