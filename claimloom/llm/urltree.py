"""URL filter: host rules, and a path-template tree per host for the urls that no rule fits.

A rule is a host and the beginning of a path (`example.net/en/`). It fits its host and all
subdomains of it, if the url's path begins with the rule's; the longest that fits decides.

The others are judged by what is known of urls like them. Every host has a tree of path
segments, grown a level a round:

  - A segment that is a number, date, UUID, hexadecimal key or a mix of letters and digits is a
    wildcard by its type, its file extension kept (`{num}.html`). A branch point with more than
    MANY distinct other segments is variable: these become `*`.
  - Of what stays literal, sibling branches that the data don't tell apart are merged
    (`{de|fr}`): over urls, the kinds of what follows, the share that is labelled, and the share
    of labelled ones that are to be blocked each differ by less than Hoeffding's bound at ALPHA.
    Branches of fewer than LEAST urls stay as they are, as nothing can be said of them. The
    branches are taken from the largest, ties by name, each joining the first branch taken
    before that it resembles.
  - Segments from LEVELS on form one last segment.

A template, host and path from the root to a leaf, is rejected if its smoothed purity
(blocked + SMOOTH * base) / (labelled + SMOOTH) reaches REJECT; base is the share of blocked
ones among all labelled urls, at most a half, so that a template without labels is allowed.
Labels are the rules' own verdicts, or those of a label column (true: block).

The tree is made of distinct (host, typed path) rows with counts; urls meet it once, at the
end. Hosts and templates may be of any size: a branch point is counted, never gathered, and
gathered only where it has MANY literal branches at most. Lookups by host or path broadcast the
keys that hold more than 1/256 of the rows, whose number is bounded, and shuffle the others.

A null url, or one without `://`, has an empty host and path: a tree of its own. Every row gets
a row, repeated ones too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import looked_up, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: More distinct literal segments than this make a branch point variable.
MANY = 32
LEAST = 8
LEVELS = 12
ALPHA = 0.05
SMOOTH = 4.0
REJECT = 0.9

#: Typed segments, the first that matches; an extension of up to five letters or digits stays.
TYPES = (
    ("num", r"[0-9]++"),
    ("date", r"[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?"),
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("hex", r"(?=[a-f]*[0-9])[0-9a-f]{8,}+"),
    ("mix", r"(?=[^0-9]*[0-9])(?=[^\p{L}]*\p{L})[\p{L}0-9_-]++"),
)
EXTENSION = r"((?:\.[A-Za-z0-9]{1,5})?)"
#: What can follow a branch: a type, another segment, a path's last empty one, or nothing.
SHAPES = (*(t for t, _ in TYPES), "word", "slash", "end")


def host_of(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(name, verdict) of the longest rule that fits, or null; the longest is looked for first, ties by name."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def typed(segment: Column) -> Column:
    """The segment, or its wildcard."""
    out = segment
    for kind, pattern in reversed(TYPES):
        whole = rf"^(?:{pattern}){EXTENSION}$"
        out = F.when(segment.rlike(whole), F.concat(F.lit(f"{{{kind}}}"), F.regexp_extract(segment, whole, 1))).otherwise(out)
    return out


def segments(path: Column, levels: int = LEVELS) -> Column:
    """Typed segments of a path; what stands from the last level on is one segment. No path has none."""
    told = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), typed)
    bounded = F.when(F.size(told) > levels, F.concat(F.slice(told, 1, levels - 1), F.array(F.array_join(F.slice(told, levels, F.greatest(F.size(told) - levels + 1, F.lit(0))), "/")))).otherwise(told)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(bounded)


def _shape(segment: Column) -> Column:
    """The kind of a segment that follows, null being none."""
    kind = F.regexp_extract(segment, r"^\{([a-z]+)\}", 1)
    return F.when(segment.isNull(), "end").when(segment == "", "slash").when(kind.isin([t for t, _ in TYPES]), kind).otherwise("word")


def _literal(segment: Column) -> Column:
    return ~_shape(segment).isin("slash", "end", *(t for t, _ in TYPES))


def apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Hoeffding's bound: shares over n and m draws that differ by more are told apart."""
    with np.errstate(divide="ignore"):
        return np.sqrt(0.5 * np.log(2 / ALPHA)) * (1 / np.sqrt(n) + 1 / np.sqrt(m))


def alike(a: dict, b: dict) -> bool:
    """Whether two branches (n, labelled, blocked, shapes) aren't told apart."""
    near = lambda x, n, y, m: n == 0 or m == 0 or abs(x / n - y / m) <= apart(n, m)
    return (
        all(near(x, a["n"], y, b["n"]) for x, y in zip(a["shapes"], b["shapes"], strict=True))
        and near(a["labelled"], a["n"], b["labelled"], b["n"])
        and near(a["blocked"], a["labelled"], b["blocked"], b["labelled"])
    )


def merged(branches: list[dict]) -> dict[str, str]:
    """New names of the literal branches of one branch point, those alike under one."""
    groups: list[list[dict]] = []
    for x in sorted((b for b in branches if b["n"] >= LEAST), key=lambda b: (-b["n"], b["seg"])):
        home = next((g for g in groups if alike(g[0], x)), None)
        if home is None:
            groups.append([x])
        else:
            home.append(x)
    return {x["seg"]: "{" + "|".join(sorted(y["seg"] for y in g)) + "}" for g in groups if len(g) > 1 for x in g}


def _renamed(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas over one branch point: at most MANY rows."""
    got = merged([{"seg": r.seg, "n": r.n, "labelled": r.labelled, "blocked": r.blocked, "shapes": list(r.shapes)} for r in pdf.itertuples()])
    first = pdf.iloc[0]
    return pd.DataFrame([(first.host, first.node, s, name) for s, name in got.items()], columns=["host", "node", "seg", "name"])


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def grown(paths: DataFrame) -> DataFrame:
    """(host, typed, template) of (host, typed, segs, n, labelled, blocked): the trees, a level a round."""
    rows = written(paths.select("*", F.lit("").alias("node"), F.size("segs").alias("size")))
    deepest = rows.agg(F.max("size")).first()[0] or 0
    for level in range(deepest):
        live = rows.where(F.col("size") > level).withColumn("seg", F.col("segs")[level])
        after = _shape(F.get("segs", F.lit(level + 1)))
        shaped = (F.sum(F.when(after == s, F.col("n")).otherwise(0)) for s in SHAPES)
        kids = written(live.where(_literal(F.col("seg"))).groupBy("host", "node", "seg").agg(*_sums(), F.count("*").alias("paths"), F.array(*shaped).alias("shapes")))
        points = written(kids.groupBy("host", "node").agg(F.count("*").alias("n_kids"), F.sum("paths").alias("n")))
        few = looked_up(kids.drop("paths"), points.select("host", "node", "n_kids", F.col("n_kids").alias("n")), ["host", "node"]).where(F.col("n_kids").between(2, MANY))
        names = few.drop("n_kids").groupBy("host", "node").applyInPandas(_renamed, "host string, node string, seg string, name string")
        names = written(names.join(kids.select("host", "node", "seg", F.col("paths").alias("n")), ["host", "node", "seg"]))
        many = points.where(F.col("n_kids") > MANY).select("host", "node", F.lit(True).alias("variable"), "n")
        told = looked_up(looked_up(live, many, ["host", "node"]), names, ["host", "node", "seg"])
        part = F.when(F.col("variable") & _literal(F.col("seg")), "*").otherwise(F.coalesce("name", "seg"))
        went = told.withColumn("node", F.concat("node", F.lit("/"), part)).select(rows.columns)
        rows = written(rows.where(F.col("size") <= level).unionByName(went))
    return rows.select("host", "typed", F.col("node").alias("template"), "n", "labelled", "blocked")


def templates(leaves: DataFrame) -> DataFrame:
    """(host, template, labelled, purity) of grown() rows."""
    total = leaves.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()
    base = min(0.5, (total["b"] or 0) / total["l"]) if total["l"] else 0.5
    return leaves.groupBy("host", "template").agg(*_sums(), F.count("*").alias("paths")).select("host", "template", "labelled", ((F.col("blocked") + SMOOTH * base) / (F.col("labelled") + SMOOTH)).alias("purity"), "paths")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", blocked: Column | None = None) -> DataFrame:
    """A row for each page: host, path, the rule that fits, the verdict, and its template's labels and purity.

    blocked: a boolean column of pages that labels urls beside the rules, null where unknown.
    """
    label = F.lit(None).cast("boolean") if blocked is None else blocked
    split = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), label.alias("label"))
    split = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", F.coalesce(F.col("fit.verdict") == "block", "label"))
    rows = written(split.withColumn("typed", F.array_join(F.concat(F.array(F.lit("")), segments(F.col("path"))), "/")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    paths = rows.groupBy("host", "typed").agg(F.count("*").alias("n"), count(F.col("label").isNotNull()).alias("labelled"), count(F.col("label")).alias("blocked"))
    # A wildcard is a type of its own no more, so a typed path has the same segments as its path.
    leaves = grown(paths.withColumn("segs", segments(F.col("typed"))))
    known = leaves.drop("labelled", "blocked")
    known = looked_up(known, written(templates(leaves)), ["host", "template"], "paths")
    told = looked_up(rows.drop("label"), written(known), ["host", "typed"])
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return told.select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "template", "labelled", "purity")
