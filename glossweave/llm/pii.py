"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns that pass a check (email; ip with
parts at most 255; card of 13 to 19 digits passing Luhn; phone of 9 to 15 digits). Further candidates are
the matches that fail and looser patterns (account numbers, spelled-out addresses, titled names, keys).
Labelers vote for, against or not at all on each candidate: its pattern, a gazetteer of what such values
are made of, the words before, the characters after, and its shape. How often each combination of votes
occurs in all documents is counted (at most 3^5 for each kind, the only rows the driver sees);
expectation-maximisation over these counts estimates the labelers' reliabilities and each combination's
posterior, and a logistic span classifier is trained on the posteriors. Its weights become a column
expression. Candidates it accepts are added where they overlap no base span; base spans always stay.

Positions: the text between matches and the matches themselves are cut apart in one pass, and running
sums of their lengths give the spans in code points. The patterns are written with possessive parts and
look-behinds that match the same strings as the plain ones without rescanning long runs.

Defined cases: null and empty texts have no spans; a row is a document, so repeated rows and equal or
null doc_ids each get their own result row; with no candidates nothing is fitted; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: The order of kinds in span lists; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "name", "secret")
BASE = 4
_LOCAL = "A-Za-z0-9._%+-"
#: (kind, pattern, what a text must hold to be searched)
PATTERNS = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9][.][0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][ -]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
LOOSE = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++", r"[\[(]at[\])]"),
    ("account", r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[ -][0-9]{2,4}[ -][0-9]{4}(?![0-9A-Za-z])", "[0-9][ )-]"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?+(?![a-z])", "(?:Mr|Mrs|Ms|Dr|Prof)[.] [A-Z]"),
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,60}[0-9])(?=[0-9_-]{0,60}[A-Za-z])[A-Za-z0-9_-]{24,128}+(?![A-Za-z0-9_-])", "[A-Za-z0-9_-]{24}"),
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Fixed word lists of the gazetteer and context labelers.
_GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|example)$",
    "ip": r"^(?:10|127|169|172|192|198|203)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|33|34|44|49|7|81|86|91)(?![0-9]{12})",
    "account": r"^\(?[2-9][0-9]{2}\)?[ -]",
    "name": r"^(?:Dr|Prof)\.",
    "secret": r"^(?:sk|pk|ghp|gho|AKIA|eyJ|xox[bp]|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$)",
}
_BEFORE = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|reach|from|to)\W*$",
    "ip": r"(?i)(?:ip|address|host|server|login|from)\W*$",
    "card": r"(?i)(?:card|visa|credit|debit|account|no|number)\W*$",
    "phone": r"(?i)(?:call|phone|tel|mobile|fax|cell|whatsapp|number|contact)\W*$",
    "account": r"(?i)(?:call|phone|tel|mobile|ssn|social|security|account|iban|passport|id|number)\W*$",
    "name": r"(?i)(?:dear|by|from|with|to|contact|signed|and)\W*$",
    "secret": r"(?i)(?:token|secret|key|apikey|password|passwd|pwd|bearer|credential|auth)[\"' ]*(?:[:=]|is)?[\s\"']*$",
}
_AGAINST = r"(?i)(?:version|isbn|issn|page|pages|chapter|section|fig|figure|table|doi|rfc|ch\.|vol\.|no\.|§|v)\W*$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str) -> Column:
    value, digits = F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False),
        "phone": (n >= 9) & (n <= 15),
    }[kind]


def _search(text: Column, code: int, pattern: str, needed: str) -> Column:
    """Array of (code, gap, size, value, tail, head): each match after the gap before it, and the last gap."""
    cut = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(
            F.lit(code).alias("code"), F.length(gap).cast("long").alias("gap"), F.length(value).cast("long").alias("size"), value.alias("value"), F.right(gap, F.lit(32)).alias("tail"), F.left(gap, F.lit(16)).alias("head")
        ),
    )
    none = F.expr("cast(array() as array<struct<code:int,gap:bigint,size:bigint,value:string,tail:string,head:string>>)")
    holds = text.contains(needed) if len(needed) == 1 else text.rlike(needed)
    return F.when(holds, cut).otherwise(none)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id of every row) and the matches of all patterns: row, code, start, end, value, tail, head."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*[_search(F.col("text"), k, p, n) for k, (_, p, n) in enumerate((*PATTERNS, *LOOSE))])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    stored = materialize(rows.select("row", "doc_id", found.alias("found")), "pii-found")
    each = stored.where(F.size("found") > 0).select("row", F.posexplode("found").alias("k", "f")).select("row", "k", "f.*")
    order = Window.partitionBy("row", "code").orderBy("k")
    passed = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("size").over(passed), F.lit(0))
    each = each.select("row", "code", "size", "value", "tail", F.lead("head").over(order).alias("head"), start.alias("start")).where("value is not null")
    return stored.select("row", "doc_id"), each.withColumn("end", F.col("start") + F.col("size")).drop("size")


def _vote(positive: Column, negative: Column | None = None) -> Column:
    vote = F.when(positive, 1)
    return (vote if negative is None else vote.when(negative, -1)).otherwise(0)


LABELERS = ("v_pattern", "v_gazetteer", "v_before", "v_after", "v_shape")


def label(found: DataFrame) -> DataFrame:
    """`found` with kind, base (whether it is a base span) and the votes of the labelers."""
    kinds = [k for k, _, _ in (*PATTERNS, *LOOSE)]
    per = lambda make: F.coalesce(*[F.when(F.col("code") == k, make(kind)) for k, kind in enumerate(kinds)])
    base = F.coalesce(*[F.when(F.col("code") == k, _passes(kind)) for k, (kind, _, _) in enumerate(PATTERNS)], F.lit(False))
    digits = F.regexp_replace("value", "[^0-9]", "")
    dull = digits.rlike(r"^([0-9])\1{5,}$") | digits.startswith("1234567") | digits.rlike("^0{4}")
    varied = F.col("value").rlike(r"[0-9][^0-9]*[1-9][^0-9]*[2-9]|@")
    return found.withColumns(
        {
            "kind": per(F.lit),
            "base": base,
            "v_pattern": F.when(F.col("code") < BASE, F.when(base, 1).otherwise(-1)).otherwise(0),
            "v_gazetteer": _vote(per(lambda k: F.col("value").rlike(_GAZETTEER[k]))),
            "v_before": _vote(per(lambda k: F.col("tail").rlike(_BEFORE[k])), F.col("tail").rlike(_AGAINST)),
            "v_after": _vote(F.col("head").rlike("^[\"',;.!?)\\s]|^$"), F.col("head").rlike(r"^ ?(?:%|kg|km|cm|mm|px|pp|ms|MB|GB|[=*/^])")),
            "v_shape": _vote(varied & ~dull, dull),
        }
    )


def fit(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 60, steps: int = 400) -> dict[str, float]:
    """Weights of the span classifier from (kind, votes, count): EM for the labelers, then logistic regression.

    Keys of the result: "" the intercept, kinds, and "labeler:vote".
    """
    if not counts:
        return {}
    kinds = sorted({k for k, _, _ in counts})
    good = {k: 0.5 for k in kinds}
    # reliability of labeler j: chances of votes -1, 0, 1 given a true or a false span
    chance = {True: [{-1: 0.1, 0: 0.4, 1: 0.5} for _ in LABELERS], False: [{-1: 0.4, 0: 0.4, 1: 0.2} for _ in LABELERS]}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _ in counts:
            odds = math.log(good[kind] / (1 - good[kind])) + sum(math.log(chance[True][j][v] / chance[False][j][v]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for k in kinds:
            own = [(p, n) for (kind, _, n), p in zip(counts, post, strict=True) if kind == k]
            good[k] = min(0.98, max(0.02, (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)))
        for truth in (True, False):
            for j in range(len(LABELERS)):
                tally = dict.fromkeys((-1, 0, 1), 1.0)
                for (_, votes, n), p in zip(counts, post, strict=True):
                    tally[votes[j]] += n * (p if truth else 1 - p)
                whole = sum(tally.values())
                chance[truth][j] = {v: x / whole for v, x in tally.items()}
    named = [["", k, *[f"{name}:{v}" for name, v in zip(LABELERS, votes, strict=True) if v]] for k, votes, _ in counts]
    weights = dict.fromkeys(sorted({x for f in named for x in f}), 0.0)
    scale = [math.log1p(n) for _, _, n in counts]  # a frequent combination does not drown the others
    whole = sum(scale)
    for _ in range(steps):
        slope = dict.fromkeys(weights, 0.0)
        for f, p, n in zip(named, post, scale, strict=True):
            off = n * (1 / (1 + math.exp(-sum(weights[x] for x in f))) - p) / whole
            for x in f:
                slope[x] += off
        for x in weights:
            weights[x] -= 2.0 * (slope[x] + 1e-3 * weights[x])
    return weights


def accepted(weights: dict[str, float]) -> Column:
    """The span classifier as a column: whether its chance is over one half."""
    score = F.lit(weights.get("", 0.0))
    for key, w in weights.items():
        name, _, vote = key.partition(":")
        if vote:
            score = score + F.when(F.col(name) == int(vote), w).otherwise(0.0)
        elif key:
            score = score + F.when(F.col("kind") == key, w).otherwise(0.0)
    return score > 0


def _text_of(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of `docs`."""
    rows, found = candidates(docs)
    labelled = materialize(label(found), "pii-labelled")
    counts = [(r[0], tuple(r[1:-1]), r[-1]) for r in labelled.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS).collect()]
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    chosen = labelled.where(F.col("base") | accepted(fit(counts))).withColumn("rank", F.when(~F.col("base") & F.col("kind").isin("card", "phone", "ip"), KINDS.index("account")).otherwise(rank))
    # added spans lie outside base spans, and outside added ones that begin before them
    by_row = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end", "code")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by_row.rowsBetween(1, Window.unboundedFollowing))
    clear = F.col("base") | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (ahead.isNull() | (ahead >= F.col("end"))))
    chosen = chosen.withColumn("clear", clear).where("clear")
    first = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("first", F.coalesce(first, F.lit(0))).where(F.col("base") | (F.col("first") <= F.col("start")))
    span = F.struct("rank", "start", "end")
    own = chosen.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(_text_of(F.collect_list(F.when(F.col("base"), span))), 256).alias("base_sha256"),
        _text_of(F.collect_list(span)).alias("spans"),
    )
    zero = F.lit(0).cast("long")
    out = rows.join(own, "row", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:BASE]], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
