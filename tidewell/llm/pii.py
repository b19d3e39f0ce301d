"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Beside them, generators of high recall propose
more spans, overlapping ones too: every match that a base rule found and then rejected, digit groups in the shape of a card within such a match,
addresses with spelled-out signs, numbers without a plus. Format and context of each span become a few small categorical features.
Spans that a base rule judged are labels, and so are spans that look alike but that no base rule can accept: addresses with a bare
"at", and digit groups without a plus that have too few or too many digits. Features leave out what the base rules look at to
judge (Luhn's test, sizes of parts, a phone number's digits), so format and context decide. Since features take at most 640 combinations,
labels are one aggregate of that many rows, from which boosted trees are grown on the driver. The trees become one SQL expression,
so scoring stays in generated code. For each kind the threshold is the lowest score from which on at least ``precision``
of the labelled spans are true; spans above it that touch no base span are added. A kind without both labels gets none.

Positions count code points, ends are exclusive. A match is located by splitting the text at the same pattern, which
runs without backtracking: a match may begin only where a run begins or the last match ended. Null and empty texts have no
spans. Rows repeat as they come; extra columns are ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Kinds in the order in which spans are listed, and base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++"
PLAIN_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)[ -]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"
BARE_AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
GROUPS = r"(?<![0-9+(.-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9.-])"
RUN = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
NEAR = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address", "card": "card|credit|visa|pay", "phone": "phone|call|tel|mobile|fax|contact"}
CONTEXT = {k: rf"(?i)(?:{words})[^A-Za-z0-9]*+(?:[A-Za-z]{{1,6}}[^A-Za-z0-9]{{1,3}})?$" for k, words in NEAR.items()}
FEATURES = ("kind", "digits", "grouped", "brackets", "context", "clean")

_SPAN = "array<struct<start:int,hit:string>>"


def located(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<start, hit>> of all matches; looked for only where ``possible``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct((start + F.char_length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), x["hit"].alias("hit")))).alias("out")))

    return F.when(possible, F.aggregate(pairs, none, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass Luhn's test."""
    digits = F.transform(F.split(F.reverse(only_digits(s)), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def parts_fit(s: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.char_length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, hit: Column) -> Column:
    n = F.char_length(only_digits(hit))
    return {"email": F.lit(True), "ip": parts_fit(hit), "card": n.between(13, 19) & luhn(hit), "phone": n.between(9, 15)}[kind]


def _described(text: Column, kind: str, found: Column, label: int | None = None) -> Column:
    """Candidates with features: array<struct<kind, start, end, label, digits, grouped, brackets, context, clean>>. label: that of all spans, -1 where there is none; by default what the base rule says."""

    def one(x: Column) -> Column:
        start, hit = x["start"], x["hit"]
        end = start + F.char_length(hit)
        n = F.char_length(only_digits(hit))
        before, after = F.substring(text, start, F.lit(1)), F.substring(text, end + 1, F.lit(1))
        edge = F.when(start > 0, before.rlike("[A-Za-z0-9]")).otherwise(False) | after.rlike("[A-Za-z0-9]")
        near = F.substring(text, F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
        bucket = F.when(n < 9, 0).when(n < 13, 1).when(n <= 15, 2).when(n <= 19, 3).otherwise(4)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.cast("int").alias("end"), (_valid(kind, hit).cast("int") if label is None else F.lit(label)).alias("label"), (bucket if kind in ("ip", "card") else F.lit(0)).alias("digits"),
            hit.rlike("[0-9][ .()-]+[0-9]").cast("int").alias("grouped"), (hit.contains("(").cast("int") if kind == "phone" else F.lit(0)).alias("brackets"), near.rlike(CONTEXT[kind]).cast("int").alias("context"), (~edge).cast("int").alias("clean"),
        )

    return F.transform(found, one)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base array<struct<kind, start, end>>, proposed (candidates that aren't base spans, with features), judged (all that have labels)."""
    text = F.col("text")
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = found.withColumns({
        "m_email": located(text, EMAIL, F.instr(text, "@") > 0),
        "m_ip": located(text, IP, text.rlike(r"[0-9]\.[0-9]")),
        "m_card": located(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){8}")),
        "m_run": located(text, RUN, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "m_phone": located(text, PHONE, text.rlike(r"\+[0-9]")),
        "m_spelled": located(text, SPELLED, text.rlike(r"[\[(]at[\])]")),
        "m_plain": located(text, PLAIN_PHONE, text.rlike(r"[0-9][ .)-]{1,2}[0-9]{3}")),
        "m_bare": located(text, BARE_AT, text.rlike(r" at [A-Za-z0-9-]+\.")),
        "m_groups": located(text, GROUPS, text.rlike(r"[0-9]{2}[ .-][0-9]{2}")),
    })
    found = found.withColumn("m_card", F.filter("m_card", lambda x: F.char_length(only_digits(x["hit"])) >= 9))
    groups = F.filter("m_groups", lambda x: ~_valid("phone", x["hit"]))
    judged = F.concat(*[_described(text, k, F.col(f"m_{k}")) for k in KINDS], _described(text, "email", F.col("m_bare"), 0), _described(text, "phone", groups, 0))
    more = F.concat(_described(text, "email", F.col("m_spelled"), -1), _described(text, "phone", F.col("m_plain"), -1), _described(text, "card", F.col("m_run"), -1))
    out = found.select("id", judged.alias("judged"), more.alias("more"))
    base = F.transform(F.filter("judged", lambda c: c["label"] == 1), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return out.select("id", base.alias("base"), F.concat("more", F.filter("judged", lambda c: c["label"] == 0)).alias("proposed"), "judged")


def grow(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 40, rate: float = 0.3, depth: int = 3) -> tuple[float, list]:
    """Boosted regression trees on logistic loss. rows: (features, weight, share of true ones). A tree is a leaf value or (feature, most on the left, left, right)."""
    total = sum(w for _, w, _ in rows)
    mean = min(max(sum(w * y for _, w, y in rows) / total, 1e-4), 1 - 1e-4)
    start, trees = log(mean / (1 - mean)), []
    z = [start] * len(rows)

    def build(own: list[int], d: int):
        g = sum(rows[i][1] * (rows[i][2] - 1 / (1 + exp(-z[i]))) for i in own)
        h = sum(rows[i][1] * (p := 1 / (1 + exp(-z[i]))) * (1 - p) for i in own)
        best = None
        if d:
            for f in range(len(rows[0][0])):
                for v in sorted({rows[i][0][f] for i in own})[:-1]:
                    left = [i for i in own if rows[i][0][f] <= v]
                    gl = sum(rows[i][1] * (rows[i][2] - 1 / (1 + exp(-z[i]))) for i in left)
                    hl = sum(rows[i][1] * (p := 1 / (1 + exp(-z[i]))) * (1 - p) for i in left)
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, f, v, left)
        if best is None:
            return rate * max(-4.0, min(4.0, g / (h + 1)))
        inside = set(best[3])
        return best[1], best[2], build(best[3], d - 1), build([i for i in own if i not in inside], d - 1)

    for _ in range(rounds):
        tree = build(list(range(len(rows))), depth)
        trees.append(tree)
        z = [max(-30.0, min(30.0, a + value(tree, r[0]))) for a, r in zip(z, rows, strict=True)]
    return start, trees


def value(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def model(found: DataFrame, precision: float = 0.99) -> tuple[dict[tuple[int, ...], float], list[float]]:
    """Score of each combination of features and the threshold of each kind, from all judged spans. Without both labels nothing is added."""
    spans = found.select(F.explode("judged").alias("c")).select(*[F.col("c")[f].alias(f) for f in FEATURES], F.col("c")["label"].alias("label"))
    got = spans.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.avg("label").alias("share")).orderBy(*FEATURES).collect()  # at most 640 rows
    rows = [(tuple(r[f] for f in FEATURES), float(r["n"]), float(r["share"])) for r in got]
    if not rows or not 0 < sum(w * y for _, w, y in rows) < sum(w for _, w, _ in rows):
        return {}, [2.0] * len(KINDS)
    start, trees = grow(rows)
    scores = {}
    wanted = found.select(F.explode("proposed").alias("c")).select(*[F.col("c")[f].alias(f) for f in FEATURES]).distinct().collect()
    for x in {r[0] for r in rows} | {tuple(r) for r in wanted}:
        scores[x] = 1 / (1 + exp(-(start + sum(value(t, x) for t in trees))))
    cuts = []
    for k in range(len(KINDS)):
        own = sorted(((scores[x], w, y) for x, w, y in rows if x[0] == k), reverse=True)
        cut, true, all_ = 2.0, 0.0, 0.0
        for s, w, y in own:
            true, all_ = true + w * y, all_ + w
            if true >= precision * all_:
                cut = s
        cuts.append(cut if 0 < true < all_ else 2.0)
    return scores, cuts


def _score(c: Column, scores: dict[tuple[int, ...], float], cuts: list[float]) -> Column:
    """The trees folded into one lookup of all combinations that occur; the score where it reaches its kind's threshold, else null."""
    hits = {x: s for x, s in scores.items() if s >= max(0.5, cuts[x[0]])}
    if not hits:
        return F.lit(None).cast("double")
    key = F.concat_ws("-", *[c[f].cast("string") for f in FEATURES])
    table = F.create_map(*[F.lit(v) for x, s in sorted(hits.items()) for v in ("-".join(map(str, x)), s)])
    return F.try_element_at(table, key)


def redact_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.99) -> DataFrame:
    """One row for each row of docs: id, base and added, each array<struct<kind, start, end>> ordered by kind and start; kind is an index of KINDS."""
    found = staged(candidates(docs, id_col, text_col), "candidates")
    scores, cuts = model(found, precision)
    scored = F.filter(F.transform("proposed", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _score(c, scores, cuts).alias("score"))), lambda c: c["score"].isNotNull())
    rows = found.select("id", F.array_sort("base").alias("base"), scored.alias("scored"))
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter("scored", lambda c: ~F.exists("base", lambda b: touches(b, c)))
    rows = rows.withColumn("free", free)
    before = lambda a, b: (a["score"] > b["score"]) | (a["score"] == b["score"]) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["end"] > b["end"]))
    best = F.filter("free", lambda c: ~F.exists("free", lambda d: touches(c, d) & before(d, c)))
    added = F.array_sort(F.array_distinct(F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    return rows.select(F.col("id").alias(id_col), "base", added.alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans: Column) -> list[Column]:
    kinds = F.transform(spans, lambda s: s["kind"])
    return [(F.size(spans) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text with every span replaced by its kind in brackets; ids must be unique."""
    spans = redact_spans(docs, id_col, text_col)
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names, text = F.array(*[F.lit(f"[{k}]") for k in KINDS]), F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], ahead, F.when(fresh, F.element_at(names, s["kind"] + 1)).otherwise("")).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return docs.select(id_col, text_col).join(spans.select(id_col, ordered.alias("spans")), id_col).select(id_col, done.alias(text_col))
