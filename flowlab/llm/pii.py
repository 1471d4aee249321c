"""Personal data: pattern matches, and terms that reveal them.

Base spans are e-mail addresses, IPv4 addresses, card numbers (16 to 19 digits
that pass Luhn's test) and phone numbers, leftmost and without overlap within a
kind; a match that fails its test is dropped without a second try. No match
crosses a line feed, so lines are searched one by one.

Around them, information theory decides. Over all documents, a term t and a
protected entity e stand together in ``together`` documents, and t in ``n``. The
share (together - ``discount``) / n is a cautious estimate of p(e|t): one meeting
says little, more say more. Where t tells at least ``min_gain_bits`` of e,
log2 p(e|t) / p(e), and leaves at most ``max_hidden_bits`` of it hidden, -log2 p(e|t),
t discloses e and is a span of kind ``term`` wherever it stands, in documents of e
and in others. Terms are runs of letters, lower-cased, outside e-mail addresses.
With the defaults a pair that met once never discloses, one that met twice does
if the term stands nowhere else; no common word discloses a common entity.

Entities that stand in the same documents disclose alike, so one of them is
paired with terms for all; entities of one document are not paired at all.
``sanitise`` writes the kind in place of base spans (generalised) and takes
disclosing terms out (removed).

Everything is built from DataFrame functions. Offsets are code points, end
exclusive. Defined results: null and empty texts have no spans (a null text
stays null); texts of any length are searched whole; rows are told apart by
their place in the input, so repeated rows and ids each get their result; an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, with_row

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"A-Za-z0-9._%+-"
#: What each kind matches. The looks behind and possessive repeats change no
#: match; they keep long runs from being tried at each of their characters.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes_luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def _accepted(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    return (F.when(kind == "email", True)
            .when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(kind == "card", F.when(F.length(digits).between(16, 19), _passes_luhn(digits)).otherwise(False))
            .otherwise(F.length(digits).between(8, 15)))


def entity_lines(docs: DataFrame) -> DataFrame:
    """(row, line_no, start, line, found) of (row, text): lines that could hold a match, with
    their place in the text, and per kind the matches and the text between."""
    lines = F.split("text", "\n", -1)
    some = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))),
                    lambda s: s["line"].contains("@") | s["line"].rlike("[0-9]"))
    placed = F.transform(some, lambda s: F.struct(
        s["i"].alias("line_no"),
        F.when(s["i"] == 0, 0).otherwise(F.length(F.call_function("substring_index", F.col("text"), F.lit("\n"), s["i"])) + 1).alias("start"),
        s["line"].alias("line")))
    rows = (docs.select("row", "text").filter(F.col("text").contains("@") | F.col("text").rlike("[0-9]"))
            .select("row", F.explode(placed).alias("l")).select("row", "l.*"))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(kind, F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))
    return rows.filter(F.greatest(*(F.size(k) for k in PATTERNS)) > 0)


def base_spans(lines: DataFrame) -> DataFrame:
    """(row, line_no, kind, start, end, value) of accepted matches."""
    parts = None
    for kind, pattern in PATTERNS.items():
        pieces = F.split("line", pattern, -1)
        pair = F.transform(F.col(kind), lambda m, i: F.struct(F.length(F.element_at(pieces, i + 1)).alias("gap"), m.alias("value")))
        part = lines.filter(F.size(kind) > 0).select(
            "row", "line_no", "start", F.lit(kind).alias("kind"), F.posexplode(pair).alias("i", "m"))
        parts = part if parts is None else parts.unionByName(part)
    before = Window.partitionBy("row", "line_no", "kind").orderBy("i")
    value = F.col("m.value")
    end = F.col("start") + F.sum(F.col("m.gap") + F.length(value)).over(before)
    return (parts.withColumn("end", end.cast("long"))
            .filter(_accepted(F.col("kind"), value))
            .select("row", "line_no", "kind", (F.col("end") - F.length(value)).cast("long").alias("start"), "end", value.alias("value")))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_remove(F.array_distinct(F.split(F.lower(plain), r"[^\p{L}]+")), "")


def paired_entities(spans: DataFrame) -> DataFrame:
    """(row, entity, seen) of entities that stand in two documents or more (``seen``
    of them), one for each set of documents."""
    found = spans.select("row", F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct()
    sets = found.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"),
                                       F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    chosen = sets.filter("n > 1").groupBy("n", "a", "b").agg(F.min("entity").alias("entity")).select("entity", F.col("n").alias("seen"))
    return found.join(chosen, "entity").select("row", "entity", "seen")


def disclosing_terms(docs: DataFrame, spans: DataFrame, *, discount: float = 0.75, max_hidden_bits: float = 1.0,
                     min_gain_bits: float = 1.0) -> DataFrame:
    """(term,) of the terms that give an entity away; ``docs`` has row and text."""
    entities = stored(paired_entities(spans), "entities")
    counts = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    near = docs.join(entities.select("row").distinct(), "row", "left_semi")
    together = (near.select("row", F.explode(terms_of(F.col("text"))).alias("term")).join(entities, "row")
                .groupBy("entity", "seen", "term").agg(F.count("*").alias("together")).filter("together > 1"))
    share = (F.col("together") - discount) / F.col("n")
    gain = F.log2(share / (F.col("seen") / F.lit(docs.count())))
    return (together.join(counts, "term").filter((-F.log2(share) <= max_hidden_bits) & (gain >= min_gain_bits))
            .select("term").distinct())


def term_spans(docs: DataFrame, spans: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(row, kind, start, end) of disclosing terms wherever they stand."""
    told = stored(docs.select("row", F.explode(terms_of(F.col("text"))).alias("term")).join(disclosing, "term", "left_semi"), "told")
    lines = (docs.join(told.select("row").distinct(), "row", "left_semi")
             .select("row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
             .withColumn("start", F.sum(F.length("line") + 1).over(Window.partitionBy("row").orderBy("line_no")) - F.length("line") - 1))
    # runs of letters and runs of others, in turn
    pieces = F.split("line", r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})", -1)
    order = Window.partitionBy("row", "line_no").orderBy("i")
    parts = (lines.select("row", "line_no", "start", F.posexplode(pieces).alias("i", "piece"))
             .withColumn("end", (F.col("start") + F.sum(F.length("piece")).over(order)).cast("long"))
             .withColumn("term", F.lower("piece")))
    found = parts.join(told, ["row", "term"], "left_semi")
    found = found.select("row", F.lit("term").alias("kind"), (F.col("end") - F.length("piece")).cast("long").alias("start"), "end")
    # a term within a base span is covered already
    covering = spans.select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    return found.join(covering, (found["row"] == covering["row"]) & (found["start"] >= covering["s"]) & (found["end"] <= covering["e"]), "left_anti")


def find(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind number, start, end, kind) by
    kind as in ``KINDS``, then start."""
    docs = docs.drop("spans")
    key = fresh(docs.columns, "__row")
    marked = with_row(docs, key)
    texts = marked.select(F.col(key).alias("row"), "text")
    spans = stored(base_spans(stored(entity_lines(texts), "lines")), "spans")
    disclosing = stored(disclosing_terms(texts, spans, **limits), "disclosing")
    every = spans.select("row", "kind", "start", "end").unionByName(term_spans(texts, spans, disclosing))
    number = F.expr("case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end")
    by_row = every.groupBy(F.col("row").alias(key)).agg(
        F.array_sort(F.collect_set(F.struct(number.alias("number"), "start", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<number:int,start:bigint,end:bigint,kind:string>>")
    return (marked.join(by_row, key, "left").drop(key)
            .withColumn("spans", F.coalesce("spans", none)))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with ``text`` cleaned: base spans become their kind in brackets,
    disclosing terms go. Of spans that overlap, the first (then longest) counts,
    up to where the last of them ends."""
    found = find(docs, **limits)
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("z"), s["kind"].alias("kind"))))
    step = "struct<out:array<string>,at:bigint>"

    def add(acc: Column, s: Column) -> Column:
        end = -s["z"]
        mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int"))
        return F.when(s["a"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], end).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], F.array(gap, mark)).alias("out"), end.alias("at")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at")).cast(step)
    cleaned = F.aggregate(ordered, start, lambda acc, s: add(acc, s).cast(step),
                          lambda acc: F.concat(F.array_join(acc["out"], ""),
                                               F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text"))).drop("spans")
