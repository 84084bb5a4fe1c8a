"""Personal data in whole texts by bootstrapped contextual extraction; DataFrame functions only.

Base spans (e-mail, IP, card, phone) come from fixed patterns and are the seeds.  Every seed and
every other token with a digit or an at-sign is an instance that occurs in lexical patterns (digit
groups with single spaces between them, as in "(202) 555-0199", are one instance): the two words before it, the word before it with the word behind it, the two words around it with its
shape.  On the graph of patterns and instances, scores go back and forth: a pattern is worth the
share of its instances that are known to be of a kind, an instance what its patterns give it.
Unseen instances of high score become added spans wherever a pattern of high score surrounds them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop_table, write_table

# The kinds in order with their patterns.  Each is written so that the regular
# expression engine neither recurses nor starts again inside a run that has failed; they find what
# the plain patterns of the contract find.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
# digit groups joined by single spaces, dots, dashes or paired parentheses, not from within a word
RUN = (r"(?:(?=\()|(?<![\p{L}\p{N}@]))(?:\(\+?+[0-9]++(?:[\x20.-][0-9]++)*+\)|\+?+[0-9]++)"
       r"(?:[\x20.-]?+(?:\([0-9]++(?:[\x20.-][0-9]++)*+\)|[0-9]++))*+")
SPACED = r"[0-9]\)?\x20\(?[0-9]"       # what a text with a run of several tokens has somewhere
WINDOW = 80          # code points on either side that a pattern looks at
BLOCK = 64           # results that are copied together
PAGE = 512           # code points of a text that are read together
SPAN = "struct<start:bigint,end:bigint,kind:int,value:string>"
SEEN = "struct<start:bigint,end:bigint,kind:int,value:string,far:string,near:string,next:string>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none(fields: str = SPAN) -> Column:
    return F.from_json(F.lit("[]"), f"array<{fields}>")


def _running(values: Column, op) -> Column:
    """For each of an array of numbers, ``op`` over those before it (0 for the first).  Results are kept
    in blocks of ``BLOCK``, so that a step copies one block and not all before it."""
    def step(acc: Column, v: Column) -> Column:
        full = F.size(acc["block"]) >= BLOCK
        at = F.array(acc["at"])
        return F.struct(op(acc["at"], v).alias("at"),
                        F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"),
                        F.when(full, at).otherwise(F.concat(acc["block"], at)).alias("block"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), _none("array<bigint>").alias("done"), _none("bigint").alias("block"))
    return F.aggregate(values, zero, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, hint: Column, kind: int | None) -> Column:
    """Matches, leftmost and not overlapping, with offsets in code points (end exclusive): the
    running length of the gaps that ``split`` leaves and of the matches between them."""
    def place(x: Column) -> Column:
        gap = lambda i: F.length(F.get(x["g"], i))
        before = _running(F.transform(x["v"], lambda v, i: (gap(i) + F.length(v)).cast("long")), _sum)

        def span(at: Column, v: Column, i: Column) -> Column:
            start = at + gap(i)
            return F.struct(start.alias("start"), (start + F.length(v)).alias("end"),
                            F.lit(kind).cast("int").alias("kind"), v.alias("value"))
        return _let(before, lambda at: F.transform(x["v"], lambda v, i: span(F.get(at, i), v, i)))

    spans = _let(F.struct(F.split(text, pattern, -1).alias("g"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v")), place)
    return F.when(hint, spans).otherwise(_none())


def _pages(text: Column) -> Column:
    """The text in pieces of ``PAGE`` code points, so that a place in it is reached without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}+"), F.lit(0))


def _cut(pages: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive, at most the text's length) of a text in pages."""
    first, last = F.floor(start / PAGE).cast("int"), F.floor((end - 1) / PAGE).cast("int")

    def part(i: Column) -> Column:
        skip = F.greatest(start - i * PAGE, F.lit(0))
        return F.substring(F.coalesce(F.get(pages, i), F.lit("")), (skip + 1).cast("int"),
                           (F.least(end - i * PAGE, F.lit(PAGE)) - skip).cast("int"))
    return F.when(end > start, F.when(first == last, part(first)).otherwise(
        F.array_join(F.transform(F.sequence(first, last), part), ""))).otherwise(F.lit(""))


def _among(spans: Column, tokens: Column, keep) -> Column:
    """The tokens (disjoint) for which ``keep`` holds of: the token, the largest end of the spans that start
    no later, and the start of what comes next (null: nothing)."""
    mark = lambda which: lambda s: F.struct(
        s["start"].alias("start"), F.lit(which).alias("token"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["value"].alias("value"))
    events = F.sort_array(F.concat(F.transform(spans, mark(0)), F.transform(tokens, mark(1))))
    bare = lambda e: F.struct(*(e[c].alias(c) for c in ("start", "end", "kind", "value")))
    merged = _let(events, lambda es: _let(
        _running(F.transform(es, lambda e: F.when(e["token"] == 0, e["end"]).otherwise(F.lit(0).cast("long"))), F.greatest),
        lambda reach: F.transform(F.filter(es, lambda e, i: (e["token"] == 1) & keep(
            e, F.get(reach, i), F.get(es, i + 1)["start"])), bare)))
    return F.when((F.size(spans) > 0) & (F.size(tokens) > 0), merged).otherwise(tokens)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """array of (start, end, kind number, value) by start, then kind."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    small = lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3
    email = _found(text, EMAIL, F.contains(text, F.lit("@")), 0)
    ip = F.filter(_found(text, IP, text.rlike(r"[0-9]\.[0-9]"), 1), lambda s: F.forall(
        F.split(s["value"], r"\."), lambda p: small(p) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)))
    card = F.filter(_found(text, CARD, text.rlike(CARD), 2), lambda s: F.length(digits(s)).between(12, 19)
                    & F.when(F.length(digits(s)).between(12, 19), _luhn(digits(s))).otherwise(False))
    phone = F.filter(_found(text, PHONE, F.contains(text, F.lit("+")), 3),
                     lambda s: F.length(digits(s)).between(9, 15))
    return F.sort_array(F.concat(email, ip, card, phone))


def _word(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")


def _contexts(pages: Column, n_chars: Column, spans: Column) -> Column:
    """Spans with the last two words before and the first word behind them."""
    def around(s: Column) -> Column:
        before = F.split(F.rtrim(_cut(pages, F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"])), r"\s+")
        behind = F.regexp_extract(_cut(pages, s["end"], F.least(s["end"] + WINDOW, n_chars)), r"\S*[\p{L}\p{N}]\S*", 0)
        return _let(before, lambda b: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lower(s["value"]).alias("value"),
            _word(F.coalesce(F.get(b, F.size(b) - 2), F.lit(""))).alias("far"),
            _word(F.coalesce(F.get(b, F.size(b) - 1), F.lit(""))).alias("near"), _word(behind).alias("next")))
    return F.transform(spans, around)


def _masked(text: Column, pages: Column, n_chars: Column, base: Column) -> Column:
    """The text with every code point of a base span as ``#``: the gaps between spans and their masks, joined once."""
    def piece(s: Column, at: Column) -> Column:
        return F.concat(_cut(pages, at, s["start"]),
                        F.repeat(F.lit("#"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int")))

    joined = _let(_running(F.transform(base, lambda s: s["end"]), F.greatest), lambda reach: F.concat(
        F.array_join(F.transform(base, lambda s, i: piece(s, F.get(reach, i))), ""),
        _cut(pages, F.array_max(F.transform(base, lambda s: s["end"])), n_chars)))
    return F.when(F.size(base) > 0, joined).otherwise(text)


def _runs(text: Column, masked: Column) -> Column:
    """Runs of digit groups over several tokens, from the text between the base spans."""
    found = _found(masked, RUN, text.rlike(SPACED), None)

    def bare(s: Column) -> Column:          # parentheses around the whole run are outer punctuation
        cut = F.when(s["value"].rlike(r"^\([^()]*+\)$"), F.lit(1)).otherwise(F.lit(0))
        return F.struct((s["start"] + cut).alias("start"), (s["end"] - cut).alias("end"), s["kind"].alias("kind"),
                        F.substring(s["value"], cut + 1, F.length(s["value"]) - 2 * cut).alias("value"))

    return F.filter(F.transform(found, bare), lambda s: F.contains(s["value"], F.lit(" ")) & (F.length(s["value"]) >= 4))


def _others(text: Column, pages: Column, n_chars: Column, base: Column) -> Column:
    """Tokens with a digit or an at-sign that touch no base span, without outer punctuation; tokens
    within a run of digit groups are that run."""
    raw = _found(text, TOKEN, text.rlike("[0-9@]"), None)

    def trim(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}+]*+", 0))
        core = F.regexp_replace(F.substring(s["value"], lead + 1, F.length(s["value"])), r"[^\p{L}\p{N}]++$", "")
        start = s["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), s["kind"].alias("kind"), core.alias("value"))

    tokens = _let(F.filter(F.transform(raw, trim), lambda s: F.length(s["value"]) >= 4), lambda some: _among(
        base, some, lambda s, reach, then: (reach <= s["start"]) & F.coalesce(then >= s["end"], F.lit(True))))
    runs = _runs(text, _masked(text, pages, n_chars, base))
    return _let(F.struct(runs.alias("r"), tokens.alias("t")), lambda x: F.concat(
        x["r"], _among(x["r"], x["t"], lambda s, reach, then: reach < s["end"])))


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, base, seen``: base spans, and all instances with their contexts."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", F.md5("text").alias("text_key"), "text", base_spans(F.col("text")).alias("base"))
    # a second scan step, so that the base spans are worked out once
    seen = _let(F.struct(_pages(F.col("text")).alias("p"), F.length("text").cast("long").alias("n")), lambda x: _contexts(
        x["p"], x["n"], F.concat("base", _others(F.col("text"), x["p"], x["n"], F.col("base")))))
    return d.select("doc_id", "text_key", "base", F.when(F.col("text").rlike("[0-9@]"), seen).otherwise(
        _none(SEEN)).alias("seen"))


def _patterns() -> Column:
    shape = F.regexp_replace(F.regexp_replace(F.col("value"), "[0-9]+", "9"), r"\p{L}+", "a")
    join = lambda *c: F.concat_ws(" ", *c)
    return F.filter(F.array(
        F.when((F.col("far") != "") & (F.col("near") != ""), join(F.lit("2"), "far", "near")),
        F.when((F.col("near") != "") & (F.col("next") != ""), join(F.lit("1"), "near", F.lit("_"), "next")),
        F.when(F.col("near") != "", join(F.lit("s"), "near", F.lit("_"), shape))), lambda p: p.isNotNull())


def bootstrap(instances: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8) -> tuple[DataFrame, list[str]]:
    """(pattern, value, kind) of the unseen instances that the graph trusts, and the folders written.

    A pattern's score for a kind is the summed score of its distinct instances over their number
    plus one half, if at least ``support`` of them count; an instance's is one minus the product of
    what its patterns leave open.  Scores below ``trust`` count as none.  Seeds stay at one."""
    edges, e_path = write_table(
        instances.select("value", "kind", F.explode(_patterns()).alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pattern-graph")
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    links = edges.select("pattern", "value")
    known, made, patterns = seeds, [e_path], None
    for _ in range(rounds):
        patterns, p_path = write_table(
            links.join(known, "value").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= support)
            .join(total, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 0.5)).alias("score"))
            .where(F.col("score") >= trust), "patterns")
        # the fourth decimal place: the order in which a sum is formed must decide nothing
        grown = (links.join(patterns, "pattern").join(seeds.select("value").distinct(), "value", "left_anti")
                 .groupBy("value", "kind").agg(F.sum(F.log(1.0001 - F.col("score"))).alias("open"))
                 .select("value", "kind", F.round(1 - F.exp("open"), 4).alias("score")).where(F.col("score") >= trust))
        best = grown.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        learned, l_path = write_table(best.select("value", (-F.col("b.k")).alias("kind"), "b.score"), "learned")
        made += [p_path, l_path]
        known = seeds.unionByName(learned)
    return (links.join(learned.select("value", "kind"), "value")
            .join(patterns.select("pattern", "kind"), ["pattern", "kind"]).select("pattern", "value", "kind")), made


def find(docs: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, base, added`` for every row: arrays of (start, end, kind number, value).

    A null text is empty and has no spans; equal texts have equal spans; repeated rows and null ids
    are kept; an empty table gives no rows.  Added spans never touch a base span.  Only the two
    named columns are read."""
    spark = docs.sparkSession
    t, t_path = write_table(extract(docs, id_col, text_col), "spans")
    seen = t.where(F.size("seen") > 0).dropDuplicates(["text_key"]).select(
        "text_key", F.explode("seen").alias("s")).select("text_key", "s.*")
    instances, i_path = write_table(seen, "instances")
    trusted, made = bootstrap(instances, rounds, support, trust)
    new = (instances.where("kind IS NULL").drop("kind").withColumn("pattern", F.explode(_patterns()))
           .join(trusted, ["pattern", "value"])
           .groupBy("text_key", "start", "end", "value").agg(F.min("kind").alias("kind")))
    added = new.groupBy("text_key").agg(F.sort_array(F.collect_set(
        F.struct("start", "end", F.col("kind").cast("int").alias("kind"), "value"))).alias("added"))
    out, _ = write_table(t.join(added, "text_key", "left").select(
        "doc_id", "text_key", "base", F.coalesce("added", _none()).alias("added")), "found")
    for p in (t_path, i_path, *made):
        drop_table(spark, p)
    return out


def digest(found: DataFrame) -> DataFrame:
    name = F.array(*map(F.lit, KINDS))
    by_start = lambda spans: F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.concat_ws(
            ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(KINDS))),
                        F.sha2(F.array_join(by_start(F.col("base")), ","), 256).alias("base_sha256"),
                        F.array_join(by_start(F.concat("base", "added")), ",").alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span (overlapping ones as one, named by the longest) replaced by its kind in
    brackets, and ``n_chars``, if there is such a column, counted again.  All rows and columns stay."""
    spans = (found.where(F.size(F.concat("base", "added")) > 0).dropDuplicates(["text_key"])
             .select("text_key", F.sort_array(F.concat("base", "added")).alias("spans")))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row")[text_col]

    def widen(last: Column, s: Column) -> Column:
        longer = s["end"] - s["start"] > last["end"] - last["start"]
        return F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                        F.when(longer, s["kind"]).otherwise(last["kind"]).alias("kind"))

    def groups(x: Column, reach: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["start"] >= F.get(reach, i))

        def group(at: Column, b: Column, j: Column) -> Column:
            first = F.get(x, b)
            return F.aggregate(F.sequence(b, F.coalesce(F.get(at, j + 1), F.size(x)) - 1),
                               F.struct(first["start"].alias("start"), first["end"].alias("end"), first["kind"].alias("kind")),
                               lambda last, i: widen(last, F.get(x, i)))
        return _let(begins, lambda at: F.transform(at, lambda b, j: group(at, b, j)))

    merged = _let(F.col("spans"), lambda x: _let(
        _running(F.transform(x, lambda s: s["end"]), F.greatest), lambda reach: groups(x, reach)))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    pages = F.col("pages")

    def piece(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(F.col("merged"), i - 1)["end"], F.lit(0).cast("long"))
        return F.concat(_cut(pages, at, s["start"]), F.get(name, s["kind"]))

    tail = _cut(pages, F.element_at("merged", -1)["end"], F.length(text).cast("long"))
    out = (d.withColumn("text_key", F.md5(F.coalesce(text, F.lit("")))).join(spans, "text_key", "left")
           .withColumn("merged", F.when(F.col("spans").isNotNull(), merged))
           .withColumn("pages", F.when(F.col("spans").isNotNull(), _pages(text)))
           .select("row", F.when(F.col("merged").isNotNull(), F.concat(
               F.array_join(F.transform("merged", piece), ""), tail)).alias("new")))
    row = F.col("row").withField(text_col, F.coalesce("new", text))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType),
                                                  F.col("row")["n_chars"]))
    return out.select(row.alias("row")).select("row.*")
