"""Personal data by bootstrapped contextual extraction: validated matches are seeds, the words before them are patterns,
pattern-instance graphs are scored in rounds, and trusted patterns find identifiers that no rule knows. DataFrame
functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, hot_join, stage

#: Kinds in the order of the digests; secrets come from the method alone.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The base rules. Possessive forms and the look-behinds match what the plain patterns do (a run can't match from its
#: middle where it doesn't from its start), in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that any text with a match passes.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A mention: a word with a digit or an at sign. A seed of the kind secret: a long hexadecimal string.
MENTION, SECRET = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "^[0-9a-f]{32,}$"
#: What a trusted pattern may find: an address, four digits or more, or a long run of letters and digits.
SHAPE = r"@[A-Za-z0-9-]+\.|[0-9].*[0-9].*[0-9].*[0-9]|^[A-Za-z0-9_-]{16,}$"
SPAN = "array<struct<kind:int,start:int,end:int>>"
#: Code points in a block of a text that spans are cut from; a binary search's steps, for arrays of up to 2^31 entries.
CUT, STEPS = 2048, [1 << b for b in range(30, -1, -1)]


@dataclass(frozen=True)
class PiiParams:
    rounds: int = 3
    #: A pattern needs so many known instances of its kind, and they so large a share of all its instances.
    support: int = 3
    trust: float = 0.75
    #: Code points before a mention in which its two words of context are taken: of longer words their ends count.
    reach: int = 80


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, plus) -> Column:
    """For each entry of an array<int>, the sum (or another associative `plus` with 0 as its start) of those before it. A
    fold that appends copies its array each time, so it runs in blocks of about the root of the size, and once over the
    blocks' totals."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def fold(block: Column) -> Column:
        return F.aggregate(block, none, lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))

    def joined(blocks: Column) -> Column:
        return _let(fold(F.transform(blocks, lambda x: x["at"]))["all"], lambda off: F.flatten(F.transform(blocks, lambda x, k: F.transform(x["all"], lambda y: plus(y, F.get(off, k))))))

    def cut(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda k: fold(F.slice(v, k * step + 1, step)))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(_let(blocks, joined))

    return _let(values, cut)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost matches m with their places in code points; with `context` also so many code points before each."""
    between = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    both = F.filter(between, lambda x: x["m"].isNotNull())

    def placed(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = F.get(ahead, i) + F.length(x["p"])
            parts = [start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m")]
            if context:
                # two earlier matches, which are words, and what lies between hold the two words before
                near = [F.get(b, i - 2)["m"], F.get(b, i - 1)["p"], F.get(b, i - 1)["m"], x["p"]]
                parts.append(F.substring(F.concat(*[F.coalesce(F.substring(y, -context, context), F.lit("")) for y in near]), -context, context).alias("before"))
            return F.struct(*parts)

        ahead: Column

        def with_ahead(found: Column) -> Column:
            nonlocal ahead
            ahead = found
            return F.transform(b, one)

        return _let(_before(F.transform(b, lambda x: F.length(x["p"]) + F.length(x["m"])), _add), with_ahead)

    return _let(both, placed)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(digits.substr(F.length(digits) - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def _base(text: Column) -> Column:
    """For each kind an array<struct<kind,start,end>> of its rule's matches, by start. The kind is its number."""
    parts = []
    for number, kind in enumerate(PATTERNS):
        found = F.filter(_matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        rows = F.transform(found, lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        parts.append(F.when(text.rlike(HINTS[kind]), rows).otherwise(F.array().cast(SPAN)))
    return F.array(*parts)


def _last_before(spans: Column, end: Column) -> Column:
    """The last of an array of spans, sorted by start, that starts before `end`; null if none does."""
    steps = F.lit(STEPS)
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(step > F.size(spans) - low, low).when(F.get(spans, low + step - 1)["start"] < end, low + step).otherwise(low))
    return F.when(F.size(spans) > 0, F.get(spans, found - 1))


def _mentions(text: Column, base: Column, reach: int) -> Column:
    """array<struct<start,end,core,context,kind>> of the words with a digit or an at sign; those that start inside a base
    match or overlap one otherwise than by starting with it are left out. Matches of one kind don't overlap, so the last
    one that starts before a mention's end tells whether any does."""

    def mention(x: Column) -> Column:
        lead = F.regexp_extract(x["m"], "^[^A-Za-z0-9+]*+", 0)
        core = F.regexp_replace(F.substr(x["m"], F.length(lead) + 1), "[^A-Za-z0-9]++$", "")
        # the two words before, of the text itself: other mentions are words as any
        words = F.slice(F.reverse(F.filter(F.split(F.lower(x["before"]), r"\s+", -1), lambda w: w != "")), 1, 2)
        start = x["start"] + F.length(lead)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), F.array_join(F.reverse(words), " ").alias("context"))

    def judged(x: Column) -> Column:
        kinds = [F.get(base, F.lit(k)) for k in range(len(PATTERNS))]
        inside = F.lit(False)
        for spans in kinds:
            inside = inside | F.coalesce(_last_before(spans, x["end"])["end"] > x["start"], F.lit(False))
        seed = F.coalesce(*[_let(_last_before(spans, x["start"] + 1), lambda b: F.when(b["start"] == x["start"], b["kind"])) for spans in kinds])
        secret = F.when(x["core"].rlike(SECRET), F.lit(len(KINDS) - 1))
        return _let(inside, lambda over: F.struct(*[x[c].alias(c) for c in ("start", "end", "core", "context")], F.when(over, seed).otherwise(secret).alias("kind"), over.alias("inside")))

    found = F.transform(F.transform(_matches(text, MENTION, reach), mention), judged)
    return F.filter(found, lambda x: ((x["context"] != "") | x["kind"].isNotNull()) & (x["core"] != "") & (~x["inside"] | x["kind"].isNotNull()))


def _learn(edges: DataFrame, p: PiiParams) -> DataFrame:
    """Trusted patterns (context, kind, n, rows), from edges (context, core, kind, rows). In each round a pattern's score
    for a kind is the share of its instances known to be of that kind; an instance takes the kind of its best trusted
    pattern and counts as known in the next round."""
    for _ in range(p.rounds):
        kinds = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(KINDS))]
        counted = edges.groupBy("context").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), *kinds)
        best = F.array_max(F.array(*[F.struct(F.col(f"k{k}").alias("f"), F.lit(-k).alias("k")) for k in range(len(KINDS))]))
        scored = counted.select("context", "n", "rows", best.alias("best"))
        trusted = scored.filter((F.col("best.f") >= p.support) & (F.col("best.f") >= p.trust * F.col("n"))).select("context", "n", "rows", (-F.col("best.k")).alias("pattern_kind"), (F.col("best.f") / F.col("n")).alias("score"))
        trusted = stage(trusted, "pii-patterns")
        total = edges.count()
        open_edges = edges.filter("kind is null").filter(F.col("core").rlike(SHAPE))
        met = hot_join(open_edges, trusted.select("context", "n", "pattern_kind", "score"), "context", "n", total)
        # of equal scores the kind that comes first
        promoted = met.groupBy("core").agg(F.max(F.struct("score", (-F.col("pattern_kind")).alias("k"))).alias("best"), F.count("*").alias("n"))
        promoted = stage(promoted.select("core", "n", (-F.col("best.k")).alias("new_kind")), "pii-promoted")
        if not promoted.limit(1).count():
            break
        edges = stage(hot_join(edges, promoted, "core", "n", total, "left").withColumn("kind", F.coalesce("kind", "new_kind")).drop("new_kind"), "pii-edges")
    return trusted


def pii_spans(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """_doc, _text, base and spans of each document: arrays of (kind, start, end), by kind and start, in code points,
    ends exclusive. `base` holds the rules' matches; `spans` these and what trusted patterns found.

    Null and empty texts have no spans; a null doc_id is an id of its own; repeated rows are rows of their own. A
    text's matches are as many as it has; no cap applies but p.reach, to the context before each. Patterns and instances are counted over all documents, once for
    each distinct pair, so a frequent one costs a row for each partition; joins broadcast the few hot keys. Other columns
    are not read.
    """
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_doc"), F.xxhash64("text").alias("_text"), body.alias("_t"))
    based = rows.withColumn("parts", F.when(F.col("_t").rlike("[0-9@]"), _base(F.col("_t"))).otherwise(F.array(*[F.array().cast(SPAN)] * len(PATTERNS))))
    none = F.array().cast("array<struct<start:int,end:int,core:string,context:string,kind:int,inside:boolean>>")
    found = F.when(F.col("_t").rlike("[0-9@]"), _mentions(F.col("_t"), F.col("parts"), p.reach)).otherwise(none)
    known = stage(based.select("_doc", "_text", F.flatten("parts").alias("base"), found.alias("mentions")), "pii-known")
    mentions = known.filter("size(mentions) > 0").select("_doc", "_text", F.explode("mentions").alias("x")).select("_doc", "_text", "x.*")
    mentions = stage(mentions, "pii-mentions")
    edges = stage(mentions.groupBy("context", "core").agg(F.max("kind").alias("kind"), F.count("*").alias("rows")), "pii-edges")
    trusted = _learn(edges, p)
    unseen = mentions.filter("kind is null").filter(F.col("core").rlike(SHAPE)).select("_doc", "_text", "context", "start", "end")
    secrets = mentions.filter(F.col("kind") == len(KINDS) - 1).select("_doc", "_text", "start", "end", F.col("kind"))
    found = hot_join(unseen, trusted.select("context", "rows", F.col("pattern_kind").alias("kind")), "context", "rows", mentions.count())
    more = found.select("_doc", "_text", "start", "end", "kind").unionByName(secrets)
    more = more.groupBy("_doc", "_text").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    joined = known.select("_doc", "_text", "base").join(more, ["_doc", "_text"], "left")
    return joined.select("_doc", "_text", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def _digest(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """docs with each span of text replaced by <KIND>, overlapping spans by the first one's, and n_chars counted anew.

    Null texts stay null, null ids are ids of their own, repeated rows are redacted alike and all stay; other columns are
    carried as they are, whatever their names. Cost is about linear in a text and in its spans."""
    found = stage(pii_spans(docs, p).filter("size(spans) > 0").select("_doc", "_text", "spans").dropDuplicates(["_doc", "_text"]), "pii-found")
    # the row travels whole, so none of its columns can clash with those used here
    keys = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_doc"), F.xxhash64("text").alias("_text"), F.col("text").alias("_t"), F.struct(*docs.columns).alias("_row"))
    # spans hold a digit or an at sign; only such texts are shuffled, at every size
    maybe = F.coalesce(F.col("_t").rlike("[0-9@]"), F.lit(False))
    rest = keys.filter(~maybe).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    joined = keys.filter(maybe).join(found.hint("merge"), ["_doc", "_text"], "left").unionByName(rest)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cleaned(blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """Code points a to b of the text, from the blocks that hold them."""
            first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
            return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), a - first * CUT + 1, b - a)

        def of(order: Column) -> Column:
            def pieces(ahead: Column) -> Column:
                kept = F.transform(order, lambda s, i: F.when(s["start"] >= F.get(ahead, i), F.concat(cut(F.get(ahead, i), s["start"]), F.get(tags, s["kind"]))))
                return F.array_join(kept, "")

            ends = F.transform(order, lambda s: s["end"])
            return F.concat(_let(_before(ends, F.greatest), pieces), cut(F.array_max(ends), F.length("_t")))

        return _let(spans, of)

    clean = _let(F.regexp_extract_all("_t", F.lit("(?s).{1,%d}" % CUT), F.lit(0)), cleaned)
    out = joined.withColumn("_clean", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("_t")))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.col("spans").isNotNull(), F.length("_clean").cast("bigint")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])


def op8_bootstrapped(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    out = pii_spans(docs).select(F.when(F.col("_doc") != LAST_ID, F.col("_doc")).alias("doc_id"), *[count(k) for k in PATTERNS], F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"))
    return out
