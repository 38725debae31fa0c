"""Personal data in texts: fixed patterns as seeds, and identifiers that contexts learned from them point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.normalize import once
from weft.llm.common import having, lacking, row_key, written

#: Fixed kinds in the order of the results, with Java patterns. They find the same spans as the plain patterns, but in one pass:
#: a look-behind starts them only where a run starts (or the last match ended), and possessive parts never go back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ \-])[0-9](?:[ \-]?[0-9]){15,18}+(?![ \-]?[0-9])"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
#: Seeds that are no base kind: long hexadecimal strings, as keys and tokens are.
SECRET = r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])"
BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "secret")
#: An identifier to be: a telephone or card number with its spaces, else a word with a digit or an @. Groups: what stands before it, as far as LEFT characters
#: (the first group) or the text's beginning (the second) reach, and behind it. Only words that lie in there whole become contexts.
LEFT, RIGHT = 72, 48
_WORD, _SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
TOKEN = rf"(?s)(?<!{_WORD})(?=[^\x20\x09-\x0D0-9@]*+[0-9@])(?:(?<=(.{{{LEFT}}}))|(?<=\A(.{{0,{LEFT - 1}}})))(?:{PHONE}|[0-9](?:[ \-]?[0-9]){{15,18}}+(?![0-9])|{_WORD}++)(?=(.{{0,{RIGHT}}}))"

#: Rounds of scoring, different instances that a pattern needs, its least score, an instance's least score.
ROUNDS, SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 4, 0.7, 0.75
#: Elements of an array that are summed up in one step.
STEP = 64


def running(sizes: Column) -> Column:
    """Sums of the elements before each element of an array of integers: first over steps of elements, then within each, which keeps the copies short."""

    def sums(steps: Column) -> Column:
        totals = F.transform(steps, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x))
        empty = F.array().cast("array<int>")
        grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        begins = F.aggregate(totals, F.struct(F.lit(0).alias("at"), empty.alias("out")), grow)["out"]
        return F.flatten(F.zip_with(steps, begins, lambda s, b: F.aggregate(s, F.struct(b.alias("at"), empty.alias("out")), grow)["out"]))

    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STEP).cast("int")), lambda k: F.slice(sizes, k * STEP + 1, F.lit(STEP)))
    return F.when(F.size(sizes) > 0, once(steps, sums)).otherwise(F.array().cast("array<int>"))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches: the parts between them give their places, in code points."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), m.alias("found")))

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: p["gap"] + F.coalesce(p["long"], F.lit(0))))
        return F.zip_with(F.filter(pairs, lambda p: p["found"].isNotNull()), before, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["long"]).alias("end"), p["found"].alias("found")))

    return F.filter(once(pairs, placed), lambda s: s["start"].isNotNull())


def _luhn(digits: Column) -> Column:
    backwards = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the base kinds, by kind and start; kind is the place in KINDS."""

    def kept(kind: int, spans: Column, test=None) -> Column:
        spans = F.filter(spans, test) if test is not None else spans
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    email = F.when(F.contains(text, F.lit("@")), kept(0, _places(text, EMAIL))).otherwise(none)

    def small(part: Column) -> Column:
        value = F.regexp_replace(part, "^0+", "")
        return (F.length(value) <= 3) & (F.concat(F.lit("0"), F.substring(value, 1, 3)).cast("int") <= 255)

    ip = kept(1, _places(text, IP), lambda s: F.forall(F.split(s["found"], r"\."), small))
    card = kept(2, _places(text, CARD), lambda s: _luhn(_digits(s["found"])))
    phone = F.when(F.contains(text, F.lit("+")), kept(3, _places(text, PHONE), lambda s: F.length(_digits(s["found"])).between(8, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def _shape(words: Column) -> Column:
    """A context as patterns see it: lower case, digits as 0, what looks like a name (a capital behind the first word) as a sign."""
    return F.transform(words, lambda w: F.regexp_replace(F.lower(F.regexp_replace(w, r"^\p{Lu}\p{Ll}+$", "^")), "[0-9]+", "0"))


def _kind(word: Column) -> Column:
    """The kind that the fixed patterns see in a word, null for none."""
    digits = _digits(word)
    small = F.forall(F.split(word, r"\."), lambda x: (F.length(x) <= 3) & F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    base = F.when(word.rlike(EMAIL), 0).when(word.rlike(rf"^{IP}$") & small, 1).when(word.rlike(rf"^{CARD}$") & _luhn(digits), 2)
    return base.when(word.rlike(rf"^{PHONE}$") & F.length(digits).between(8, 15), 3).when(word.rlike(SECRET), 4)


def _contexts(left: Column, right: Column) -> Column:
    """The one, two and three words before a word, and the word before it with the word behind it."""

    def patterns(words: Column) -> Column:
        last = lambda n: F.when(F.size(words[0]) >= n, F.concat(F.array_join(F.slice(words[0], -n, n), " "), F.lit(" *")))
        around = F.when((F.size(words[0]) >= 1) & (F.size(words[1]) >= 1), F.concat(F.element_at(words[0], -1), F.lit(" * "), F.get(words[1], 0)))
        return F.filter(F.array(last(1), last(2), last(3), around), lambda c: c.isNotNull())

    split = lambda c: _shape(F.filter(F.split(c, rf"{_SPACE}+"), lambda w: w != ""))
    return once(F.array(split(left), split(right)), patterns)


def _candidates(text: Column) -> Column:
    """Words that look like identifiers: array<struct<start, end, token, kind, contexts>>, kind null for what the fixed patterns don't know."""
    group = lambda k: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(k))
    around = F.zip_with(F.zip_with(group(1), group(2), lambda x, y: F.struct(x.alias("l"), y.alias("begin"))), group(3), lambda x, r: F.struct(F.concat(F.regexp_replace(x["l"], rf"^{_WORD}*{_SPACE}?", ""), x["begin"]).alias("l"), F.when(F.length(r) == RIGHT, F.regexp_replace(r, rf"{_WORD}*$", "")).otherwise(r).alias("r")))
    joined = F.zip_with(_places(text, TOKEN), around, lambda s, c: F.struct(s["start"].alias("start"), s["found"].alias("found"), c.alias("c")))

    def told(s: Column) -> Column:
        start = s["start"] + F.length(F.regexp_extract(s["found"], r"^[^A-Za-z0-9+@]*", 0))
        inner = F.regexp_extract(s["found"], r"(?s)^[^A-Za-z0-9+@]*(.*?)[^A-Za-z0-9]*$", 1)
        return once(F.struct(start.alias("start"), inner.alias("token")), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["token"])).alias("end"), x["token"].alias("token"), _kind(x["token"]).alias("kind"), _contexts(s["c"]["l"], s["c"]["r"]).alias("contexts")))

    return F.filter(F.transform(joined, told), lambda c: c["token"] != "")


def scan(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over whole texts: (id, k1, k2, base, candidates), written. k1 and k2 tell rows apart by id and text."""
    given = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_w_text"))
    seen = F.when(F.col("_w_text").rlike("[0-9@]"), _candidates(F.col("_w_text")))
    return written(given.select("id", *row_key(F.col("id"), F.col("_w_text")), base_spans(F.col("_w_text")).alias("base"), seen.alias("candidates")))


def learned(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, pattern_score: float = PATTERN_SCORE, instance_score: float = INSTANCE_SCORE) -> DataFrame:
    """(kind, context, token) that high-confidence patterns discover.

    Patterns are the words around an identifier, with digits and names generalised; each has a score for each kind. The graph has an edge for each pattern and instance that
    occur together, weighed by their occurrences. Instances that the fixed patterns know score 1 for their kind, others 0 at first. In each round a pattern scores
    the weighed mean of its instances' scores (with one more occurrence that scores 0), and counts with `support` different
    instances and `pattern_score`; an instance scores 1 minus the product of what its counting patterns leave. Sums go by key
    with partial aggregation; only edges, never documents, take part in the rounds.
    """
    c = scanned.select(F.explode("candidates").alias("c")).select("c.token", "c.kind", F.explode("c.contexts").alias("context"))
    edges = c.groupBy("context", "token").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("known"))
    # a pattern without any known instance never counts, nor one with few instances: most edges go before the rounds
    useful = edges.groupBy("context").agg(F.count("known").alias("k"), F.count(F.lit(1)).alias("instances"), F.sum("n").alias("total")).filter((F.col("k") > 0) & (F.col("instances") >= support)).drop("k")
    edges = written(edges.join(written(useful), "context"))
    seeds = edges.filter("known is not null").select("token", F.col("known").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, patterns = seeds, None
    for _ in range(rounds):
        patterns = edges.join(scores, "token").groupBy("context", "kind").agg((F.sum(F.col("n") * F.col("score")) / (F.first("total") + 1)).alias("trust"))
        patterns = written(patterns.filter(F.col("trust") >= pattern_score))
        found = edges.join(patterns, "context").groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("trust")))))).alias("score"))
        scores = written(found.union(seeds.select("token", "kind", "score")).groupBy("token", "kind").agg(F.max("score").alias("score")))
    good = edges.filter("known is null").join(patterns, "context").join(scores, ["token", "kind"]).filter(F.col("score") >= instance_score)
    return good.select("kind", "context", "token")


def discovered(scanned: DataFrame, **options) -> DataFrame:
    """(k1, k2, more), written: spans of long hexadecimal strings and of what learned patterns point at, by kind and start, for rows that have some. None overlaps a base span."""
    pairs = learned(scanned, **options)
    every = scanned.select("k1", "k2", F.explode("candidates").alias("c"))
    known = every.filter("c.kind = 4").select("k1", "k2", F.struct("c.kind", "c.start", "c.end").alias("span"))
    open_ = every.filter("c.kind is null").select("k1", "k2", "c.token", "c.start", "c.end", F.explode("c.contexts").alias("context"))
    found = open_.join(pairs, ["context", "token"]).select("k1", "k2", F.struct("kind", "start", "end").alias("span"))
    more = written(known.union(found).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("more")))
    based = scanned.select("k1", "k2", "base").join(more, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("more").alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    return written(based.select("k1", "k2", free.alias("more")).filter(F.size("more") > 0))


def spans(scanned: DataFrame, **options) -> DataFrame:
    """(id, k1, k2, base, spans): base spans and those of discovered identifiers, by kind and start."""
    more = discovered(scanned, **options)
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return scanned.select("id", "k1", "k2", "base").join(more, ["k1", "k2"], "left").select("id", "k1", "k2", "base", every.alias("spans"))


def shown(all_spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of documents; counts are of base spans, others are secrets and what contexts point at.

    Null and empty texts have no spans. Rows that repeat an id or a whole row are rows of their own; null ids stay. Contexts
    are learned from all rows. Time grows with a text's length, for texts full of matches a little faster.
    """
    found = spans(scan(documents, id_column, text), **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("id").alias(id_column), count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def masked(text: Column, all_spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one names the mark.

    Spans are taken in steps, so that what is copied stays short; a step cuts its own part of the text.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<string>")

    def steps(ordered: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / STEP).cast("int")), lambda k: F.slice(ordered, k * STEP + 1, F.lit(STEP)))
        # where the spans before a step end, and where the step's own end
        ends = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: once(F.greatest(a["at"], F.array_max(F.transform(p, lambda s: s["end"]))), lambda e: F.struct(e.alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))))

        def one(part: Column, begin: Column) -> Column:
            def cut(local: Column) -> Column:
                done = F.aggregate(
                    part,
                    F.struct(begin.alias("at"), none.alias("out")),
                    lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(local, a["at"] - begin + 1, s["start"] - a["at"]), names[s["kind"]])).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
                )
                return F.array_join(done["out"], "")

            last = F.array_max(F.transform(part, lambda s: s["end"]))
            return once(F.substring(text, begin + 1, F.greatest(F.lit(0), last - begin)), cut)

        return F.concat(F.array_join(F.zip_with(parts, ends["out"], one), ""), F.substring(text, F.array_max(F.transform(ordered, lambda s: s["end"])) + 1, F.length(text)))

    return F.when(F.size(all_spans) > 0, once(ordered, steps)).otherwise(text)


def mask(documents: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`documents` with personal data masked in the text; all rows and columns stay, whatever they are called, null texts stay null.

    Base spans are masked where they are found; only rows with discovered ones are joined with these.
    """
    columns = documents.columns
    found = discovered(scan(documents, id_column, text), **options)
    keys = written(found.select(F.col("k1").alias("_w_k1")).distinct())
    keyed = documents.select(*columns, *[k.alias(f"_w_{n}") for k, n in zip(row_key(F.col(id_column), F.col(text)), ("k1", "k2"), strict=True)])
    found = found.select(F.col("k1").alias("_w_k1"), F.col("k2").alias("_w_k2"), F.col("more").alias("_w_more"))
    some = having(keyed, keys, "_w_k1").join(found, ["_w_k1", "_w_k2"], "left")
    none = lacking(keyed, keys, "_w_k1").withColumn("_w_more", F.lit(None).cast(found.schema["_w_more"].dataType))
    both = none.select(*columns, "_w_more").union(some.select(*columns, "_w_more"))
    text_ = F.col(text).cast("string")
    every = F.concat(base_spans(text_), F.coalesce("_w_more", F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    marked = F.when(text_.rlike("[0-9@]"), once(every, lambda e: masked(text_, e))).otherwise(text_)
    return both.select(*[marked.alias(c) if c == text else F.col(f"`{c}`") for c in columns])
