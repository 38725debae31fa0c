"""Search: ranked words and prefixes, filtered browsing, vectors by brute force, and a read-only SQL door."""

from __future__ import annotations

import re
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weft.functions.normalize import OPERATORS, query_tokens, snippet
from weft.scratch import written

#: Fixed weights of a whole word and of a prefix.
EXACT, PREFIX = 4.0, 1.0


def tokens(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, token) of every word of the fields, repeats included."""
    rows = None
    for f in fields:
        one = df.select(F.col(key).alias("key"), F.lit(f).alias("field"), F.explode(query_tokens(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias("token"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def token_index(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Inverted index (token, key, field, tf): written once, searched by equality or prefix of the token, which Parquet prunes when sorted by it."""
    return tokens(df, key, fields).groupBy("token", "key", "field").agg(F.count(F.lit(1)).alias("tf"))


def _words(text: str) -> list[str]:
    return [t for t in re.split(r"\s+", re.sub(OPERATORS, " ", text).lower()) if t]


def text_search(index: DataFrame, text: str, limit: int = 20, exact_keys: DataFrame | None = None) -> DataFrame:
    """(key, exact, score): for each word of the text the better of a whole-word hit (4) and a prefix hit (1) in any field, summed.

    exact_keys (key): rows that go first, as an exact symbol does. An empty text finds nothing.
    """
    words = _words(text)
    exact = F.col("_exact").isNotNull() if exact_keys is not None else F.lit(False)
    if not words:
        return index.select("key", F.lit(False).alias("exact"), F.lit(0.0).alias("score")).limit(0)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("token").startswith(w)
    scored = index.filter(hit)
    per = [F.max(F.when(F.col("token") == w, EXACT).when(F.col("token").startswith(w), PREFIX).otherwise(0.0)) for w in words]
    total = per[0]
    for p in per[1:]:
        total = total + p
    found = scored.groupBy("key").agg(total.alias("score"))
    if exact_keys is not None:
        found = found.join(exact_keys.select("key", F.lit(True).alias("_exact")).distinct(), "key", "left")
    return found.select("key", exact.alias("exact"), "score").orderBy(F.desc("exact"), F.desc("score"), "key").limit(limit)


def node_search(nodes: DataFrame, index: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Text search over the stored index of nodes (see `index`); one whose symbol is the whole text, case ignored, comes before mere mentions: (key, kind, name, exact, score)."""
    from weft.operators.index import exact, words

    found = text_search(words(index), text, limit, exact(index, text))
    return found.join(nodes.select("key", "kind", "name"), "key").select("key", "kind", "name", "exact", "score").orderBy(F.desc("exact"), F.desc("score"), "key")


#: Fixed shape of what a search tool answers: rows, decimals of a score.
TOOL_ROWS, TOOL_DECIMALS = 20, 3


def word_results(found: DataFrame) -> DataFrame:
    """What the word-search tool answers of `node_search`: (kind, id, name) of the first TOOL_ROWS."""
    return found.orderBy(F.desc("exact"), F.desc("score"), "key").limit(TOOL_ROWS).select("kind", F.col("key").alias("id"), "name")


def meaning_results(found: DataFrame, nodes: DataFrame, length: int = 280) -> DataFrame:
    """What the vector-search tool answers of `vector_search`: (kind, id, name, score, snippet), scores rounded, the nearest first.
    nodes: (key, name, summary); one without a name is called by its id."""
    named = found.join(nodes.select("key", "name", "summary"), "key", "left")
    text = snippet(F.coalesce("summary", F.lit("")), length)
    shaped = named.select("kind", F.col("key").alias("id"), F.coalesce("name", "key").alias("name"), F.round("score", TOOL_DECIMALS).alias("score"), text.alias("snippet"), F.col("score").alias("_s"))
    return shaped.orderBy(F.desc("_s"), "id").drop("_s")


def browse(df: DataFrame, prefix: str | None, filters: list[Column], key: str, column: str, limit: int = 100) -> DataFrame:
    """Rows whose column starts with the prefix (case ignored) and that pass all filters, by key; no prefix, no rows."""
    if not prefix:
        return df.limit(0)
    out = df.filter(F.lower(F.col(column)).startswith(prefix.lower()))
    for f in filters:
        out = out.filter(f)
    return out.orderBy(key).limit(limit)


#: Fixed caps of browsing: hits of the text search, keys with the prefix.
BROWSED_TEXT, BROWSED_KEYS = 300, 100


def browse_nodes(nodes: DataFrame, index: DataFrame, text: str | None, kinds: list[str] | None = None, filters: list[Column] = (), prefix_kind: str | None = None) -> DataFrame:
    """Entities by words (the best BROWSED_TEXT) and, for one kind, by the beginning of their key (the first BROWSED_KEYS), of the wanted kinds and through all filters: (key, kind, name, score).

    No text finds nothing. A filter that doesn't concern a kind is written so that it passes.
    """
    if not text or not text.strip():
        return nodes.select("key", "kind", "name", F.lit(0.0).alias("score")).limit(0)
    wanted = nodes.filter(F.col("kind").isin(*kinds)) if kinds else nodes
    for f in filters:
        wanted = wanted.filter(f)
    from weft.operators.index import words as of_words

    words = text_search(of_words(index), text, BROWSED_TEXT).select("key", "score")
    keys = nodes.filter((F.col("kind") == prefix_kind) & F.lower("key").startswith(text.strip().lower())).orderBy("key").limit(BROWSED_KEYS).select("key", F.lit(0.0).alias("score")) if prefix_kind else words.limit(0)
    hits = words.unionByName(keys).groupBy("key").agg(F.max("score").alias("score"))
    return wanted.join(hits, "key").select("key", "kind", "name", "score").orderBy(F.desc("score"), "key")


def resolve_seeds(nodes: DataFrame, asked: DataFrame, alternates: list[str]) -> DataFrame:
    """Keys of the nodes that `asked` (seed) means, (seed, key): a seed that is a key is that node; else the first alternate column (a symbol, a second id) that has it, case ignored, of several nodes the one with the smallest key. Unknown seeds return no row."""
    names = nodes.select("key", F.lit(0).alias("way"), F.col("key").alias("name"))
    for i, column in enumerate(alternates):
        names = names.unionByName(nodes.filter(F.col(column).isNotNull()).select("key", F.lit(i + 1).alias("way"), F.lower(column).alias("name")))
    wanted = asked.select("seed").distinct()
    exact = wanted.join(names.filter("way = 0"), F.col("seed") == F.col("name"))
    other = wanted.join(names.filter("way > 0"), F.lower("seed") == F.col("name"))
    return exact.unionByName(other).groupBy("seed").agg(F.min(F.struct("way", "key")).alias("m")).select("seed", F.col("m.key").alias("key"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero, holds a null, or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def vector_table(df: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """(key, kind, vector, norm) of the vectors that a search can find: not null, without null or non-finite components, not zero. Written once, so that searches don't compute norms."""
    v = F.col(column).cast("array<double>")
    usable = df.select(key, kind, v.alias("vector")).filter("vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return written(usable.withColumn("norm", norm(F.col("vector"))).filter("norm > 0"))


def vector_search(df: DataFrame, vector: list[float], key: str, column: str, kind: str, k: int) -> DataFrame:
    """The k nearest of all kinds together, score (1 + cosine) / 2; k best of each kind are merged, which bounds what is sorted.

    df: a table with vectors in `column`, or one of `vector_table`, whose norms are used then. Zero vectors, vectors of other lengths and ones with nulls are
    never found; a zero vector finds nothing.
    """
    from weft.operators.relational import top

    q = F.array(*[F.lit(float(x)) for x in vector])
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    near = F.when(F.size(column) == len(vector), F.try_divide(dot(F.col(column), q), F.col("norm") * F.lit(length))) if "norm" in df.columns else cosine(F.col(column), q)
    scored = df.select(key, kind, ((1 + near) / 2).alias("score")).filter("score is not null and not isnan(score)")
    return top(scored, [kind], [F.desc("score"), F.col(key).asc()], k).orderBy(F.desc("score"), key).limit(k)


#: What a read-only statement may consist of, as the parser names it; anything else (commands, scripts, files, hints) is refused.
_PLANS = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "LateralJoin", "SubqueryAlias", "Distinct", "Union", "Except", "Intersect", "UnresolvedWith", "UnresolvedRelation", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "WithWindowDefinition", "Generate", "Pivot", "Unpivot", "UnresolvedPivot"}
#: Functions that reach outside the query.
_OUTSIDE = {"reflect", "java_method", "try_reflect", "input_file_name", "version", "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema"}


def _children(node) -> list:
    out = []
    for of in ("children", "innerChildren", "expressions"):
        try:
            seq = getattr(node, of)()
        except Py4JError:  # an expression has no expressions of its own
            continue
        out += [seq.apply(i) for i in range(seq.size())]
    return out


def checked(spark: SparkSession, statement: str) -> None:
    """Raises ValueError unless the statement is one query over temporary views (and its own named subqueries), without functions that reach outside."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except ParseException as e:
        raise ValueError(f"not a query: {e.getMessage()}") from None
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    named, used, todo = set(), [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if ".plans.logical." in node.getClass().getName() or name in ("UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving") or name.endswith(("Statement", "Command")):
            if name not in _PLANS:
                raise ValueError(f"only queries are allowed, not {name}")
        if name == "UnresolvedWith":
            named |= {node.cteRelations().apply(i)._1().lower() for i in range(node.cteRelations().size())}
        elif name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            used.append([parts.apply(i).lower() for i in range(parts.size())])
        elif name == "UnresolvedFunction":
            parts = node.nameParts()
            if parts.size() > 1 or parts.apply(0).lower() in _OUTSIDE:
                raise ValueError(f"{parts.apply(parts.size() - 1)} isn't allowed")
        elif name == "UnresolvedTableValuedFunction":
            raise ValueError("table functions aren't allowed")
        todo += _children(node)
    for parts in used:
        if len(parts) > 1 or parts[0] not in views | named:
            raise ValueError(f"unknown view {'.'.join(parts)}")


#: Leaves of an analyzed plan that read nothing.
_EMPTY = {"OneRowRelation", "LocalRelation", "CTERelationRef"}


def _resolved(spark: SparkSession, df: DataFrame) -> None:
    """Raises ValueError if the analyzed query reads anything but temporary views. Names are resolved by then, so a name that a subquery
    defines for itself hides nothing elsewhere."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass()
        if ".plans.logical." in kind.getName() or ".execution." in kind.getName() or ".catalog." in kind.getName():
            name = kind.getSimpleName()
            if name == "View":
                if not node.isTempView():
                    raise ValueError("only temporary views may be read")
                continue
            if node.children().size() == 0 and name not in _EMPTY:
                raise ValueError(f"only temporary views may be read, not a {name}")
        todo += _children(node)
        if "Subquery" in kind.getSimpleName() or kind.getSimpleName() in ("Exists", "ListQuery"):
            try:
                todo.append(node.plan())
            except Py4JError:  # an alias of a subquery has a child instead
                pass


def read_only_sql(spark: SparkSession, statement: str, limit: int = 30) -> DataFrame:
    """One query on temporary views, at most `limit` rows; what isn't one is refused before it runs (`checked`), and what reads anything else once its names are resolved."""
    checked(spark, statement)
    df = spark.sql(f"select * from (\n{statement}\n) limit {int(limit)}")
    _resolved(spark, df)
    return df


def read_only_rows(spark: SparkSession, statement: str, limit: int = 30, seconds: float = 10) -> list[Row]:
    """The rows of `read_only_sql`; a run of more than `seconds` is cancelled and raises TimeoutError."""
    df, tag, late, done = read_only_sql(spark, statement, limit), f"weft-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        if done.wait(seconds):
            return
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)
        while not done.wait(0.3):  # a query may be between two jobs
            spark.sparkContext.cancelJobsWithTag(tag)

    watch = threading.Thread(target=stop, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watch.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds} seconds") from None
        raise
    finally:
        done.set()
        watch.join()
        spark.sparkContext.removeJobTag(tag)
