"""Literature: dictionary matches in sentences, candidate relations with counted evidence, review, promotion and exact revert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import normalize as N
from weft.operators.dictionary import link  # noqa: F401  part of this module's interface
from weft.operators.upsert import merge

#: Fixed bounds of automatic promotion.
AUTO_CONFIDENCE, AUTO_AFFIRM = 0.75, 2


def gazetteer(entities: DataFrame) -> DataFrame:
    """(surface, lower, n_tokens, node_id, kind, canonical) from (node_id, kind, name, aliases): names and aliases, once each."""
    both = entities.select("node_id", "kind", F.col("name").alias("canonical"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("surface"))
    return both.filter(N.not_blank(F.col("surface")).isNotNull()).select("surface", F.lower("surface").alias("lower"), F.size(N.tokens(F.col("surface"))).alias("n_tokens"), "node_id", "kind", "canonical").distinct()


def sentences(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(id_column).alias("doc_id"), F.posexplode(N.sentences(F.coalesce(F.col(text), F.lit("")))).alias("sentence_no", "sentence"))


def pairs(matches: DataFrame) -> DataFrame:
    """Pairs of different entities of a sentence, in order of place, that a relation exists for: (doc_id, sentence_no, rel, subject_id, object_id, triple_key)."""
    firsts = matches.groupBy("doc_id", "sentence_no", "node_id", "kind").agg(F.min("start").alias("at"))
    a = firsts.select("doc_id", "sentence_no", F.col("node_id").alias("ia"), F.col("kind").alias("ka"), F.col("at").alias("pa"))
    b = firsts.select("doc_id", "sentence_no", F.col("node_id").alias("ib"), F.col("kind").alias("kb"), F.col("at").alias("pb"))
    met = a.join(b, ["doc_id", "sentence_no"]).filter((F.col("ia") != F.col("ib")) & ((F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("ia") < F.col("ib")))))
    met = met.withColumn("rel", N.edge_type(F.col("ka"), F.col("kb"))).filter("rel is not null")
    swap = (F.col("rel") == "IMPLICATED_IN") & (F.col("ka") == "disease")
    out = met.select("doc_id", "sentence_no", "rel", F.when(swap, F.col("ib")).otherwise(F.col("ia")).alias("subject_id"), F.when(swap, F.col("ia")).otherwise(F.col("ib")).alias("object_id"))
    return out.withColumn("triple_key", N.triple_key(F.col("rel"), F.col("subject_id"), F.col("object_id"))).distinct()


def stage(candidates: DataFrame, evidence: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (candidates, evidence): evidence by (triple_key, pmid), the last verdict wins; counters and confidence follow from all evidence.

    Verdicts that assert nothing are dropped. A candidate's status is set when it is made and not touched again.
    """
    new = verdicts.filter("asserted").groupBy("triple_key", "pmid").agg(F.max_by(F.struct("polarity", "rel_type", "subject_id", "object_id"), F.col("seq")).alias("x"))
    new = new.select("triple_key", "pmid", "x.polarity", "x.rel_type", "x.subject_id", "x.object_id")
    evidence = merge(evidence, new.select("triple_key", "pmid", "polarity"), ["triple_key", "pmid"])
    counts = evidence.groupBy("triple_key").agg(F.count_if(F.col("polarity") == "affirm").alias("n_affirm"), F.count_if(F.col("polarity") == "negate").alias("n_negate"))
    counts = counts.withColumn("confidence", N.evidence_confidence(F.col("n_affirm"), F.col("n_negate")))
    made = new.groupBy("triple_key").agg(F.min("rel_type").alias("rel_type"), F.min("subject_id").alias("subject_id"), F.min("object_id").alias("object_id")).join(counts, "triple_key").withColumn("status", F.lit("pending"))
    candidates = merge(candidates, made, ["triple_key"], keep_old=("status", "rel_type", "subject_id", "object_id"))
    return candidates, evidence


def promotable(candidates: DataFrame, confidence: float = AUTO_CONFIDENCE, affirm: int = AUTO_AFFIRM) -> DataFrame:
    return candidates.filter((F.col("status") == "pending") & (F.col("confidence") >= confidence) & (F.col("n_affirm") >= affirm) & (F.col("n_negate") == 0))


def promote(edges: DataFrame, chosen: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New edges, and for each promoted triple its kind and the PMIDs that were added.

    edges: (triple_key, rel_type, subject_id, object_id, pmids, tier). An existing edge is enriched with PMIDs it hasn't; a
    missing one is minted in the literature tier.
    """
    support = evidence.filter("polarity = 'affirm'").groupBy("triple_key").agg(F.array_sort(F.collect_set("pmid")).alias("new"))
    wanted = chosen.select("triple_key", F.col("rel_type").alias("r"), F.col("subject_id").alias("s"), F.col("object_id").alias("o")).join(support, "triple_key", "left").withColumn("new", F.coalesce("new", F.array().cast("array<string>"))).withColumn("asked", F.lit(True))
    met = edges.withColumn("there", F.lit(True)).join(wanted, "triple_key", "full")
    old = F.coalesce("pmids", F.array().cast("array<string>"))
    delta = F.when(F.col("asked"), F.array_except(F.col("new"), old)).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("delta", delta)
    out = met.select("triple_key", F.coalesce("rel_type", "r").alias("rel_type"), F.coalesce("subject_id", "s").alias("subject_id"), F.coalesce("object_id", "o").alias("object_id"), F.concat(old, "delta").alias("pmids"), F.when(F.col("there"), F.col("tier")).otherwise("literature").alias("tier"))
    log = met.filter("asked").select("triple_key", F.when(F.col("there"), "enrich").otherwise("mint").alias("promotion_kind"), F.col("delta").alias("enriched_pmids"))
    return out, log


def revert(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Undoes promotions: minted edges go, enriched ones lose exactly the PMIDs that were added."""
    met = edges.join(log, "triple_key", "left").filter(~F.coalesce(F.col("promotion_kind") == "mint", F.lit(False)))
    kept = F.filter("pmids", lambda p: ~F.array_contains(F.coalesce(F.col("enriched_pmids"), F.array().cast("array<string>")), p))
    return met.select("triple_key", "rel_type", "subject_id", "object_id", kept.alias("pmids"), "tier")


def edge_exists(wanted: DataFrame, edges: DataFrame, symmetric: tuple[str, ...] = ("INTERACTS_WITH",)) -> DataFrame:
    """`wanted` (rel_type, subject_id, object_id, ...) with `present`: whether an edge (rel_type, subject_id, object_id) of that type leads from subject to object, for symmetric types either way."""
    both = F.col("rel_type").isin(*symmetric)
    ends = lambda df: df.withColumn("_s", F.when(both, F.least("subject_id", "object_id")).otherwise(F.col("subject_id"))).withColumn("_o", F.when(both, F.greatest("subject_id", "object_id")).otherwise(F.col("object_id")))
    known = ends(edges.select("rel_type", "subject_id", "object_id")).select("rel_type", "_s", "_o").distinct().withColumn("_there", F.lit(True))
    return ends(wanted).join(known, ["rel_type", "_s", "_o"], "left").withColumn("present", F.col("_there").isNotNull()).drop("_s", "_o", "_there")


def route(verdicts: DataFrame, edges: DataFrame, allowed: tuple[str, ...] = ("INTERACTS_WITH", "IMPLICATED_IN"), symmetric: tuple[str, ...] = ("INTERACTS_WITH",)) -> DataFrame:
    """verdicts with `status`: skipped (nothing asserted, or a type that isn't staged), enriched (a trusted edge says so already), else candidate."""
    known = edge_exists(verdicts, edges.filter(F.coalesce(F.col("tier"), F.lit("canonical")) != "literature") if "tier" in edges.columns else edges, symmetric)
    used = F.coalesce(F.col("asserted"), F.lit(False)) & F.col("rel_type").isin(*allowed)
    return known.withColumn("status", F.when(~used, "skipped").when(F.col("present"), "enriched").otherwise("candidate")).drop("present")


def stage_routed(candidates: DataFrame, evidence: DataFrame, edges: DataFrame, verdicts: DataFrame, symmetric: tuple[str, ...] = ("INTERACTS_WITH",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New (candidates, evidence, edges): verdicts on trusted edges add their PMID to these, others become or support candidates."""
    routed = route(verdicts, edges, symmetric=symmetric)
    ends = lambda df: df.withColumn("_k", N.triple_key(F.col("rel_type"), F.col("subject_id"), F.col("object_id"), symmetric))
    more = ends(routed.filter("status = 'enriched'")).groupBy("_k").agg(F.array_sort(F.collect_set("pmid")).alias("_new"))
    old = F.coalesce("pmids", F.array().cast("array<string>"))
    trusted = F.coalesce(F.col("tier"), F.lit("canonical")) != "literature"
    out = ends(edges).join(more, "_k", "left").select(*[F.when(trusted, F.concat(old, F.array_except(F.coalesce("_new", F.array().cast("array<string>")), old))).otherwise(F.col("pmids")).alias("pmids") if c == "pmids" else F.col(c) for c in edges.columns])
    return *stage(candidates, evidence, routed.filter("status = 'candidate'").drop("status")), out


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review: approve only what is pending, reject anything, revert only what is promoted; decisions are (triple_key, action)."""
    met = candidates.join(decisions, "triple_key", "left")
    status = F.when((F.col("action") == "approve") & (F.col("status") == "pending"), "promoted").when(F.col("action") == "reject", "rejected").when((F.col("action") == "revert") & (F.col("status") == "promoted"), "pending").otherwise(F.col("status"))
    return met.withColumn("status", status).drop("action")


def review(candidates: DataFrame, edges: DataFrame, evidence: DataFrame, log: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of review: new (candidates, edges, log). Approved pending candidates are promoted to edges and logged, reverted promoted ones take back what the log says
    (minted literature edges go, enriched ones lose exactly the added PMIDs) and are pending again, rejected ones are only marked."""
    met = candidates.join(decisions, "triple_key")
    approved = met.filter("action = 'approve' and status = 'pending'").drop("action")
    undone = log.join(met.filter("action = 'revert' and status = 'promoted'").select("triple_key"), "triple_key", "left_semi")
    back = revert(edges, undone)
    out, more = promote(back, approved, evidence)
    return decide(candidates, decisions), out, log.join(undone.select("triple_key"), "triple_key", "left_anti").unionByName(more)


def candidate_detail(candidates: DataFrame, evidence: DataFrame, edges: DataFrame, nodes: DataFrame, length: int = 280) -> DataFrame:
    """Each candidate as a reviewer sees it: names, degrees and summaries of both ends, whether approving would MINT or ENRICH (for pending ones), evidence with negations first, then support, then hedges, by `extracted_at` within each if evidence has it, else by PMID.

    nodes: (node_id, name, summary); an end that isn't a node has its id as its name.
    """
    degree = edges.select(F.col("subject_id").alias("node_id")).unionByName(edges.filter("subject_id <> object_id").select(F.col("object_id").alias("node_id"))).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    known = nodes.select("node_id", "name", "summary").join(degree, "node_id", "left")
    out = edge_exists(candidates, edges).withColumn("would_be_action", F.when(F.col("status") == "pending", F.when(F.col("present"), "ENRICH").otherwise("MINT"))).drop("present")
    for side in ("subject", "object"):
        own = known.select(F.col("node_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), N.snippet(F.coalesce("summary", F.lit("")), length).alias(f"{side}_summary"), F.coalesce("degree", F.lit(0)).alias(f"{side}_degree"))
        out = out.join(own, f"{side}_id", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", f"{side}_id"))
    time = F.coalesce(F.col("extracted_at").cast("string"), F.lit("")) if "extracted_at" in evidence.columns else F.lit("")
    lines = evidence.groupBy("triple_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(_polarity_rank().alias("r"), time.alias("t"), "pmid", "polarity"))), lambda e: F.concat_ws(":", e["polarity"], e["pmid"])).alias("evidence"))
    return out.join(lines, "triple_key", "left")


def _polarity_rank() -> Column:
    """Negations first, then affirmations, then hedges."""
    return F.when(F.col("polarity") == "negate", 0).when(F.col("polarity") == "affirm", 1).otherwise(2)


def review_list(candidates: DataFrame, names: DataFrame, targets: DataFrame | None = None, sort: str = "confidence", status: str | None = None) -> DataFrame:
    """Candidates, of one status or all, with names of both ends (the id where there is none; targets names the second end if it has a table of its own), sorted by an allowed key."""
    from weft.operators.relational import sorted_by

    named = candidates.filter(F.col("status") == status) if status else candidates
    for side, known in (("subject", names), ("object", names if targets is None else targets)):
        named = named.join(known.select(F.col("node_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")), f"{side}_id", "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", f"{side}_id"))
    return sorted_by(named, {"confidence": [F.desc("confidence"), F.col("triple_key").asc()], "affirm": [F.desc("n_affirm"), F.col("triple_key").asc()], "key": [F.col("triple_key").asc()]}, sort)


def evidence_order(evidence: DataFrame) -> DataFrame:
    """Negations first, then affirmations, then hedges; by PMID among equals."""
    return evidence.orderBy("triple_key", _polarity_rank(), "pmid")


def uncited(edges: DataFrame) -> DataFrame:
    """Edges that were never tried for citations and have none."""
    return edges.filter(~F.coalesce(F.col("citation_attempted"), F.lit(False)) & (F.coalesce(F.size("pmids"), F.lit(0)) <= 0))


#: Characters of an abstract that a judgement of relevance reads.
ABSTRACT = 3000


def relevance(abstract: Column, reply: Column) -> Column:
    """Whether a publication supports an edge, by the reply of a model: an empty abstract, a reply without an object in braces or one that can't be read says no."""
    said = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "relevant boolean")
    return N.not_blank(F.coalesce(abstract, F.lit(""))).isNotNull() & F.coalesce(said["relevant"], F.lit(False))


def question(abstract: Column) -> Column:
    """What is shown to the model: the beginning of the abstract."""
    return F.left(abstract, F.lit(ABSTRACT))


def recent(records: DataFrame, date: str, now: Column, days: int = 1) -> DataFrame:
    """Records of the last `days` days, the day of `now` included."""
    return records.filter((F.col(date) > F.date_sub(F.to_date(now), days)) & (F.col(date) <= F.to_date(now)))


def cite(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges after a pass over the uncited ones: found (triple_key, pmid) are added, sorted, and each edge that was tried is marked, also if nothing was found."""
    tried = uncited(edges).select("triple_key", F.lit(True).alias("_tried"))
    new = found.groupBy("triple_key").agg(F.array_sort(F.collect_set(F.col("pmid").cast("string"))).alias("_new"))
    met = edges.join(tried, "triple_key", "left").join(new, "triple_key", "left")
    pmids = F.when(F.col("_tried"), F.coalesce("_new", F.array().cast("array<string>"))).otherwise(F.col("pmids"))
    return met.select(*[pmids.alias("pmids") if c == "pmids" else (F.coalesce(F.col(c), F.lit(False)) | F.col("_tried").isNotNull()).alias(c) if c == "citation_attempted" else F.col(c) for c in edges.columns])


def unembedded(nodes: DataFrame, dimension: int) -> DataFrame:
    """Nodes with a text and without an embedding of the right length."""
    return nodes.filter(N.not_blank(F.col("text")).isNotNull() & (F.col("embedding").isNull() | (F.size("embedding") != dimension)))


def embed(nodes: DataFrame, vectors: DataFrame, dimension: int, kinds: tuple[str, ...], model: str) -> tuple[DataFrame, DataFrame]:
    """New nodes, with the vectors (key, vector) of the right length for nodes of the allowed kinds and the model that made them, and a row (written, failed) of what was taken and refused."""
    met = vectors.join(nodes.select("key", "kind"), "key", "left").withColumn("_ok", F.coalesce((F.size("vector") == dimension) & F.col("kind").isin(*kinds), F.lit(False)))
    good = met.filter("_ok").select("key", F.col("vector").alias("embedding"), F.lit(model).alias("embedding_model"))
    base = nodes if "embedding_model" in nodes.columns else nodes.withColumn("embedding_model", F.lit(None).cast("string"))
    return merge(base, good, ["key"], insert=False), met.agg(F.count_if("_ok").alias("written"), F.count_if(~F.col("_ok")).alias("failed"))


def endpoints(candidates: DataFrame) -> DataFrame:
    """Candidates as edges (rel, src, dst) of the graph."""
    return candidates.select(F.col("rel_type").alias("rel"), F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
