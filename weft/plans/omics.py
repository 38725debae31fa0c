"""Raw multi-omics tables to the typed graph: one function for each source, from all-string columns to nodes and edges.

Each takes the source as its reader gives it, with `idx` (the line's number) where the order of lines decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import normalize as N
from weft.operators.matrix import median_differences, sample_groups
from weft.operators.percentiles import clipped
from weft.operators.relational import ordered_distinct, top_list
from weft.operators.upsert import anchored, first_of
from weft.sources.files import first_present

#: Fixed thresholds: genome-wide significance, interaction score (of 1000), gene-set and cohort sizes, fold change, constraint of frequent metabolites.
GWAS_P, STRING_SCORE, COHORT_SIZE, FOLD_CHANGE, MIN_REACTIONS = 5e-8, 950, 10, 1.0, 1
#: Fixed subtypes of proteins by GO term, the first that fits counts.
SUBTYPES = (("GO:0003700", "transcription_factor"), ("GO:0016301", "kinase"), ("GO:0005198", "structural"), ("GO:0003824", "enzyme"))
#: Fixed names that are no location.
LOCATION_NOISE = ("n/a", "unknown", "na", "")


def genes(hgnc: DataFrame) -> DataFrame:
    c = F.col
    rows = hgnc.filter(N.not_blank(c("ensembl_gene_id")).isNotNull())
    place = F.coalesce(first_present(hgnc, ["location", "chromosome"]), F.lit(""))
    return rows.select(N.strip_version(c("ensembl_gene_id")).alias("ensembl_id"), c("symbol").alias("hgnc_symbol"), "hgnc_id", c("name").alias("description"), N.chromosome(place).alias("chromosome"), N.aliases(F.coalesce("alias_symbol", F.lit("")), F.coalesce("prev_symbol", F.lit("")), canonical=c("symbol")).alias("aliases"), F.substring_index("entrez_id", ".", 1).alias("entrez"))


def id_map(hgnc: DataFrame) -> DataFrame:
    """Ensembl id, symbol and first UniProt id of each symbol; the last line of a repeated one wins."""
    rows = hgnc.withColumn("uniprot", F.get(F.filter(F.split(F.coalesce("uniprot_ids", F.lit("")), r"\|"), lambda x: F.trim(x) != ""), 0))
    return rows.groupBy("symbol").agg(F.max_by(N.strip_version(F.col("ensembl_gene_id")), "idx").alias("ensembl_id"), F.max_by("uniprot", "idx").alias("uniprot_id"))


def transcripts(gtf: DataFrame, gene: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = F.col("attributes")
    t = gtf.select(N.strip_version(a["transcript_id"]).alias("ensembl_tx_id"), N.strip_version(a["gene_id"]).alias("ensembl_id"), a["gene_name"].alias("hgnc_symbol"), a["transcript_type"].alias("biotype"), N.span(F.col("start"), F.col("end")).alias("length_bp"))
    t = t.join(gene.select("ensembl_id"), "ensembl_id", "left_semi")
    return t.drop("ensembl_id"), t.select(F.lit("PRODUCES").alias("rel"), F.col("ensembl_id").alias("src"), F.col("ensembl_tx_id").alias("dst"))


def tissue_weights(gct: DataFrame, tissues: list[str]) -> DataFrame:
    """Expression over the tissue's 99th percentile, at most 1; a missing value counts as 0; the first line of a gene counts. All tissues take four jobs together."""
    rows = first_of(gct.withColumn("ensembl_id", N.strip_version(F.col("Name"))), ["ensembl_id"], [F.col("idx").asc()])
    rows = clipped(rows, {t: f"tw_{t}" for t in tissues}, 0.99, missing=0.0)
    return rows.select("ensembl_id", *[f"tw_{t}" for t in tissues])


def weighted(produces: DataFrame, weights: DataFrame) -> DataFrame:
    """PRODUCES edges with the tissue weights of their gene; genes without weights keep null ones."""
    return produces.join(weights.withColumnRenamed("ensembl_id", "src"), "src", "left")


def ensp_to_uniprot(cds: DataFrame, swissprot: DataFrame) -> DataFrame:
    """(ensp, uniprot, idx) for each Ensembl protein of the CDS lines of a GTF (with `idx`), over its transcript; the first line that leads to a protein counts. Taxon prefixes and versions go."""
    a = F.col("attributes")
    strip = lambda c: N.strip_version(F.regexp_replace(c, r"^\d+\.(?=[A-Za-z])", ""))
    lines = cds.select(strip(a["protein_id"]).alias("ensp"), N.strip_version(a["transcript_id"]).alias("enst"), "idx").filter("ensp is not null and enst is not null")
    known = swissprot.groupBy(N.strip_version(F.col("enst")).alias("enst")).agg(F.min("uniprot").alias("uniprot"))
    return lines.join(known, "enst").groupBy("ensp").agg(F.min_by("uniprot", "idx").alias("uniprot"), F.min("idx").alias("idx"))


def unmapped(string: DataFrame, ensp: DataFrame) -> DataFrame:
    """How many pairs over the score have no protein on the first, the second or either side."""
    strip = lambda c: F.substring_index(c, ".", -1)
    known = ensp.select("ensp").distinct()
    rows = string.filter(F.col("combined_score").try_cast("int") >= STRING_SCORE).select(strip("protein1").alias("a"), strip("protein2").alias("b"))
    met = rows.join(known.select(F.col("ensp").alias("a"), F.lit(True).alias("ka")), "a", "left").join(known.select(F.col("ensp").alias("b"), F.lit(True).alias("kb")), "b", "left")
    return met.agg(F.count_if(F.col("ka").isNull()).alias("first"), F.count_if(F.col("kb").isNull()).alias("second"), F.count_if(F.col("ka").isNull() | F.col("kb").isNull()).alias("either"))


def proteins(ids: DataFrame, swissprot: DataFrame, transcript: DataFrame, gene: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proteins with a symbol, and their edges: from transcripts, or from genes where no transcript leads to the protein."""
    p = ids.filter("uniprot_id is not null").select("uniprot_id", F.col("symbol").alias("hgnc_symbol"), "ensembl_id").dropDuplicates(["uniprot_id", "ensembl_id"])
    via = swissprot.select(N.strip_version(F.col("enst")).alias("src"), F.col("uniprot").alias("dst")).distinct().join(transcript.select(F.col("ensembl_tx_id").alias("src")), "src", "left_semi").join(p.select(F.col("uniprot_id").alias("dst")), "dst", "left_semi")
    direct = p.join(via.select(F.col("dst").alias("uniprot_id")), "uniprot_id", "left_anti").join(gene.select("ensembl_id"), "ensembl_id", "left_semi")
    edges = via.select(F.lit("TRANSLATES_TO").alias("rel"), "src", "dst").unionByName(direct.select(F.lit("ENCODES").alias("rel"), F.col("ensembl_id").alias("src"), F.col("uniprot_id").alias("dst")))
    return p.groupBy("uniprot_id").agg(F.min("hgnc_symbol").alias("hgnc_symbol")), edges


def regulations(dorothea: DataFrame, protein: DataFrame, gene: DataFrame, tiers: tuple[str, ...] = ("A", "B")) -> DataFrame:
    rows = dorothea.dropna(subset=["tf", "target", "confidence"]).filter(F.col("confidence").isin(*tiers))
    met = rows.join(protein.select("uniprot_id", F.col("hgnc_symbol").alias("tf")), "tf").join(gene.select("ensembl_id", F.col("hgnc_symbol").alias("target")), "target")
    return met.select(F.lit("REGULATES").alias("rel"), F.col("uniprot_id").alias("src"), F.col("ensembl_id").alias("dst"), N.mode_of(F.coalesce(F.col("mor").try_cast("double"), F.lit(0.0))).alias("mode"), N.tier_confidence(F.col("confidence")).alias("score"), F.col("confidence").alias("confidence_tier"))


def unmapped_symbols(dorothea: DataFrame, protein: DataFrame) -> DataFrame:
    return dorothea.select(F.col("tf").alias("hgnc_symbol")).distinct().join(protein, "hgnc_symbol", "left_anti")


def interactions(string: DataFrame, ensp: DataFrame) -> DataFrame:
    """Pairs over the score with both ends mapped (ensp: ensp, uniprot, idx; the first line wins), without self-loops."""
    first = ensp.groupBy("ensp").agg(F.min_by("uniprot", "idx").alias("uniprot"))
    strip = lambda c: F.substring_index(c, ".", -1)
    rows = string.withColumn("s", F.col("combined_score").try_cast("int")).filter(F.col("s") >= STRING_SCORE)
    met = rows.withColumn("a", strip("protein1")).withColumn("b", strip("protein2")).join(first.select(F.col("ensp").alias("a"), F.col("uniprot").alias("src")), "a").join(first.select(F.col("ensp").alias("b"), F.col("uniprot").alias("dst")), "b").filter("src <> dst")
    return met.groupBy(F.lit("INTERACTS_WITH").alias("rel"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.max("s") / 1000).alias("score"), (F.max(F.col("experimental").try_cast("int")) / 1000).alias("experimental_score"), (F.max(F.col("coexpression").try_cast("int")) / 1000).alias("coexpression_score"))


def associations(gwas: DataFrame, gene: DataFrame) -> dict[str, DataFrame]:
    """Variants, diseases and three kinds of edges of significant hits: variant to disease with the best p (the first of equals), variant to gene, gene to disease."""
    c = F.col
    rows = gwas.withColumn("p", c("`P-VALUE`").try_cast("double")).filter(c("p") <= GWAS_P).withColumn("rsid", N.variant_key(c("SNPS"), N.first_value(c("CHR_ID")), N.first_value(c("CHR_POS")))).filter("rsid is not null")
    traits = rows.select("rsid", "p", "idx", "PUBMEDID", F.explode(N.traits(c("MAPPED_TRAIT"), c("MAPPED_TRAIT_URI"))).alias("t"))
    best = traits.groupBy("rsid", c("t.id").alias("ontology_id")).agg(F.min_by(F.struct("p", F.array(F.col("PUBMEDID").cast("string")).alias("pmids")), F.struct("p", "idx")).alias("x"))
    named = rows.select("rsid", F.explode(N.genes(c("MAPPED_GENE"))).alias("hgnc_symbol")).join(gene.select("ensembl_id", "hgnc_symbol"), "hgnc_symbol").select("rsid", "ensembl_id").distinct()
    assoc = best.select(F.lit("ASSOCIATED_WITH").alias("rel"), c("rsid").alias("src"), c("ontology_id").alias("dst"), c("x.p").alias("score"), c("x.pmids").alias("pmids"))
    rollup = named.join(best.select("rsid", "ontology_id"), "rsid").select(F.lit("IMPLICATED_IN").alias("rel"), c("ensembl_id").alias("src"), c("ontology_id").alias("dst")).distinct()
    return {
        "variants": rows.groupBy("rsid").agg(F.min_by(N.first_value(c("CHR_ID")), "idx").alias("chromosome"), F.min_by(N.to_int(c("CHR_POS")), "idx").alias("position_grch38")),
        "diseases": traits.groupBy(c("t.id").alias("ontology_id")).agg(F.max_by("t.name", "idx").alias("name")),
        "associated_with": assoc,
        "in_gene": named.select(F.lit("IN_GENE").alias("rel"), c("rsid").alias("src"), c("ensembl_id").alias("dst")),
        "implicated_in": rollup,
    }


def clinical_significance(clinvar: DataFrame, variants: DataFrame) -> DataFrame:
    rs = F.col("`RS# (dbSNP)`")
    rows = clinvar.filter((F.col("Assembly") == "GRCh38") & rs.rlike("^[0-9]+$") & (rs != "0")).select(F.concat(F.lit("rs"), rs).alias("rsid"), "ClinicalSignificance", "idx")
    return rows.join(variants.select("rsid"), "rsid", "left_semi").groupBy("rsid").agg(F.min_by("ClinicalSignificance", "idx").alias("clinical_significance"))


def constraint(gnomad: DataFrame) -> DataFrame:
    """pLI by symbol: the last line of the preferred transcript, else the first."""
    mane = F.lower(F.coalesce(first_present(gnomad, ["mane_select"]), F.lit("false"))) == "true"
    pli = F.col("`lof.pLI`").try_cast("double")
    rows = gnomad.filter(pli.isNotNull()).select("gene", pli.alias("v"), mane.alias("m"), "idx")
    return rows.groupBy("gene").agg(F.coalesce(F.max_by("v", F.when(F.col("m"), F.col("idx"))), F.min_by("v", "idx")).alias("pli_score"))


def cancer_genes(cosmic: DataFrame) -> DataFrame:
    symbol, tier = first_present(cosmic, ["GENE_SYMBOL", "Gene Symbol"]), first_present(cosmic, ["TIER", "Tier"])
    return cosmic.select(symbol.alias("hgnc_symbol"), F.coalesce(N.not_blank(tier), F.lit("1")).alias("t")).filter("hgnc_symbol is not null").groupBy("hgnc_symbol").agg(F.min("t").alias("cosmic_tier")).withColumn("cancer_gene", F.lit(True))


def differential_expression_wide(matrix: DataFrame, samples: DataFrame, crosswalk: DataFrame, gene: str = "gene") -> DataFrame:
    """As `differential_expression`, of a matrix with a column for each sample, whose rows stay where they are."""
    info = samples.select("sample", F.lower(F.trim("disease")).alias("d"), N.sample_type(F.col("sample_type_id"), F.col("sample")).alias("st"))
    cross = crosswalk.select(F.lower(F.trim("primary_disease")).alias("d"), F.to_json(F.struct("ontology_id", "tcga_code")).alias("cohort"))
    columns = [c for c in matrix.columns if c != gene]
    groups = sample_groups(info.join(cross, "d"), "sample", "cohort", "st between 1 and 9", "st between 10 and 19", columns)
    met = median_differences(matrix, gene, groups, COHORT_SIZE, FOLD_CHANGE)
    cohort = F.from_json("group", "ontology_id string, tcga_code string")
    return met.select(F.lit("DIFFERENTIALLY_EXPRESSED").alias("rel"), N.strip_version(F.col(gene)).alias("src"), cohort["ontology_id"].alias("dst"), cohort["tcga_code"].alias("tumor_type"), F.round("diff", 4).alias("score"), F.when(F.col("diff") > 0, "up").otherwise("down").alias("direction"), F.col("n_case").alias("n_tumor"), F.col("n_control").alias("n_normal"))


def differential_expression(matrix: DataFrame, samples: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """matrix (gene, sample, value), samples (sample, disease, sample_type_id), crosswalk (primary_disease, tcga_code, ontology_id).

    Tumour median (types 1 to 9) minus normal median (10 to 19) in each cohort with enough samples of both.
    """
    tumour = F.col("st") < 10
    info = samples.select("sample", F.lower(F.trim("disease")).alias("d"), N.sample_type(F.col("sample_type_id"), F.col("sample")).alias("st"))
    cross = crosswalk.select(F.lower(F.trim("primary_disease")).alias("d"), "tcga_code", "ontology_id")
    met = matrix.join(info.join(F.broadcast(cross), "d").filter("st between 1 and 19"), "sample")
    g = met.groupBy(N.strip_version(F.col("gene")).alias("src"), F.col("ontology_id").alias("dst"), F.col("tcga_code").alias("tumor_type")).agg(F.median(F.when(tumour, F.col("value"))).alias("t"), F.median(F.when(~tumour, F.col("value"))).alias("n"), F.count_if(tumour).alias("n_tumor"), F.count_if(~tumour).alias("n_normal"))
    change = F.col("t") - F.col("n")
    kept = g.filter((F.col("n_tumor") >= COHORT_SIZE) & (F.col("n_normal") >= COHORT_SIZE) & (F.abs(change) >= FOLD_CHANGE))
    return kept.select(F.lit("DIFFERENTIALLY_EXPRESSED").alias("rel"), "src", "dst", "tumor_type", F.round(change, 4).alias("score"), F.when(change > 0, "up").otherwise("down").alias("direction"), "n_tumor", "n_normal")


def metabolism(mets: DataFrame, s: DataFrame, rxn_gene: DataFrame, model_genes: DataFrame, rxns: DataFrame, entrez: DataFrame, gene_protein: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metabolites and CATALYSES edges of a stoichiometric model in long form.

    Metabolites of one base id are one, with the first value of each field; the sign in the matrix tells substrate from product;
    of a pair's reactions the last one names it. gene_protein: (ensembl_id, uniprot_id).
    """
    m = mets.select("idx", N.without_compartment(F.col("id")).alias("base"), "name", "formula", N.hmdb(F.col("hmdb")).alias("hmdb_id"), N.chebi(F.col("chebi")).alias("chebi_id"))
    filled = m.groupBy("base").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(c) for c in ("name", "formula", "hmdb_id", "chebi_id")])
    keyed = filled.select("base", F.coalesce("hmdb_id", "chebi_id").alias("key"), "name", "formula", "hmdb_id", "chebi_id").filter("key is not null")
    used = s.join(m.select(F.col("idx").alias("met_idx"), "base"), "met_idx").join(keyed.select("base", "key"), "base")
    enough = used.groupBy("key").agg(F.countDistinct("rxn_idx").alias("n")).filter(F.col("n") >= MIN_REACTIONS)
    owner = rxn_gene.join(model_genes.select(F.col("idx").alias("gene_idx"), N.strip_version(F.col("entrez")).alias("entrez")), "gene_idx").join(entrez, "entrez").join(gene_protein, "ensembl_id").select("rxn_idx", "uniprot_id").distinct()
    role = F.when(F.col("val") < 0, "substrate").otherwise("product")
    met = used.join(enough.select("key"), "key", "left_semi").join(owner, "rxn_idx").join(rxns.select(F.col("idx").alias("rxn_idx"), F.col("id").alias("reaction_id")), "rxn_idx")
    edges = met.groupBy(F.lit("CATALYSES").alias("rel"), F.col("uniprot_id").alias("src"), F.col("key").alias("dst"), role.alias("role")).agg(F.max_by("reaction_id", "rxn_idx").alias("reaction_id"))
    nodes = first_of(keyed.join(enough.select("key"), "key", "left_semi"), ["key"], [F.col("base").asc()]).drop("base")
    return nodes, edges


def gene_to_protein(encodes: DataFrame, produces: DataFrame, translates: DataFrame) -> DataFrame:
    """One protein for each gene in one or two steps, the smallest."""
    two = produces.select("src", F.col("dst").alias("via")).join(translates.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    return encodes.select("src", "dst").unionByName(two).groupBy(F.col("src").alias("ensembl_id")).agg(F.min("dst").alias("uniprot_id"))


def frequencies(records: DataFrame, preferred: tuple[str, ...] = ("gnomADg:ALL", "gnomADe:ALL")) -> DataFrame:
    """records (rsid, reference, populations); the first population that has the variant counts."""
    af = F.coalesce(*[N.allele_frequency(F.col("populations"), F.col("reference"), p) for p in preferred])
    return records.select("rsid", af.alias("gnomad_af")).filter("gnomad_af is not null")


def locations(comppi: DataFrame) -> DataFrame:
    """Best score of each compartment over both sides of all interactions, the top three of each protein."""
    side = lambda x: comppi.select(F.col(f"`Interactor {x}`").alias("uniprot_id"), F.explode(N.scored_locations(F.col(f"`Major Loc {x} With Loc Score`"))).alias("l"))
    best = side("A").unionByName(side("B")).filter(~F.lower(F.trim("l.loc")).isin(*LOCATION_NOISE)).groupBy("uniprot_id", F.col("l.loc").alias("loc")).agg(F.round(F.max("l.score"), 3).alias("s"))
    order: list[Column] = [F.desc("s"), F.col("loc").asc()]
    return top_list(best, ["uniprot_id"], order, "loc", 3, "subcellular_locs").join(top_list(best, ["uniprot_id"], order, "s", 3, "subcellular_loc_scores"), "uniprot_id")


def pathways(reactome: DataFrame) -> DataFrame:
    return ordered_distinct(reactome.filter("species = 'Homo sapiens'"), "uniprot", "pathway", "idx", "reactome_pathways")


def gene_set_terms(gmt: DataFrame) -> DataFrame:
    return ordered_distinct(gmt.select("gene", N.pretty_process(F.col("set_name")).alias("term"), "line"), "gene", "term", "line", "go_bp_terms")


def curated(open_targets: DataFrame, gene: DataFrame, disease: DataFrame) -> DataFrame:
    """Best score, number and sorted sources of the evidence for each gene and disease that the graph has."""
    g = open_targets.groupBy(F.col("targetId").alias("src"), F.col("diseaseId").alias("dst")).agg(F.round(F.max("score"), 4).alias("score"), F.count(F.lit(1)).alias("n_evidence"), F.array_sort(F.collect_set("datasourceId")).alias("ot_datasources"))
    keys = gene.select(F.col("ensembl_id").alias("key")).unionByName(disease.select(F.col("ontology_id").alias("key")))
    return anchored(g.withColumn("rel", F.lit("GENE_DISEASE_ASSOC")), keys)


def uniprot_fields(raw: DataFrame) -> DataFrame:
    """(accession, json) records to function text, location, GO terms, weight and subtype."""
    schema = "comments array<struct<commentType string, texts array<struct<value string>>, subcellularLocations array<struct<location struct<value string>>>>>, uniProtKBCrossReferences array<struct<database string, id string>>, sequence struct<molWeight int>"
    j = raw.select("accession", F.from_json("json", schema).alias("j"))
    of = lambda kind: F.get(F.filter("j.comments", lambda c: c["commentType"] == kind), 0)
    go = F.transform(F.filter("j.uniProtKBCrossReferences", lambda x: x["database"] == "GO"), lambda x: x["id"])
    subtype = F.lit(None).cast("string")
    for term, kind in reversed(SUBTYPES):
        subtype = F.when(F.array_contains("go_terms", term), kind).otherwise(subtype)
    return j.select("accession", F.get(of("FUNCTION")["texts"], 0)["value"].alias("summary_text"), F.get(of("SUBCELLULAR LOCATION")["subcellularLocations"], 0)["location"]["value"].alias("subcellular_loc"), go.alias("go_terms"), F.col("j.sequence.molWeight").cast("double").alias("molecular_weight")).withColumn("subtype", subtype)


def transcription_factors(edges: DataFrame) -> DataFrame:
    """Proteins that regulate something: what marks a transcription factor."""
    return edges.filter("rel = 'REGULATES'").select(F.col("src").alias("key")).distinct()


def gene_summaries(records: DataFrame, gene: DataFrame) -> DataFrame:
    """(ensembl_id, summary_text) from records (entrez, summary): the last record of a number that has a text, for each gene with that number; blank ones are left out."""
    said = records.withColumn("text", N.not_blank(F.col("summary"))).filter("text is not null").groupBy(F.substring_index(F.col("entrez").cast("string"), ".", 1).alias("entrez")).agg(F.max_by("text", "idx").alias("summary_text"))
    return gene.filter("entrez is not null").select("ensembl_id", "entrez").join(said, "entrez").select("ensembl_id", "summary_text")


def metabolite_records(hmdb: DataFrame, needed: DataFrame) -> DataFrame:
    """(hmdb_id, name, formula, inchikey) of the needed ids (hmdb_id), found by a record's accession or one of its secondary ones; the first record's own accession goes before secondary ones.

    hmdb: (accession, secondary array<string>, name, chemical_formula, inchikey, idx).
    """
    ids = F.concat(F.array(F.struct(F.lit(0).alias("way"), F.col("accession").alias("id"))), F.transform(F.coalesce("secondary", F.array().cast("array<string>")), lambda x: F.struct(F.lit(1).alias("way"), x.alias("id"))))
    rows = hmdb.select("name", "chemical_formula", "inchikey", "idx", F.explode(ids).alias("i")).select(N.hmdb(F.col("i.id")).alias("hmdb_id"), "i.way", "idx", "name", "chemical_formula", "inchikey")
    met = rows.join(needed.select("hmdb_id").distinct(), "hmdb_id", "left_semi")
    best = met.groupBy("hmdb_id").agg(F.min_by(F.struct("name", F.col("chemical_formula").alias("formula"), "inchikey"), F.struct("way", "idx")).alias("x"))
    return best.select("hmdb_id", "x.*")


def entrez_maps(hgnc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ensembl id to Entrez number, and back (there ids keep their version); the last line wins. A number that several genes share leads to all of them by the first table."""
    rows = hgnc.filter(N.not_blank(F.col("entrez_id")).isNotNull() & N.not_blank(F.col("ensembl_gene_id")).isNotNull()).select(N.strip_version(F.col("ensembl_gene_id")).alias("ensembl_id"), F.col("ensembl_gene_id").alias("raw"), F.substring_index("entrez_id", ".", 1).alias("entrez"), "idx")
    return rows.groupBy("ensembl_id").agg(F.max_by("entrez", "idx").alias("entrez")), rows.groupBy("entrez").agg(F.max_by("raw", "idx").alias("ensembl_id"))
