"""Whether two records are one work: features of a pair, and an ordered ladder of rules for each context.

A ladder is SQL text over the features, in the order in which its rules apply; the first that fits
decides. Costly features come from one pass: names as native array functions, titles and venues through
one Arrow function for both."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import policy
from lectern.functions import ids, people, similarity, text, venues

COMPOSITE = (
    "(0.40 * sim + 0.25 * ratio + CASE WHEN gap = 0 THEN 0.10 WHEN gap = 1 THEN 0.05 ELSE 0.0 END"
    " + 0.15 * venue_sim + CASE WHEN ext THEN 0.15 ELSE 0.0 END)"
)
XOR_BONUS = "CASE WHEN l_pre_rec <> r_pre_rec THEN 0.10 ELSE 0.0 END"
TITLED = "l_norm <> '' AND r_norm <> ''"

LADDERS = {
    "import": f"""CASE
        WHEN NOT targeted AND l_norm <> '' AND l_norm = r_norm AND l_named AND r_named AND NOT shared THEN 'AUTHOR_CONFLICT'
        WHEN NOT targeted AND l_norm <> '' AND l_norm = r_norm AND gap > 3 THEN 'YEAR_CONFLICT'
        WHEN NOT targeted AND l_norm <> '' AND l_norm = r_norm THEN '+IMPORT_EXACT_TITLE'
        WHEN sim < {policy.TITLE_MIN} THEN 'BELOW_MIN_SIM'
        WHEN {policy.TITLE_WEIGHT} * sim + CASE WHEN shared THEN {policy.AUTHOR_BONUS} ELSE 0.0 END
          + CASE WHEN gap <= 1 THEN {policy.YEAR_BONUS} ELSE 0.0 END >= {policy.DUPLICATE} THEN '+IMPORT_WEIGHTED'
        ELSE 'IMPORT_WEIGHTED' END""",
    "enrichment": f"""CASE
        WHEN l_doi <> '' AND l_doi = r_doi AND NOT ({TITLED}) THEN 'MISSING_TITLE'
        WHEN l_doi <> '' AND l_doi = r_doi AND sim < {policy.IDENTIFIER_TITLE} THEN 'IDENTIFIER_TITLE_CONFLICT'
        WHEN l_doi <> '' AND l_doi = r_doi THEN '+DOI_EXACT'
        WHEN l_doi <> '' AND r_doi <> '' AND l_pre = r_pre THEN 'DOI_CONFLICT'
        WHEN l_arxiv <> '' AND r_arxiv <> '' AND l_arxiv <> r_arxiv THEN 'ARXIV_CONFLICT'
        WHEN NOT ({TITLED}) THEN 'MISSING_TITLE'
        WHEN l_arxiv <> '' AND l_arxiv = r_arxiv AND sim < {policy.IDENTIFIER_TITLE} THEN 'IDENTIFIER_TITLE_CONFLICT'
        WHEN l_arxiv <> '' AND l_arxiv = r_arxiv THEN '+ARXIV_EXACT'
        WHEN ext AND sim >= {policy.MULTI_SIGNAL} THEN '+EXTERNAL_ID'
        WHEN sim >= {policy.DUPLICATE} AND gap > 3 THEN 'YEAR_CONFLICT'
        WHEN sim >= {policy.DUPLICATE} AND shared THEN '+HIGH_TITLE_SIM'
        WHEN sim >= {policy.DUPLICATE} THEN 'AUTHOR_CONFLICT'
        WHEN trunc AND gap > 3 THEN 'YEAR_CONFLICT'
        WHEN trunc AND shared THEN '+TRUNCATED_TITLE'
        WHEN sim < {policy.MULTI_SIGNAL} THEN 'BELOW_MIN_SIM'
        WHEN l_pre_rec = r_pre_rec AND NOT ext AND NOT (ratio >= 0.9 AND sim >= 0.6 AND l_people >= 2 AND r_people >= 2) THEN 'GATE_CLOSED'
        WHEN round({COMPOSITE}, 9) >= {policy.COMPOSITE} THEN '+COMPOSITE'
        ELSE 'COMPOSITE' END""",
    "doi_net": f"""CASE
        WHEN l_doi = '' OR r_doi = '' OR l_base <> r_base THEN 'NO_MATCH'
        WHEN NOT ({TITLED}) THEN 'MISSING_TITLE'
        WHEN sim < {policy.IDENTIFIER_TITLE} THEN 'IDENTIFIER_TITLE_CONFLICT'
        WHEN l_doi = r_doi THEN '+DOI_EXACT'
        ELSE '+DOI_VERSION' END""",
    "survivor": f"""CASE
        WHEN l_doi <> '' AND r_doi <> '' AND l_base = r_base AND NOT ({TITLED}) THEN 'MISSING_TITLE'
        WHEN l_doi <> '' AND r_doi <> '' AND l_base = r_base AND sim < {policy.IDENTIFIER_TITLE} THEN 'IDENTIFIER_TITLE_CONFLICT'
        WHEN l_doi <> '' AND l_doi = r_doi THEN '+DOI_EXACT'
        WHEN l_doi <> '' AND r_doi <> '' AND l_base = r_base THEN '+DOI_VERSION'
        WHEN l_doi <> '' AND r_doi <> '' AND l_sec <> r_sec AND l_arxiv <> '' AND r_arxiv <> '' AND l_arxiv <> r_arxiv THEN 'ARXIV_CONFLICT'
        WHEN l_doi <> '' AND r_doi <> '' AND l_sec <> r_sec AND sim >= {policy.PREPRINT_TITLE}
          AND round({COMPOSITE}, 9) >= {policy.COMPOSITE} THEN '+PREPRINT_PAIR'
        WHEN l_doi <> '' AND r_doi <> '' AND l_sec <> r_sec THEN 'PREPRINT_PAIR'
        WHEN l_doi <> '' AND r_doi <> '' THEN 'DOI_CONFLICT'
        WHEN ext AND sim >= {policy.PREPRINT_TITLE} THEN '+EXTERNAL_ID'
        WHEN same_key AND (sim >= {policy.DUPLICATE} OR prefix20) THEN '+KEY_TITLE'
        WHEN same_key AND ratio >= 0.8 AND sim >= {policy.PREPRINT_TITLE} THEN '+KEY_AUTHOR_OVERLAP'
        WHEN same_key THEN 'NO_MATCH'
        WHEN sim >= {policy.DUPLICATE} AND l_doi = '' AND r_doi = '' AND gap > 3 THEN 'YEAR_CONFLICT'
        WHEN sim >= {policy.DUPLICATE} AND l_doi = '' AND r_doi = '' AND NOT shared THEN 'AUTHOR_CONFLICT'
        WHEN sim >= {policy.DUPLICATE} THEN '+HIGH_TITLE_SIM'
        WHEN trunc AND l_doi = '' AND r_doi = '' AND gap > 3 THEN 'YEAR_CONFLICT'
        WHEN trunc AND shared THEN '+TRUNCATED_TITLE'
        WHEN sim >= 0.6 AND l_people >= 2 AND r_people >= 2 AND ratio >= 0.9
          AND round({COMPOSITE} + {XOR_BONUS}, 9) >= {policy.COMPOSITE} THEN '+COMPOSITE'
        WHEN sim >= {policy.PREPRINT_TITLE} AND shared AND (l_sec OR l_server) <> (r_sec OR r_server)
          AND ((l_sec OR l_server) AND (r_doi <> '' OR r_journal <> '') OR (r_sec OR r_server) AND (l_doi <> '' OR l_journal <> '')) THEN '+PREPRINT_RELAXED'
        ELSE 'NO_MATCH' END""",
}

# Each ladder's verdict needs an equal value of one of these, or the title similarity beside them: a
# beginning or end is of 15 characters, the least that `trunc` takes (`prefix20` takes more).
BLOCKS = {
    "import": ((), policy.TITLE_MIN),
    "enrichment": (("base", "arxiv", "head", "tail"), min(policy.MULTI_SIGNAL, policy.DUPLICATE)),
    "doi_net": (("base",), None),
    "survivor": (("base", "head", "tail"), min(policy.PREPRINT_TITLE, policy.DUPLICATE, 0.6)),
}
TILES = 8


def _similar(records: DataFrame, least: float) -> DataFrame:
    """(lid, rid) of records of one author whose titles have a similarity of `least`. None is lost: it
    needs lengths within (2 - least) / least of each other, so that bands of that width are neighbours."""
    width = math.log((2 - least) / least * 1.001)
    band = F.floor(F.log(F.greatest(F.length("norm"), F.lit(1)).cast("double")) / width)
    # an author is a skewed key: the left side is dealt into tiles, the right side goes to all of them
    l = records.select("dir", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.pmod(F.xxhash64("id"), F.lit(TILES)).cast("int").alias("tile"), F.col("id").alias("lid"), F.col("norm").alias("l_norm"))
    r = records.select("dir", band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))).alias("tile"), F.col("id").alias("rid"), F.col("norm").alias("r_norm"))
    la, lb = F.length("l_norm"), F.length("r_norm")
    fits = (F.col("lid") < F.col("rid")) & ((2 * F.least(la, lb) >= least * (la + lb) - 1e-9) | (F.col("l_norm") == F.col("r_norm")))
    key, tasks = ["dir", "band", "tile"], 64  # small in bytes, quadratic in work: not to be coalesced
    near = l.repartition(tasks, *key).join(r.repartition(tasks, *key), key).where(fits)
    return near.where(similarity.indel_ratio("l_norm", "r_norm") >= least).select("lid", "rid")


def candidates(files: DataFrame, context: str) -> DataFrame:
    """Pairs of records of one author, with the columns of v_pairs: all that a ladder can accept."""
    norm, doi = text.normalize_title("title"), ids.norm_doi("doi")
    files = _with_identifiers(files)
    records = files.select("id", "dir", norm.alias("norm"), ids.doi_base(doi).alias("base"), "arxiv").select(
        "*", *[F.when(F.length("norm") >= 15, f("norm", F.lit(15))).alias(n) for n, f in (("head", F.left), ("tail", F.right))])
    keys, least = BLOCKS[context]
    found = [] if least is None else [_similar(records, least)]
    for k in keys:
        l, r = (records.select("dir", k, F.col("id").alias(i)) for i in ("lid", "rid"))
        found.append(l.join(r, ["dir", k]).where("lid < rid").select("lid", "rid"))
    pairs = reduce(DataFrame.unionByName, found)
    if keys:
        pairs = pairs.distinct()
    venue = F.coalesce("journal", "booktitle", "howpublished")
    side = lambda s: files.select(F.col("id").alias(f"{s}id"), *(["dir"] if s == "l" else []), *[F.col(c).alias(f"{s}{c}") for c in ("key", "title", "author", "year", "doi", "journal", "arxiv")], F.col("s2_id").alias(f"{s}s2"), venue.alias(f"{s}venue"))
    return pairs.join(side("l"), "lid").join(side("r"), "rid")


def _with_identifiers(files: DataFrame) -> DataFrame:
    """`files` with arxiv; its columns archiveprefix and eprint may be missing."""
    held = {c: F.col(c) if c in files.columns else F.lit(None).cast("string") for c in ("archiveprefix", "eprint")}
    return files.withColumn("arxiv", ids.entry_arxiv(held["archiveprefix"], held["eprint"], F.col("doi"), F.coalesce(F.nullif("journal", F.lit("")), "howpublished")))


def _facts(c) -> Column:
    """What the ladders read of one record, as a struct; `c` gives its columns by name."""
    names, doi = people.parse_authors(c("author")), text.text(ids.norm_doi(c("doi")))
    return F.struct(
        text.normalize_title(c("title")).alias("norm"), text.normalize_title(c("venue")).alias("venue"),
        people.signatures(names).alias("sigs"), F.size(names).alias("people"), c("year").alias("year"),
        doi.alias("doi"), text.text(c("journal")).alias("journal"), c("key").alias("key"), c("s2").alias("s2"),
        text.text(c("arxiv")).alias("arxiv"), (F.trim(text.text(c("author"))) != "").alias("named"),
        ids.doi_base(doi).alias("base"), ids.is_secondary_doi(doi).alias("sec"), ids.is_preprint_doi(doi).alias("pre"),
        venues.is_preprint_server(c("journal")).alias("server"),
    )


def all_pairs(files: DataFrame) -> DataFrame:
    """(lid, rid, l, r): all pairs of records of an author, with the facts of either side. Facts are computed once for
    each record, below the join."""
    held = _with_identifiers(files).withColumn("venue", F.coalesce("journal", "booktitle", "howpublished")).withColumnRenamed("s2_id", "s2")
    each = held.select("id", "dir", _facts(F.col).alias("facts"))
    l, r = (each.select("dir", F.col("id").alias(f"{s}id"), F.col("facts").alias(s)) for s in "lr")
    return l.join(r, "dir").where("lid < rid").select("lid", "rid", "l", "r")


def features(pairs: DataFrame, target: str | None = None) -> DataFrame:
    """Features of pairs with lid, rid and either facts l and r, or l/r title, author, year, doi, journal, venue, key, s2,
    arxiv. With a target author, that name stands for the left list of authors."""
    if "l" not in pairs.columns:
        pairs = pairs.select("lid", "rid", *[_facts(lambda n, s=s: F.col(s + n)).alias(s) for s in "lr"])
    if target is not None:
        names = people.parse_authors(F.lit(target))
        said = {"sigs": people.signatures(names), "people": F.size(names), "named": F.lit(target.strip() != "")}
        left = F.col("l")
        for name, value in said.items():
            left = left.withField(name, value)
        pairs = pairs.withColumn("l", left)
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("norm", "venue", "people", "doi", "journal", "arxiv", "named", "base", "sec", "pre", "server")]
    base = pairs.select(
        "lid", "rid", *sides, F.col("l.sigs").alias("a"), F.col("r.sigs").alias("b"),
        F.abs(F.col("l.year") - F.col("r.year")).alias("gap"),
        F.expr("l.key <> '' and l.key = r.key").alias("same_key"),
        F.lit(target is not None).alias("targeted"),
        F.coalesce(F.col("l.s2") == F.col("r.s2"), F.lit(False)).alias("ext"),
    )
    return base.select(
        "*",
        similarity.indel_ratio("l_norm", "r_norm").alias("sim"),
        similarity.indel_ratio("l_venue", "r_venue").alias("venue_any"),
        people.overlap(F.col("a"), F.col("b")).alias("shared"),
        people.overlap_ratio(F.col("a"), F.col("b")).alias("ratio"),
        text.truncated_match(F.col("l_norm"), F.col("r_norm")).alias("trunc"),
    ).select(
        "*",
        F.when((F.col("l_venue") == "") | (F.col("r_venue") == ""), 0.0).otherwise(F.col("venue_any")).alias("venue_sim"),
        *[F.expr(f"{s}_pre or {s}_server").alias(f"{s}_pre_rec") for s in "lr"],
        F.expr("(startswith(l_norm, r_norm) and length(r_norm) > 20) or (startswith(r_norm, l_norm) and length(l_norm) > 20)").alias("prefix20"),
    )


def decide(pairs: DataFrame, context: str, target: str | None = None) -> DataFrame:
    """(lid, rid, verdict, reason) of each pair in one context; `target` is for "import" alone."""
    step = features(pairs, target).withColumn("step", F.expr(LADDERS[context]))
    return step.select("lid", "rid", F.startswith("step", F.lit("+")).alias("verdict"), F.regexp_replace("step", r"^\+", "").alias("reason"))
