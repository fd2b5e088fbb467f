"""Queries of dataset curation over the candidate, roster, manifest and provenance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions.forms import label_form, path_form, usable_score
from quillon.operators.curation import average_hash, capped_splits, closure, dense, exact_quota, first_n, greedy_accept, hamming, ordered_union, reachable, replace_in_place, upsert
from quillon.operators.ranking import first_seen, last_wins
from quillon.plans.durable import lookup_join
from quillon.plans.tables import table

#: The roles of pilot concepts.
ROLES = ("stress_medium", "anchor_high")
SOURCES, TARGET, SCORE = ["gridnet", "openpix", "freelens"], 5, 0.25
FEASIBLE = ["low", "disputed", "medium", "high"]


def roster(spark, sf_dir) -> DataFrame:
    """concept, stratum, feasibility, ordinal, target_count of the core roster, a concept once."""
    t = table(spark, sf_dir, "roster_core").select(label_form("concept").alias("concept"), label_form("stratum").alias("stratum"), label_form("source_feasibility").alias("feasibility"), "ordinal", "target_count")
    return t.where("concept is not null").groupBy("concept").agg(*[F.max(c).alias(c) for c in ("stratum", "feasibility", "ordinal", "target_count")])


def reserve(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "reserve_catalog").select(label_form("concept").alias("concept"), label_form("stratum").alias("stratum"), label_form("source_feasibility").alias("feasibility"), "added_at")
    return t.where("concept is not null").groupBy("concept").agg(F.max("stratum").alias("stratum"), F.max("feasibility").alias("feasibility"), F.min("added_at").alias("added_at"))


def offered(spark, sf_dir, where=None) -> DataFrame:
    """The candidate rows with labels in canonical form, repeated ones too."""
    cols = ["candidate_id", "run_id", "source_class_label", "source_class_id", "proxy_used", "acquisition_method", "candidate_filename", "clip_score", "fetched_at"]
    t = table(spark, sf_dir, "candidate").select(label_form("concept").alias("concept"), label_form("source").alias("source"), *cols)
    return t if where is None else t.where(where)


def candidates(spark, sf_dir, where=None) -> DataFrame:
    """The candidates that meet ``where``, each once; a repeated row is the same, so it is filtered before."""
    return offered(spark, sf_dir, where).dropDuplicates(["candidate_id"])


def required() -> Column:
    return F.col("concept").isNotNull() & F.col("source").isin(SOURCES)


def good() -> Column:
    return usable_score("clip_score") & (F.col("clip_score") >= SCORE)


def accepted(spark, sf_dir) -> DataFrame:
    """The first candidates of each concept and required source that reach the score, numbered as slots.

    Repeated rows share a rank and go once the ranks are cut, so only the kept rows are shuffled.
    """
    place = F.dense_rank().over(Window.partitionBy("concept", "source").orderBy("fetched_at", "candidate_id"))
    return offered(spark, sf_dir, required() & good()).withColumn("slot", place).where(F.col("slot") <= TARGET).dropDuplicates(["candidate_id"])


def counts(spark, sf_dir) -> DataFrame:
    """concept, source, n for every roster concept and required source."""
    held = accepted(spark, sf_dir).groupBy("concept", "source").agg(F.count("*").alias("n"))
    return dense(roster(spark, sf_dir).select("concept"), SOURCES, "source", held, ["concept"])


def roster_manifest(spark, sf_dir):
    """The empty manifest of the roster: slugs, zero counts and the wanted mix."""
    r = roster(spark, sf_dir)
    mix = F.create_map(*[x for s in SOURCES for x in (F.lit(s), F.lit(TARGET))])
    return r.select("concept", "stratum", S.slug(F.col("concept")).alias("storage_slug"), F.lit(0).alias("num_images"), F.to_json(mix).alias("source_mix_target"), "ordinal")


def roster_checks(spark, sf_dir):
    """Strata with their number of concepts, of wanted images, and of concepts given more than once."""
    t = table(spark, sf_dir, "roster_core").select(label_form("concept").alias("concept"), label_form("stratum").alias("stratum"), "target_count").where("concept is not null")
    once = t.groupBy("concept").agg(F.max("stratum").alias("stratum"), F.max("target_count").alias("target_count"), F.count("*").alias("n"))
    return once.groupBy("stratum").agg(F.count("*").alias("n_concepts"), F.sum("target_count").alias("n_images"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def accepted_images(spark, sf_dir):
    name = F.format_string("%s_%s_%02d.jpg", S.slug(F.col("concept")), F.col("source"), F.col("slot"))
    return accepted(spark, sf_dir).select("concept", "source", "slot", "candidate_id", name.alias("file_name"), F.bround("clip_score", 4).alias("clip_score"))


def source_counts(spark, sf_dir):
    """One row per roster concept with the images of each source and their total."""
    wide = counts(spark, sf_dir).groupBy("concept").pivot("source", SOURCES).agg(F.sum("n"))
    return wide.withColumn("total", sum(F.col(s) for s in SOURCES))


def fill_summary(spark, sf_dir):
    """How much of the roster is filled, and what to do about it."""
    c = counts(spark, sf_dir)
    cells = c.agg(F.count("*").alias("n_cells"), F.count_if(F.col("n") >= TARGET).alias("n_filled"))
    total = c.groupBy("concept").agg(F.sum("n").alias("n"))
    full = TARGET * len(SOURCES)
    states = total.agg(F.count_if(F.col("n") == full).alias("n_complete"), F.count_if(F.col("n").between(1, full - 1)).alias("n_partial"), F.count_if(F.col("n") == 0).alias("n_empty"))
    rate = F.col("n_filled") / F.greatest(F.col("n_cells"), F.lit(1))
    weak = c.groupBy("source").agg(F.avg((F.col("n") >= TARGET).cast("double")).alias("r")).agg(F.count_if(F.col("r") < 0.5).alias("n_weak_sources"))
    blocked = F.col("n_partial") + F.col("n_empty")
    decision = F.when((blocked > 8) | (F.col("n_weak_sources") > 0), "stop").when((blocked > 3) | (rate < 0.85), "adjust").otherwise("expand")
    return cells.join(states).join(weak).withColumn("fill_rate", F.round(rate, 6)).withColumn("decision", decision)


def fill_by_source(spark, sf_dir):
    c = counts(spark, sf_dir)
    return c.groupBy("source").agg(F.count_if(F.col("n") >= TARGET).alias("n_filled"), F.round(F.avg((F.col("n") >= TARGET).cast("double")), 6).alias("fill_rate"), F.sum("n").alias("n_images"))


def rejections(spark, sf_dir):
    """Why candidates of a required source were not taken: of a concept's good ones, all beyond the target are over the quota."""
    c = candidates(spark, sf_dir, required())
    reason = F.when(~F.coalesce(usable_score("clip_score"), F.lit(False)), "no_score").when(~F.coalesce(good(), F.lit(False)), "below_score").otherwise("accepted")
    n = c.groupBy("concept", "source", reason.alias("reason")).agg(F.count("*").alias("n"))
    taken = F.when(F.col("reason") == "accepted", F.least("n", F.lit(TARGET))).otherwise(F.col("n"))
    parts = F.array(F.struct("reason", taken.alias("n")), F.struct(F.lit("over_quota").alias("reason"), (F.col("n") - taken).alias("n")))
    return n.select("source", F.inline(parts)).where("n > 0").groupBy("source", "reason").agg(F.sum("n").alias("n"))


def worst_concepts(spark, sf_dir):
    """The fifteen emptiest of the unfilled concepts: fewest images, medium feasibility first, then by name."""
    t = counts(spark, sf_dir).groupBy("concept").agg(F.sum("n").alias("n")).join(roster(spark, sf_dir), "concept").where(F.col("n") < TARGET * len(SOURCES))
    return t.orderBy("n", (F.coalesce("feasibility", F.lit("")) != "medium").cast("int"), "concept").limit(15).select("concept", "n", "feasibility")


def work_queue(spark, sf_dir, batch: int | None = None):
    """The whole queue (or its first ``batch``): unfilled concepts that have something to take, by what there is, all keys descending, the name too.

    First whether there are hits, classes and labels at all and whether feasibility is high, then images
    held, hits, classes, labels, name.
    """
    c = candidates(spark, sf_dir, required())
    offer = c.groupBy("concept").agg(F.count_if(good()).alias("n_hits"), F.countDistinct("source_class_id").alias("n_classes"), F.countDistinct("source_class_label").alias("n_labels"))
    have = counts(spark, sf_dir).groupBy("concept").agg(F.sum("n").alias("n_images"))
    df = roster(spark, sf_dir).join(have, "concept").join(offer, "concept").where((F.col("n_images") < TARGET * len(SOURCES)) & ((F.col("n_hits") > 0) | (F.col("n_classes") > 0) | (F.col("n_labels") > 0)))
    high = F.coalesce(F.col("feasibility") == "high", F.lit(False))
    keys = [F.col("n_hits") > 0, F.col("n_classes") > 0, F.col("n_labels") > 0, high, *[F.col(k) for k in ("n_images", "n_hits", "n_classes", "n_labels", "concept")]]
    df = df.orderBy(*[k.desc() for k in keys])
    return (df if batch is None else df.limit(batch)).select("concept", "n_images", "n_hits", "n_classes", "n_labels", high.alias("high"))


def work_batch(spark, sf_dir):
    """The next forty of the queue."""
    return work_queue(spark, sf_dir, 40)


def tracker_slots(spark, sf_dir):
    """Every slot of every roster concept and source with the image in it, -1 where it is open."""
    slots = roster(spark, sf_dir).select("concept", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(TARGET))))
    held = accepted(spark, sf_dir).select("concept", "source", "slot", "candidate_id")
    return slots.join(held, ["concept", "source", "slot"], "left").withColumn("candidate_id", F.coalesce("candidate_id", F.lit(-1).cast("long")))


def reserve_status(spark, sf_dir):
    """Reserve concepts by which required sources offer a good candidate."""
    ready = offered(spark, sf_dir, good()).groupBy("concept").agg(*[F.bool_or(F.col("source") == s).alias(s) for s in SOURCES[:2]])
    r = reserve(spark, sf_dir).join(ready, "concept", "left")
    a, b = (F.coalesce(s, F.lit(False)) for s in SOURCES[:2])
    status = F.when(a & b, "bulk_ready").when(a, f"needs_{SOURCES[1]}").when(b, f"needs_{SOURCES[0]}").otherwise("needs_swap")
    return r.select("concept", "stratum", "feasibility", status.alias("status"))


def reserve_histogram(spark, sf_dir):
    return reserve_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def suggestions(spark, sf_dir):
    """For each roster concept without images, up to five ready reserve concepts of its stratum."""
    empty = counts(spark, sf_dir).groupBy("concept").agg(F.sum("n").alias("n")).where("n = 0").join(roster(spark, sf_dir).select("concept", "stratum"), "concept")
    ready = reserve_status(spark, sf_dir).where("status = 'bulk_ready'").select(F.col("concept").alias("replacement"), "stratum")
    # Only five per stratum can be suggested: they are cut before the join.
    best = first_n(ready, ["stratum"], ["replacement"], 5, "place")
    return empty.join(best, "stratum").select("concept", "stratum", "place", "replacement")


def pilot(spark, sf_dir):
    """Three concepts a stratum: some of medium feasibility, then others, then further medium ones.

    One medium concept is wanted where there is any, two where they are at least two fifths.
    """
    r = roster(spark, sf_dir).where("stratum is not null").withColumn("medium", F.coalesce(F.col("feasibility") == "medium", F.lit(False)))
    w = Window.partitionBy("stratum")
    r = r.withColumn("_m", F.count_if("medium").over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(Window.partitionBy("stratum", "medium").orderBy("ordinal", "concept")))
    target = F.when(F.col("_m") / F.col("_n") >= 0.4, F.least(F.lit(2), F.col("_m"))).otherwise(F.least(F.lit(1), F.col("_m")))
    order = F.when(F.col("medium") & (F.col("_k") <= target), 0).when(~F.col("medium"), 1).otherwise(2)
    role = F.when(F.col("medium"), ROLES[0]).otherwise(ROLES[1])
    return first_n(r.withColumn("_o", order), ["stratum"], ["_o", "_k"], 3, "place").select("stratum", "place", "concept", "feasibility", role.alias("role"))


def pilot_strata(spark, sf_dir):
    """The pilot by stratum with its concepts in a list."""
    p = pilot(spark, sf_dir)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "concept"))), lambda x: x["concept"])
    return p.groupBy("stratum").agg(F.array_join(listed, ", ").alias("concepts"), F.count_if(F.col("role") == ROLES[1]).alias("n_high"), F.count_if(F.col("role") == ROLES[0]).alias("n_medium"))


def complete_subset(spark, sf_dir):
    """Roster concepts with exactly the wanted number from each required source and nothing else."""
    held = accepted(spark, sf_dir).groupBy("concept", "source").agg(F.count("*").alias("n"))
    full = exact_quota(held, ["concept"], SOURCES, "source", TARGET)
    return roster(spark, sf_dir).join(full, "concept", "left_semi").select("concept", "stratum", "ordinal")


def builds(spark, sf_dir) -> DataFrame:
    """The builds, each once: build_row_id, concept, built_at, status, slug, num_images, images."""
    t = table(spark, sf_dir, "data_manifest_250").select("build_row_id", label_form("concept").alias("concept"), "built_at", label_form("selection_status").alias("status"), F.col("storage_slug").alias("slug"), "num_images", F.col("concept_to_images").alias("images"))
    return t.dropDuplicates(["build_row_id"]).where("concept is not null")


def merged_manifest(spark, sf_dir):
    """A concept's first build, with slug and count of its last frozen one where those are given."""
    b = builds(spark, sf_dir)
    base = first_seen(b, ["concept"], ["built_at", "build_row_id"]).select("concept", "status", "slug", "num_images")
    frozen = last_wins(b.where("status = 'frozen'"), ["concept"], ["built_at", "build_row_id"])
    return upsert(base, frozen, ["concept"], ["slug", "num_images", "status"])


def swapped_roster(spark, sf_dir):
    """The roster with empty concepts replaced in place by their first suggestion, one use each."""
    s = suggestions(spark, sf_dir)
    one = first_n(s.withColumn("_k", F.row_number().over(Window.partitionBy("stratum", "place").orderBy("concept"))), ["stratum", "concept"], ["place"], 5, "_p")
    order = F.dense_rank().over(Window.partitionBy("stratum").orderBy("concept"))
    swaps = one.withColumn("_n", order).where("_n = place").select(F.col("concept").alias("old"), F.col("replacement").alias("new"))
    return replace_in_place(roster(spark, sf_dir).select("ordinal", "stratum", "concept"), "concept", swaps)


def swap_checks(spark, sf_dir):
    """What would forbid a swap: the new concept is in the roster already, or is of another stratum."""
    r, v = roster(spark, sf_dir), reserve(spark, sf_dir)
    both = v.join(r.select("concept", F.col("stratum").alias("roster_stratum")), "concept").select("concept", F.when(F.col("stratum") == F.col("roster_stratum"), "in_roster").otherwise("in_roster_of_other_stratum").alias("problem"))
    return both


def seeds(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "scale250_seed_provenance").select("seed_id", label_form("target_concept").alias("concept"), label_form("target_source").alias("source"), path_form("source_manifest").alias("manifest"), path_form("source_filename").alias("file"), "selected_at", F.col("selection_note").alias("note"))
    return t.dropDuplicates(["seed_id"])


def seeded_images(spark, sf_dir):
    """The first three taken-over images of each roster concept, with their new names."""
    s = seeds(spark, sf_dir).where("concept is not null and file is not null").join(roster(spark, sf_dir).select("concept"), "concept", "left_semi")
    k = first_n(s, ["concept"], ["selected_at", "seed_id"], 3)
    return k.select("concept", "slot", "seed_id", F.format_string("%s_%03d.jpg", S.slug(F.col("concept")), F.col("slot")).alias("file_name"))


def rollback(spark, sf_dir):
    """Accepted images by proxy whose class is not the concept's: ledger states after they are taken back."""
    a = accepted(spark, sf_dir)
    bad = (F.col("proxy_used") == "true") & ~F.contains(F.concat(F.lit(" "), S.normalise(F.col("concept")), F.lit(" ")), F.concat(F.lit(" "), S.normalise(F.col("source_class_label")), F.lit(" ")))
    return a.select("candidate_id", "concept", "source", F.when(F.coalesce(bad, F.lit(False)), "rolled_back").otherwise("accepted").alias("state"))


def rollback_counts(spark, sf_dir):
    """Images left per concept after the rollback."""
    return rollback(spark, sf_dir).groupBy("concept").agg(F.count_if(F.col("state") == "accepted").alias("n_left"), F.count_if(F.col("state") == "rolled_back").alias("n_back"))


def labels(spark, sf_dir) -> DataFrame:
    """The class labels that sources use: label, class_id (the first of a label)."""
    t = table(spark, sf_dir, "candidate").select(S.normalise(F.col("source_class_label")).alias("label"), F.col("source_class_id").alias("class_id")).where("label <> '' and class_id is not null")
    return t.groupBy("label").agg(F.min("class_id").alias("class_id"))


def label_matches(spark, sf_dir):
    """Each roster concept's class: by its whole name, else by its last word, else none."""
    r = roster(spark, sf_dir).select("concept", S.normalise(F.col("concept")).alias("name"))
    r = r.withColumn("tries", F.array("name", F.element_at(F.split("name", " "), -1)))
    hits = r.select("concept", F.posexplode("tries").alias("pos", "label")).join(labels(spark, sf_dir), "label")
    best = first_seen(hits, ["concept"], ["pos"]).select("concept", "label", "class_id", F.when(F.col("pos") == 0, "exact").otherwise("proxy").alias("how"))
    return r.select("concept").join(best, "concept", "left").select("concept", "label", "class_id", F.coalesce("how", F.lit("none")).alias("how"))


def label_hits(spark, sf_dir):
    """At most four hits per class and way of finding; later ways are skipped once earlier ones hold four."""
    c = candidates(spark, sf_dir, F.expr("source_class_id is not null and acquisition_method is not null")).select("source_class_id", "acquisition_method", "candidate_id")
    return capped_splits(c, "source_class_id", "acquisition_method", ["candidate_id"], 4)


def _tree(spark, sf_dir) -> DataFrame:
    """child, parent: concepts below their last word, words below strata, strata below one root."""
    r = roster(spark, sf_dir).where("stratum is not null").select("concept", F.concat(F.lit("w:"), F.element_at(F.split("concept", "_"), -1)).alias("word"), F.concat(F.lit("s:"), "stratum").alias("stratum"))
    pairs = F.explode(F.array(F.struct(F.col("concept").alias("child"), F.col("word").alias("parent")), F.struct(F.col("word").alias("child"), F.col("stratum").alias("parent")), F.struct(F.col("stratum").alias("child"), F.lit("root").alias("parent"))))
    return r.select(pairs.alias("x")).select("x.*").distinct()


def label_closure(spark, sf_dir):
    return closure(_tree(spark, sf_dir)).select("child", "ancestor", F.col("level").cast("int").alias("level"))


def label_descendants(spark, sf_dir):
    """Up to twelve nodes within two steps below each stratum."""
    e = _tree(spark, sf_dir)
    roots = e.where("parent = 'root'").select(F.col("child").alias("root"))
    return reachable(e, roots, 2, 12).select("root", "node", F.col("level").cast("int").alias("level"))


def concept_order(spark, sf_dir):
    """Concepts with images in the order of their first build, then roster concepts without any."""
    b = builds(spark, sf_dir).where("size(images) > 0").groupBy("concept").agg(F.min("build_row_id").alias("ordinal"))
    r = roster(spark, sf_dir).select("concept", F.col("ordinal").cast("long").alias("ordinal"))
    return ordered_union(b, r, "concept", "ordinal")


def sync_manifest(spark, sf_dir):
    """The last build of each concept against the files: listed, found, of a known source, and its recount."""
    last = last_wins(builds(spark, sf_dir), ["concept"], ["built_at", "build_row_id"])
    listed = last.select("concept", "built_at", "num_images", F.explode("images").alias("p")).select("concept", "built_at", "num_images", path_form("p").alias("relpath")).where("relpath is not null").dropDuplicates(["concept", "relpath"])
    files = table(spark, sf_dir, "image_file").select(path_form("relpath").alias("relpath"), "created_at", "deleted_at")
    there = listed.join(files, "relpath").where("created_at <= built_at and (deleted_at is null or deleted_at > built_at)").select("concept", "relpath").distinct().withColumn("there", F.lit(True))
    src = S.source_of_file(F.col("relpath"), ["gridnet", "openpix", "freelens", "photobarn", "wikishots", "fieldcam", "museo_scans", "stockyard", "sketchpool", "aerial_set", "herbarium_x", "retro_slides"])
    j = listed.join(there, ["concept", "relpath"], "left").withColumn("source", src)
    return j.groupBy("concept").agg(F.count("*").alias("n_listed"), F.count("there").alias("n_found"), F.count("source").alias("n_with_source"), F.countDistinct("source").alias("n_sources"), (F.max("num_images") != F.count("*")).alias("count_is_off"))


def next_file_number(spark, sf_dir):
    """The next free number of each concept and source: one more than the greatest, or the number of files."""
    f = table(spark, sf_dir, "image_file").groupBy("file_id").agg(F.max(label_form("concept")).alias("concept"), F.max(label_form("source")).alias("source"), F.max("filename").alias("filename"))
    n = F.nullif(F.regexp_extract("filename", r"_([0-9]{1,18})[.][^.]*$", 1), F.lit("")).try_cast("long")
    return f.groupBy("concept", "source").agg(F.coalesce(F.max(n) + 1, F.count("*")).alias("next_number"))


def model_coverage(spark, sf_dir):
    """Concepts of each model that the roster lacks, and roster concepts the model lacks."""
    v = table(spark, sf_dir, "replication_results").select("model", label_form("concept").alias("concept")).where("model is not null and concept is not null").distinct()
    r = roster(spark, sf_dir).select("concept")
    extra = v.join(r, "concept", "left_anti").groupBy("model").agg(F.count("*").alias("n_extra"))
    have = v.join(r, "concept", "left_semi").groupBy("model").agg(F.count("*").alias("n_have"))
    total = r.agg(F.count("*").alias("n_roster"))
    return v.select("model").distinct().join(extra, "model", "left").join(have, "model", "left").join(F.broadcast(total)).select("model", F.coalesce("n_extra", F.lit(0)).alias("n_extra"), (F.col("n_roster") - F.coalesce("n_have", F.lit(0))).alias("n_missing"))


def compiled_vectors(spark, sf_dir):
    """Vectors of all deliveries, the last one of an id winning, per model and layer."""
    v = last_wins(table(spark, sf_dir, "replication_results"), ["vector_id"], ["ingested_at", "extracted_at"])
    return v.groupBy("model", "layer").agg(F.count("*").alias("n_vectors"), F.countDistinct("concept").alias("n_concepts"), F.max("embedding_dim").alias("dim"))


def review_notes(spark, sf_dir):
    """The last opinion on each reviewed document; equal times: the higher opinion, then the later name."""
    d = table(spark, sf_dir, "doc_review").where("doc_id is not null").fillna(-1, ["abusive"])
    return last_wins(d, ["doc_id"], ["reviewed_at", "abusive", "reviewer"]).select("doc_id", "abusive", "reviewer")


def review_progress(spark, sf_dir):
    """Reviewed and open documents per source, and the next document to review."""
    docs = table(spark, sf_dir, "documents").select("doc_id", label_form("source").alias("source"), "created_at")
    done = review_notes(spark, sf_dir).select("doc_id").withColumn("done", F.lit(1))
    j = docs.join(done, "doc_id", "left")
    return j.groupBy("source").agg(F.count("done").alias("n_reviewed"), F.count_if(F.col("done").isNull()).alias("n_open"), F.min_by("doc_id", F.when(F.col("done").isNull(), F.struct("created_at", "doc_id"))).alias("next_doc"))


def viewer_payload(spark, sf_dir):
    """Accepted images of each concept as one ordered text, with the mean score of each source cell."""
    cells = accepted(spark, sf_dir).groupBy("concept", "source").agg(F.count("*").alias("n"), F.avg("clip_score").alias("m"), F.sort_array(F.collect_list("candidate_id")).alias("ids"))
    text = F.concat(F.col("source"), F.lit(":"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    return cells.groupBy("concept").agg(F.array_join(F.sort_array(F.collect_list(text)), ";").alias("images"), F.round(F.avg("m"), 6).alias("mean_score"), F.sum("n").alias("n_images"))


def image_hashes(spark, sf_dir):
    """Average hashes of the 64-value pictures and their distance to picture 0, by value of bits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", average_hash(F.col("embedding")).alias("h"))
    zero = e.where("vec_id = 0").select(F.col("h").alias("h0"))
    return e.join(F.broadcast(zero)).select("vec_id", F.bit_count("h").cast("int").alias("n_bits"), hamming(F.col("h"), F.col("h0")).cast("int").alias("distance"))


def greedy_images(spark, sf_dir):
    """Pictures accepted one by one per label until each source has five, near duplicates left out."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), "label").alias("concept"), "vec_id", average_hash(F.col("embedding")).alias("h"), F.concat(F.lit("s"), F.col("vec_id") % 3).alias("source"))
    return greedy_accept(e, "concept", "vec_id", "h", "source", ["source", "vec_id"], TARGET, 20)


def stratum_priority(spark, sf_dir):
    """Roster concepts by feasibility (best first), stratum and name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in FEASIBLE]), F.col("feasibility")), F.lit(0))
    r = roster(spark, sf_dir).withColumn("_r", rank)
    return r.select("concept", "stratum", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_r"), F.col("stratum").asc_nulls_last(), "concept")).alias("place"))


def candidate_strata(spark, sf_dir):
    """Candidates and mean score of each stratum, through roster and reserve."""
    both = roster(spark, sf_dir).select("concept", "stratum").unionByName(reserve(spark, sf_dir).select("concept", "stratum")).groupBy("concept").agg(F.max("stratum").alias("stratum"))
    # Counts per concept first: a concept with a tenth of all rows is one row in the join.
    c = candidates(spark, sf_dir, F.col("concept").isNotNull()).groupBy("concept").agg(F.count("*").alias("n"), F.sum(F.when(usable_score("clip_score"), F.col("clip_score"))).alias("s"), F.count_if(usable_score("clip_score")).alias("k"))
    return lookup_join(c, both, ["concept"], "left", "concept").groupBy("stratum").agg(F.sum("n").alias("n_candidates"), F.round(F.sum("s") / F.nullif(F.sum("k"), F.lit(0)), 6).alias("mean_score"))


def _label(c: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\p{{Z}}_-]+', '_', 'g'), '')"


def _path(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '\\\\', '/', 'g'), '/+', '/', 'g'), '^(\\./)+', ''), '')"


def _slug(c: str) -> str:
    return f"trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_')"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


_IN = "('gridnet', 'openpix', 'freelens')"
_U = "(clip_score IS NOT NULL AND NOT isnan(clip_score) AND clip_score BETWEEN 0 AND 1)"
_CUR = f"""WITH ro AS (SELECT {_label('concept')} AS concept, max({_label('stratum')}) AS stratum, max({_label('source_feasibility')}) AS feasibility, max(ordinal) AS ordinal, max(target_count) AS target_count FROM roster_core WHERE {_label('concept')} IS NOT NULL GROUP BY 1),
 re AS (SELECT {_label('concept')} AS concept, max({_label('stratum')}) AS stratum, max({_label('source_feasibility')}) AS feasibility FROM reserve_catalog WHERE {_label('concept')} IS NOT NULL GROUP BY 1),
 ca AS (SELECT * FROM (SELECT candidate_id, run_id, {_label('concept')} AS concept, {_label('source')} AS source, source_class_label, source_class_id, proxy_used, acquisition_method, candidate_filename, clip_score, fetched_at, row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at) AS rn FROM candidate) WHERE rn = 1),
 ac AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept, source ORDER BY fetched_at NULLS FIRST, candidate_id) AS slot FROM ca WHERE concept IS NOT NULL AND source IN {_IN} AND {_U} AND clip_score >= 0.25) WHERE slot <= 5),
 so AS (SELECT unnest(['gridnet', 'openpix', 'freelens']) AS source),
 ct AS (SELECT ro.concept, so.source, count(ac.candidate_id) AS n FROM ro CROSS JOIN so LEFT JOIN ac ON ac.concept = ro.concept AND ac.source = so.source GROUP BY ALL),
 rs AS (SELECT re.concept, stratum, feasibility, CASE WHEN g AND o THEN 'bulk_ready' WHEN g THEN 'needs_openpix' WHEN o THEN 'needs_gridnet' ELSE 'needs_swap' END AS status FROM (SELECT re.*, coalesce(g, FALSE) AS g, coalesce(o, FALSE) AS o FROM re LEFT JOIN (SELECT concept, bool_or(source = 'gridnet') AS g, bool_or(source = 'openpix') AS o FROM ca WHERE {_U} AND clip_score >= 0.25 GROUP BY 1) x ON x.concept = re.concept) re),
 sg AS (SELECT e.concept, e.stratum, place, replacement FROM (SELECT ct.concept, any_value(ro.stratum) AS stratum FROM ct JOIN ro USING (concept) GROUP BY 1 HAVING sum(n) = 0) e JOIN (SELECT concept AS replacement, stratum, row_number() OVER (PARTITION BY stratum ORDER BY concept) AS place FROM rs WHERE status = 'bulk_ready') r ON r.stratum = e.stratum AND place <= 5),
 pm AS (SELECT *, coalesce(feasibility = 'medium', FALSE) AS med FROM ro WHERE stratum IS NOT NULL),
 pk AS (SELECT *, sum(CASE WHEN med THEN 1 ELSE 0 END) OVER (PARTITION BY stratum) AS m, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum, med ORDER BY ordinal, concept) AS k FROM pm),
 pl AS (SELECT * FROM (SELECT *, CASE WHEN med THEN 'stress_medium' ELSE 'anchor_high' END AS role, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN med AND k <= CASE WHEN m / n >= 0.4 THEN least(2, m) ELSE least(1, m) END THEN 0 WHEN NOT med THEN 1 ELSE 2 END, k) AS place FROM pk) WHERE place <= 3),
 bu AS (SELECT * FROM (SELECT build_row_id, {_label('concept')} AS concept, built_at, {_label('selection_status')} AS status, storage_slug AS slug, num_images, concept_to_images AS images, row_number() OVER (PARTITION BY build_row_id ORDER BY ingested_at) AS rn FROM data_manifest_250) WHERE rn = 1 AND concept IS NOT NULL),
 rb AS (SELECT candidate_id, concept, source, CASE WHEN proxy_used = 'true' AND NOT contains(' ' || {_norm('concept')} || ' ', ' ' || {_norm('source_class_label')} || ' ') THEN 'rolled_back' ELSE 'accepted' END AS state FROM ac),
 tr AS (SELECT DISTINCT * FROM (SELECT concept AS child, 'w:' || split_part(concept, '_', -1) AS parent FROM ro WHERE stratum IS NOT NULL UNION ALL SELECT 'w:' || split_part(concept, '_', -1), 's:' || stratum FROM ro WHERE stratum IS NOT NULL UNION ALL SELECT 's:' || stratum, 'root' FROM ro WHERE stratum IS NOT NULL)),
 rv AS (SELECT doc_id, abusive, reviewer FROM (SELECT doc_id, coalesce(abusive, -1) AS abusive, reviewer, row_number() OVER (PARTITION BY doc_id ORDER BY reviewed_at DESC NULLS LAST, coalesce(abusive, -1) DESC, reviewer DESC NULLS LAST) AS rn FROM doc_review WHERE doc_id IS NOT NULL) WHERE rn = 1)
"""
_REC = _CUR.replace("WITH ro", "WITH RECURSIVE ro", 1)

SQL = {
    "roster_manifest": _CUR + f" SELECT concept, stratum, {_slug('concept')} AS storage_slug, 0 AS num_images, '{{\"gridnet\":5,\"openpix\":5,\"freelens\":5}}' AS source_mix_target, ordinal FROM ro",
    "roster_checks": f"WITH t AS (SELECT {_label('concept')} AS concept, max({_label('stratum')}) AS stratum, max(target_count) AS target_count, count(*) AS n FROM roster_core WHERE {_label('concept')} IS NOT NULL GROUP BY 1) SELECT stratum, count(*) AS n_concepts, CAST(sum(target_count) AS BIGINT) AS n_images, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated FROM t GROUP BY 1",
    "accepted_images": _CUR + f" SELECT concept, source, CAST(slot AS INTEGER) AS slot, candidate_id, {_slug('concept')} || '_' || source || '_' || lpad(CAST(slot AS VARCHAR), 2, '0') || '.jpg' AS file_name, round_even(clip_score, 4) AS clip_score FROM ac",
    "source_counts": _CUR + " SELECT concept, CAST(sum(n) FILTER (WHERE source = 'gridnet') AS BIGINT) AS gridnet, CAST(sum(n) FILTER (WHERE source = 'openpix') AS BIGINT) AS openpix, CAST(sum(n) FILTER (WHERE source = 'freelens') AS BIGINT) AS freelens, CAST(sum(n) AS BIGINT) AS total FROM ct GROUP BY 1",
    "fill_summary": _CUR + ", t AS (SELECT concept, sum(n) AS n FROM ct GROUP BY 1), a AS (SELECT count(*) AS n_cells, CAST(sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_filled FROM ct), b AS (SELECT CAST(sum(CASE WHEN n = 15 THEN 1 ELSE 0 END) AS BIGINT) AS n_complete, CAST(sum(CASE WHEN n BETWEEN 1 AND 14 THEN 1 ELSE 0 END) AS BIGINT) AS n_partial, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_empty FROM t), w AS (SELECT count(*) AS n_weak_sources FROM (SELECT source FROM ct GROUP BY 1 HAVING avg(CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END) < 0.5)) SELECT *, round(n_filled / greatest(n_cells, 1), 6) AS fill_rate, CASE WHEN n_partial + n_empty > 8 OR n_weak_sources > 0 THEN 'stop' WHEN n_partial + n_empty > 3 OR n_filled / greatest(n_cells, 1) < 0.85 THEN 'adjust' ELSE 'expand' END AS decision FROM a, b, w",
    "fill_by_source": _CUR + " SELECT source, CAST(sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_filled, round(avg(CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END), 6) AS fill_rate, CAST(sum(n) AS BIGINT) AS n_images FROM ct GROUP BY 1",
    "rejections": _CUR + f", x AS (SELECT source, {_U} AS u, coalesce({_U} AND clip_score >= 0.25, FALSE) AS good, row_number() OVER (PARTITION BY concept, source, coalesce({_U} AND clip_score >= 0.25, FALSE) ORDER BY fetched_at NULLS FIRST, candidate_id) AS k FROM ca WHERE concept IS NOT NULL AND source IN {_IN}) SELECT source, CASE WHEN NOT u THEN 'no_score' WHEN NOT good THEN 'below_score' WHEN k > 5 THEN 'over_quota' ELSE 'accepted' END AS reason, count(*) AS n FROM x GROUP BY ALL",
    "worst_concepts": _CUR + " SELECT concept, CAST(sum(n) AS BIGINT) AS n, feasibility FROM ct JOIN ro USING (concept) GROUP BY concept, feasibility HAVING sum(n) < 15 ORDER BY sum(n), CASE WHEN coalesce(feasibility, '') <> 'medium' THEN 1 ELSE 0 END, concept LIMIT 15",
    "work_queue": _CUR + f", o AS (SELECT concept, CAST(sum(CASE WHEN {_U} AND clip_score >= 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_hits, count(DISTINCT source_class_id) AS n_classes, count(DISTINCT source_class_label) AS n_labels FROM ca WHERE concept IS NOT NULL AND source IN {_IN} GROUP BY 1), h AS (SELECT concept, CAST(sum(n) AS BIGINT) AS n_images FROM ct GROUP BY 1)"
    + " SELECT concept, n_images, n_hits, n_classes, n_labels, coalesce(feasibility = 'high', FALSE) AS high FROM ro JOIN h USING (concept) JOIN o USING (concept) WHERE n_images < 15 AND (n_hits > 0 OR n_classes > 0 OR n_labels > 0) ORDER BY n_hits > 0 DESC, n_classes > 0 DESC, n_labels > 0 DESC, coalesce(feasibility = 'high', FALSE) DESC, n_images DESC, n_hits DESC, n_classes DESC, n_labels DESC, concept DESC",
    "work_batch": _CUR + f", o AS (SELECT concept, CAST(sum(CASE WHEN {_U} AND clip_score >= 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_hits, count(DISTINCT source_class_id) AS n_classes, count(DISTINCT source_class_label) AS n_labels FROM ca WHERE concept IS NOT NULL AND source IN {_IN} GROUP BY 1), h AS (SELECT concept, CAST(sum(n) AS BIGINT) AS n_images FROM ct GROUP BY 1)"
    + " SELECT concept, n_images, n_hits, n_classes, n_labels, coalesce(feasibility = 'high', FALSE) AS high FROM ro JOIN h USING (concept) JOIN o USING (concept) WHERE n_images < 15 AND (n_hits > 0 OR n_classes > 0 OR n_labels > 0) ORDER BY n_hits > 0 DESC, n_classes > 0 DESC, n_labels > 0 DESC, coalesce(feasibility = 'high', FALSE) DESC, n_images DESC, n_hits DESC, n_classes DESC, n_labels DESC, concept DESC LIMIT 40",
    "tracker_slots": _CUR + ", sl AS (SELECT concept, source, CAST(slot AS INTEGER) AS slot FROM ro, so, (SELECT unnest(range(1, 6)) AS slot)) SELECT sl.concept, sl.source, sl.slot, coalesce(candidate_id, -1) AS candidate_id FROM sl LEFT JOIN ac ON ac.concept = sl.concept AND ac.source = sl.source AND ac.slot = sl.slot",
    "reserve_status": _CUR + " SELECT * FROM rs",
    "reserve_histogram": _CUR + " SELECT status, count(*) AS n FROM rs GROUP BY 1",
    "suggestions": _CUR + " SELECT concept, stratum, CAST(place AS INTEGER) AS place, replacement FROM sg",
    "pilot": _CUR + " SELECT stratum, CAST(place AS INTEGER) AS place, concept, feasibility, role FROM pl",
    "pilot_strata": _CUR + " SELECT stratum, string_agg(concept, ', ' ORDER BY place) AS concepts, CAST(sum(CASE WHEN role = 'anchor_high' THEN 1 ELSE 0 END) AS BIGINT) AS n_high, CAST(sum(CASE WHEN role = 'stress_medium' THEN 1 ELSE 0 END) AS BIGINT) AS n_medium FROM pl GROUP BY 1",
    "complete_subset": _CUR + " SELECT ro.concept, stratum, ordinal FROM ro JOIN (SELECT concept FROM (SELECT concept, source, count(*) AS n FROM ac GROUP BY ALL) GROUP BY 1 HAVING count(*) = 3 AND min(n) = 5 AND max(n) = 5) f ON f.concept = ro.concept",
    "merged_manifest": _CUR + ", f AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY built_at, build_row_id) AS k FROM bu), z AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY built_at DESC, build_row_id DESC) AS k FROM bu WHERE status = 'frozen') SELECT f.concept, coalesce(z.status, f.status) AS status, coalesce(z.slug, f.slug) AS slug, coalesce(z.num_images, f.num_images) AS num_images FROM f LEFT JOIN z ON z.concept = f.concept AND z.k = 1 WHERE f.k = 1",
    "swapped_roster": _CUR + ", w AS (SELECT *, dense_rank() OVER (PARTITION BY stratum ORDER BY concept) AS n FROM sg) SELECT ordinal, ro.stratum, coalesce(replacement, ro.concept) AS concept, replacement IS NOT NULL AS replaced FROM ro LEFT JOIN w ON w.concept = ro.concept AND n = place",
    "swap_checks": _CUR + " SELECT re.concept, CASE WHEN re.stratum = ro.stratum THEN 'in_roster' ELSE 'in_roster_of_other_stratum' END AS problem FROM re JOIN ro USING (concept)",
    "seeded_images": _CUR + f", s AS (SELECT * FROM (SELECT seed_id, {_label('target_concept')} AS concept, {_path('source_filename')} AS file, selected_at, row_number() OVER (PARTITION BY seed_id ORDER BY ingested_at) AS rn FROM scale250_seed_provenance) WHERE rn = 1 AND concept IS NOT NULL AND file IS NOT NULL), k AS (SELECT s.*, row_number() OVER (PARTITION BY s.concept ORDER BY selected_at NULLS FIRST, seed_id) AS slot FROM s WHERE concept IN (SELECT concept FROM ro)) SELECT concept, CAST(slot AS INTEGER) AS slot, seed_id, {_slug('concept')} || '_' || lpad(CAST(slot AS VARCHAR), 3, '0') || '.jpg' AS file_name FROM k WHERE slot <= 3",
    "rollback": _CUR + " SELECT * FROM rb",
    "rollback_counts": _CUR + " SELECT concept, CAST(sum(CASE WHEN state = 'accepted' THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN state = 'rolled_back' THEN 1 ELSE 0 END) AS BIGINT) AS n_back FROM rb GROUP BY 1",
    "label_matches": _CUR + f", lb AS (SELECT {_norm('source_class_label')} AS label, min(source_class_id) AS class_id FROM candidate WHERE {_norm('source_class_label')} <> '' AND source_class_id IS NOT NULL GROUP BY 1), n AS (SELECT concept, {_norm('concept')} AS name FROM ro) SELECT n.concept, coalesce(a.label, b.label) AS label, coalesce(a.class_id, b.class_id) AS class_id, CASE WHEN a.label IS NOT NULL THEN 'exact' WHEN b.label IS NOT NULL THEN 'proxy' ELSE 'none' END AS how FROM n LEFT JOIN lb a ON a.label = name LEFT JOIN lb b ON b.label = split_part(name, ' ', -1)",
    "label_hits": _CUR + ", h AS (SELECT source_class_id, acquisition_method, candidate_id, row_number() OVER (PARTITION BY source_class_id, acquisition_method ORDER BY candidate_id) AS k FROM ca WHERE source_class_id IS NOT NULL AND acquisition_method IS NOT NULL), g AS (SELECT * FROM h WHERE k <= 4), p AS (SELECT source_class_id, acquisition_method, coalesce(sum(count(*)) OVER (PARTITION BY source_class_id ORDER BY acquisition_method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g GROUP BY 1, 2) SELECT g.source_class_id, g.acquisition_method, candidate_id FROM g JOIN p USING (source_class_id, acquisition_method) WHERE b < 4",
    "label_closure": _REC + ", up(child, ancestor, level) AS (SELECT child, parent, 1 FROM tr UNION ALL SELECT up.child, tr.parent, level + 1 FROM up JOIN tr ON tr.child = up.ancestor WHERE level < 60) SELECT child, ancestor, CAST(min(level) AS INTEGER) AS level FROM up GROUP BY 1, 2",
    "label_descendants": _REC + ", dn(root, node, level) AS (SELECT child, child, 0 FROM tr WHERE parent = 'root' UNION ALL SELECT dn.root, tr.child, level + 1 FROM dn JOIN tr ON tr.parent = dn.node WHERE level < 2), d AS (SELECT root, node, min(level) AS level FROM dn GROUP BY 1, 2) SELECT root, node, CAST(level AS INTEGER) AS level FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY level, node) AS k FROM d) WHERE k <= 12",
    "concept_order": _CUR + ", b AS (SELECT concept, 0 AS part, min(build_row_id) AS o FROM bu WHERE len(images) > 0 GROUP BY 1 UNION ALL SELECT concept, 1, ordinal FROM ro), m AS (SELECT concept, min((part, o)) AS a FROM b GROUP BY 1) SELECT concept, CAST(row_number() OVER (ORDER BY a, concept) AS INTEGER) AS place FROM m",
    "sync_manifest": _CUR + f", l AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY built_at DESC, build_row_id DESC) AS k FROM bu), q AS (SELECT DISTINCT concept, built_at, num_images, {_path('p')} AS relpath FROM (SELECT concept, built_at, num_images, unnest(images) AS p FROM l WHERE k = 1) WHERE {_path('p')} IS NOT NULL), f AS (SELECT DISTINCT {_path('relpath')} AS relpath, created_at, deleted_at FROM image_file),"
    + " t AS (SELECT q.*, EXISTS (SELECT 1 FROM f WHERE f.relpath = q.relpath AND created_at <= built_at AND (deleted_at IS NULL OR deleted_at > built_at)) AS there, nullif(regexp_extract(regexp_replace(split_part(relpath, '/', -1), '[.][^.]*$', ''), '^.+_(retro_slides|herbarium_x|museo_scans|aerial_set|sketchpool|photobarn|stockyard|wikishots|fieldcam|freelens|gridnet|openpix)_[0-9]+$', 1), '') AS source FROM q)"
    + " SELECT concept, count(*) AS n_listed, CAST(sum(CASE WHEN there THEN 1 ELSE 0 END) AS BIGINT) AS n_found, count(source) AS n_with_source, count(DISTINCT source) AS n_sources, max(num_images) <> count(*) AS count_is_off FROM t GROUP BY 1",
    "next_file_number": f"WITH f AS (SELECT file_id, max({_label('concept')}) AS concept, max({_label('source')}) AS source, max(filename) AS filename FROM image_file GROUP BY 1) SELECT concept, source, CAST(coalesce(max(TRY_CAST(nullif(regexp_extract(filename, '_([0-9]{{1,18}})[.][^.]*$', 1), '') AS BIGINT)) + 1, count(*)) AS BIGINT) AS next_number FROM f GROUP BY ALL",
    "model_coverage": _CUR + f", v AS (SELECT DISTINCT model, {_label('concept')} AS concept FROM replication_results WHERE model IS NOT NULL AND {_label('concept')} IS NOT NULL) SELECT model, CAST(sum(CASE WHEN ro.concept IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_extra, CAST((SELECT count(*) FROM ro) - count(ro.concept) AS BIGINT) AS n_missing FROM v LEFT JOIN ro ON ro.concept = v.concept GROUP BY 1",
    "compiled_vectors": "WITH v AS (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY ingested_at DESC NULLS LAST, extracted_at DESC NULLS LAST) AS k FROM replication_results) SELECT model, layer, count(*) AS n_vectors, count(DISTINCT concept) AS n_concepts, max(embedding_dim) AS dim FROM v WHERE k = 1 GROUP BY ALL",
    "review_notes": _CUR + " SELECT * FROM rv",
    "review_progress": _CUR + f", d AS (SELECT doc_id, {_label('source')} AS source, created_at FROM documents) SELECT d.source, count(rv.doc_id) AS n_reviewed, CAST(sum(CASE WHEN rv.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_open, arg_min(d.doc_id, (created_at, d.doc_id)) FILTER (WHERE rv.doc_id IS NULL) AS next_doc FROM d LEFT JOIN rv ON rv.doc_id = d.doc_id GROUP BY 1",
    "viewer_payload": _CUR + ", c AS (SELECT concept, source, count(*) AS n, avg(clip_score) AS m, source || ':' || string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY candidate_id) AS t FROM ac GROUP BY 1, 2) SELECT concept, string_agg(t, ';' ORDER BY t) AS images, round(avg(m), 6) AS mean_score, CAST(sum(n) AS BIGINT) AS n_images FROM c GROUP BY 1",
    "image_hashes": "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), m AS (SELECT vec_id, i, v > avg(v) OVER (PARTITION BY vec_id) AS b FROM x) SELECT a.vec_id, CAST(sum(CASE WHEN a.b THEN 1 ELSE 0 END) AS INTEGER) AS n_bits, CAST(sum(CASE WHEN a.b <> z.b THEN 1 ELSE 0 END) AS INTEGER) AS distance FROM m a JOIN m z ON z.i = a.i AND z.vec_id = 0 GROUP BY 1",
    "stratum_priority": _CUR + " SELECT concept, stratum, CAST(row_number() OVER (ORDER BY coalesce(list_position(['low', 'disputed', 'medium', 'high'], feasibility), 0) DESC, stratum NULLS LAST, concept) AS INTEGER) AS place FROM ro",
    "candidate_strata": _CUR + f", b AS (SELECT concept, max(stratum) AS stratum FROM (SELECT concept, stratum FROM ro UNION ALL SELECT concept, stratum FROM re) GROUP BY 1) SELECT stratum, count(*) AS n_candidates, round(avg(CASE WHEN {_U} THEN clip_score END), 6) AS mean_score FROM ca LEFT JOIN b USING (concept) WHERE ca.concept IS NOT NULL GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in [*SQL, "greedy_images"]}
