"""Document chains: order, supersedence, targets and current parties (W1-W6, GR4-GR8, J18-J20, D1, D2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import UNDATED
from ..sources.checkpoints import cut


def with_family(docs: DataFrame, group: str = "grp", doc: str = "doc_id") -> DataFrame:
    """GR5: family of a document; one without a group is a family of its own."""
    return docs.withColumn("family", F.coalesce(F.col(group).cast("string"), F.concat(F.lit("solo:"), F.col(doc).cast("string"))))


def supersede(rows: DataFrame, family: list[str], field: list[str], order: list[str], doc: str, single: str | None = None) -> DataFrame:
    """Rows (one statement each) with is_current and superseded_by.

    Of a single-valued field that several documents of a family state, the last in order is current and supersedes the others;
    rows of multi-valued fields (single is false) are all current. One shuffle on (family, field) and one sort.
    """
    w = W.partitionBy(*family, *field).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.last(doc).over(w)
    walk = F.col(single) if single else F.lit(True)
    now = ~walk | (F.col(doc) == last)
    return rows.withColumn("is_current", now).withColumn("superseded_by", F.when(~now, last))


def currency(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """W1 with its rules: only dated documents and statements of a value walk; fields that don't supersede stay current.

    fields: doc_id, full_key, states (boolean), single, supersedes (booleans); docs: doc_id, family, best_date, ordinal. A row that
    states nothing and wasn't judged is not current; rows of undated documents aren't current where the family has a dated one.
    """
    f = fields.join(docs.select("doc_id", "family", "best_date", "ordinal"), "doc_id")
    dated = F.max((F.col("best_date") != UNDATED).cast("int")).over(W.partitionBy("family")) == 1
    f = f.withColumn("walks", F.col("states") & F.col("supersedes") & (F.col("best_date") != UNDATED)).withColumn("any_dated", dated)
    w = W.partitionBy("family", "full_key", "walks").orderBy("best_date", "ordinal", "doc_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.last("doc_id").over(w)
    beaten = F.col("walks") & F.col("single") & (F.col("doc_id") != last)
    undated = F.col("supersedes") & (F.col("best_date") == UNDATED) & F.col("any_dated")
    return f.withColumn("is_current", ~(beaten | undated | ~F.col("states"))).withColumn("superseded_by", F.when(beaten, last)).drop("walks", "any_dated")


def changed_currency(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (doc_id, full_key) whose currency differs between two states."""
    b = before.select("doc_id", "full_key", F.col("is_current").alias("was"), F.col("superseded_by").alias("was_by"))
    return after.join(b, ["doc_id", "full_key"]).where(~F.col("is_current").eqNullSafe(F.col("was")) | ~F.col("superseded_by").eqNullSafe(F.col("was_by")))


def current_parties(parties: DataFrame) -> DataFrame:
    """Family, role, key of the newest dated chain document that names a real party. parties: family, role, key, best_date, ordinal, doc_id, in_chain."""
    real = parties.where(F.col("in_chain") & (F.col("best_date") != UNDATED) & (F.coalesce("key", F.lit("")) != ""))
    return real.groupBy("family", "role").agg(F.max_by("key", F.struct("best_date", "ordinal", "doc_id")).alias("key"))


def stamp_parties(edges: DataFrame, now: DataFrame) -> DataFrame:
    """GR8: party edges (family, role, key) with current; roles without a current party keep null."""
    n = now.withColumnRenamed("key", "now_key")
    return edges.join(n, ["family", "role"], "left").withColumn("current", F.when(F.col("now_key").isNotNull(), F.col("key") == F.col("now_key"))).drop("now_key")


def dag_targets(docs: DataFrame) -> DataFrame:
    """doc_id, dated, recital, target of every document with an edge.

    docs: family, doc_id, edge, document_date, amends_dated, best_date, parent (declared), base (boolean). A declared parent in
    the family wins; else the document of the recital's date; else the only base that isn't dated later. Equi-joins on the family.
    """
    a = docs.where("edge is not null").select("family", "doc_id", "amends_dated", "best_date", "parent")
    o = docs.select("family", F.col("doc_id").alias("other"), F.col("document_date").alias("other_date"), F.coalesce("best_date", F.lit(UNDATED)).alias("other_best"), F.col("base").alias("other_base"))
    by_date = a.join(o, (a["family"] == o["family"]) & (a["amends_dated"] == o["other_date"]) & (a["doc_id"] != o["other"])).groupBy("doc_id").agg(F.min("other").alias("dated"))
    bases = a.join(o.where("other_base"), (a["family"] == o["family"]) & (a["doc_id"] != o["other"])).groupBy("doc_id", a["best_date"]).agg(
        F.count("*").alias("n"), F.min("other").alias("any"),
        F.count_if((F.col("other_best") == UNDATED) | (F.col("other_best") <= F.col("best_date"))).alias("n_before"),
        F.min(F.when((F.col("other_best") == UNDATED) | (F.col("other_best") <= F.col("best_date")), F.col("other"))).alias("before"),
    )
    one = F.when(F.col("n") == 1, F.col("any")).when((F.coalesce("best_date", F.lit(UNDATED)) != UNDATED) & (F.col("n_before") == 1), F.col("before"))
    single = bases.select("doc_id", one.alias("base"))
    named = a.join(o.select("family", "other"), (a["family"] == o["family"]) & (a["parent"] == o["other"]) & (a["doc_id"] != o["other"])).select("doc_id", F.col("other").alias("declared")).distinct()
    out = a.select("doc_id", "parent").join(by_date, "doc_id", "left").join(single, "doc_id", "left").join(named, "doc_id", "left")
    recital = F.coalesce("dated", "base")
    return out.select("doc_id", "parent", "dated", recital.alias("recital"), F.coalesce("declared", recital).alias("target"))


def cycles(edges: DataFrame) -> DataFrame:
    """GR4: nodes on a loop of edges (src, tgt; at most one per src), by pointer doubling.

    After k rounds a node points 2**k steps ahead; nodes whose way ends sooner drop out. Once a round changes neither the number of
    nodes nor that of the nodes pointed at, every way leads into a loop and only loops are pointed at.
    """
    step = cut(edges.select(F.col("src").alias("n"), F.col("tgt").alias("to")))
    size = lambda s: tuple(s.agg(F.count("*"), F.count_distinct("to")).first())
    before = None
    while (now := size(step)) != before:
        before = now
        step = cut(step.join(step.select(F.col("n").alias("m"), F.col("to").alias("far")), F.col("to") == F.col("m")).select("n", F.col("far").alias("to")))
    return step.select(F.col("to").alias("src")).distinct()


def backfilled_dates(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """GR4: docs whose undated edge targets take the earliest date that their amendments declare for them. edges: src, tgt."""
    said = edges.join(docs.select(F.col("doc_id").alias("src"), "amends_dated"), "src").groupBy(F.col("tgt").alias("doc_id")).agg(F.min("amends_dated").alias("said"))
    return docs.join(said, "doc_id", "left").withColumn("best_date", F.when(F.col("best_date") == UNDATED, F.coalesce("said", "best_date")).otherwise(F.col("best_date"))).drop("said")


def dag_conflicts(docs: DataFrame, targets: DataFrame, looped: DataFrame) -> DataFrame:
    """GR4: doc_id, reason: a declared parent that is the document itself or missing, disagrees with the recital's date, or closes a loop."""
    own = docs.where("edge is not null and parent = doc_id").select("doc_id", F.lit("self").alias("reason"))
    here = docs.select("family", F.col("doc_id").alias("parent")).distinct()
    missing = docs.where("edge is not null and parent is not null and parent <> doc_id").join(here, ["family", "parent"], "left_anti").select("doc_id", F.lit("missing").alias("reason"))
    other = targets.where("target = parent and dated is not null and dated <> parent").select("doc_id", F.lit("recital").alias("reason"))
    return own.unionByName(missing).unionByName(other).unionByName(looped.select(F.col("src").alias("doc_id"), F.lit("cycle").alias("reason")))


def party_hubs(parties: DataFrame) -> DataFrame:
    """GR6, W19: one hub per canonical key, with its first name in order. parties: key, name, ord."""
    return parties.where("key <> ''").groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("n"))


def party_edges(parties: DataFrame) -> DataFrame:
    """GR7: RESOLVES_TO (field row to hub) and HAS_PARTY (document to hub) edges. parties: ops_id, doc_id, role, key."""
    real = parties.where("key <> ''").withColumn("hub", F.concat(F.lit("CanonicalParty:"), F.col("key")))
    a = real.select(F.lit("RESOLVES_TO").alias("rel"), F.col("ops_id").cast("string").alias("src"), F.col("hub").alias("tgt"), "role")
    b = real.select(F.lit("HAS_PARTY").alias("rel"), F.col("doc_id").cast("string").alias("src"), F.col("hub").alias("tgt"), "role")
    return a.unionByName(b).withColumn("id", F.concat_ws(":", F.lit("e"), "rel", "src", "tgt")).dropDuplicates(["id", "role"])
