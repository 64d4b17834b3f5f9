"""Named queries of the core library over the driver's tables, with DuckDB twins.

The tables are not genomes; each query binds an operator's roles to columns that have the same
shape (a part's name for a sequence, a document's source for a genome, and so on). Doubles are
rounded after aggregation, since sums of doubles depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, sequences
from .operators import align, annotate, boosting, cluster, coverage, evaluate, hierarchy, merge, model, presence, select, sequence, split
from .plans.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _parts(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_brand").alias("family"), F.col("p_name").alias("sequence"))


def _words(spark, d) -> DataFrame:
    """(genome, cluster, doc_id): words of the documents of each source."""
    return _words_with(spark, d)


def _words_with(spark, d, *more: Column) -> DataFrame:
    """The same with further columns of the documents."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("genome"), *more, F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("cluster"))
    return docs.filter("cluster <> ''")


_WORDS_SQL = "words AS (SELECT DISTINCT doc_id, source AS genome, w AS cluster FROM (SELECT doc_id, source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '')"


# --- sequences and k-mers -------------------------------------------------------------------

_KMERS_SQL = "occ AS (SELECT p_partkey AS protein_id, p_brand AS family, substr(s, i, 3) AS kmer FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM (SELECT *, replace(p_name, '*', '') AS s FROM part)))"


@query(f"WITH {_KMERS_SQL} SELECT kmer, count(DISTINCT protein_id) AS proteins FROM occ GROUP BY kmer HAVING count(DISTINCT protein_id) > 1")
def kmer_support(spark, d):
    return sequence.kmer_support(sequence.explode_kmers(_parts(spark, d), 3, ["protein_id"]), [])


@query(f"WITH {_KMERS_SQL} SELECT family, kmer, count(DISTINCT protein_id) AS proteins FROM occ GROUP BY family, kmer")
def kmer_family_support(spark, d):
    return sequence.kmer_support(sequence.explode_kmers(_parts(spark, d), 3, ["protein_id", "family"]), ["family"], one_gene=True)


@query("SELECT k, kmer, count(*) AS n FROM (SELECT k, substr(p_name, i, k) AS kmer FROM (SELECT p_name, k, unnest(range(1, length(p_name) - k + 2)) AS i FROM part, (SELECT unnest([3, 4, 5]) AS k) WHERE length(p_name) >= k)) GROUP BY k, kmer")
def kmer_range(spark, d):
    return sequence.explode_kmer_range(_parts(spark, d), 3, 5, []).groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT p_partkey, p_brand AS genome, p_name, p_type AS feature FROM part),
km AS (SELECT DISTINCT p_type AS feature, p_size % 5 AS cluster, substr(p_name, i, 3) AS kmer FROM (SELECT *, unnest(range(1, length(p_name) - 1)) AS i FROM part)),
hit AS (SELECT genome, km.feature, cluster, kmer, max(CASE WHEN contains(p_name, kmer) THEN 1 ELSE 0 END) AS h FROM g JOIN km ON g.feature = km.feature GROUP BY ALL),
calls AS (SELECT genome, feature, CASE WHEN sum(h) / count(*) >= 0.5 THEN 1 ELSE 0 END AS present FROM hit GROUP BY ALL)
SELECT genome, feature, CAST(coalesce(present, 0) AS INTEGER) AS present FROM (SELECT DISTINCT genome, p_type AS feature FROM (SELECT genome FROM g), part) LEFT JOIN calls USING (genome, feature)
""")
def kmer_containment_call(spark, d):
    part = _t(spark, d, "part")
    kmers = sequence.explode_kmers(part.select(F.col("p_type").alias("feature"), (F.col("p_size") % 5).alias("cluster"), F.col("p_name").alias("sequence")), 3, ["feature", "cluster"]).distinct()
    names = part.select(F.col("p_brand").alias("genome"), F.col("p_name").alias("sequence"), F.col("p_type").alias("feature")).distinct()
    hits = sequence.contained(names.join(kmers, "feature"))
    return sequence.call_features(hits, part.select(F.col("p_type").alias("feature")), 0.5)


@query("SELECT user_id || '_' || event_type AS id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return sequence.duplicate_ids(_t(spark, d, "events").select(F.concat_ws("_", "user_id", "event_type").alias("id")), "id")


@query("SELECT event_type, CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id HAVING count(*) > 1)) > 0 THEN event_type || '::' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_id, count(*) AS n FROM events GROUP BY 1, 2")
def id_rewrite(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type")
    return sequence.rewrite_ids(events, "user_id", "event_type").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT regexp_replace(c_name, '#?[^#]*$', '') AS genome, c_mktsegment || '_' || c_name AS label, c_name AS kmer, c_mktsegment AS family, regexp_replace(split_part(c_name || '_7 # x', ' # ', 1), '_[^_]*$', '') AS protein_genome, split_part(c_name || '.x.y', '.', 1) AS stem, CAST(regexp_extract('t_cutoff_' || c_custkey, 'cutoff_(\\d+)', 1) AS INTEGER) AS cut_off FROM customer")
def id_parsing(spark, d):
    c = _t(spark, d, "customer").withColumn("label", F.concat_ws("_", "c_mktsegment", "c_name"))
    return c.select(
        F.regexp_replace("c_name", "#?[^#]*$", "").alias("genome"), "label", sequences.kmer_of_label(F.col("label")).alias("kmer"), sequences.family_of_label(F.col("label")).alias("family"),
        sequences.genome_of_protein(F.concat("c_name", F.lit("_7 # x"))).alias("protein_genome"), sequences.without_suffix(F.concat("c_name", F.lit(".x.y"))).alias("stem"), sequences.cutoff_of_name(F.concat(F.lit("t_cutoff_"), F.col("c_custkey").cast("string"))).alias("cut_off"),
    )


@query("SELECT p_partkey AS protein_id, CAST(i - 1 + r AS INTEGER) AS start, CAST(i + 1 + r AS INTEGER) AS stop FROM (SELECT *, length(substr(p_name, 1, i - 1)) - length(replace(substr(p_name, 1, i - 1), 'r', '')) AS r FROM (SELECT *, unnest(range(1, length(p_name))) AS i FROM part)) WHERE substr(p_name, i, 2) = 're'")
def kmer_positions(spark, d):
    """Places in names in which a gap follows every r, so that each occurrence spans one."""
    gapped = F.replace(F.col("sequence"), F.lit("r"), F.lit("r-"))
    ranges = sequences.gap_tolerant_ranges(gapped, F.lit("re"), gap_aware=True)
    return _parts(spark, d).select("protein_id", F.explode(ranges).alias("r")).select("protein_id", F.col("r.start").alias("start"), F.col("r.stop").alias("stop"))


@query(f"WITH {_KMERS_SQL}, sup AS (SELECT family, kmer FROM occ GROUP BY family, kmer HAVING count(DISTINCT protein_id) > 1) SELECT DISTINCT protein_id % 10 AS genome, family || '_' || kmer AS feature FROM occ JOIN sup USING (family, kmer)")
def kmer_feature_rows(spark, d):
    occurrences = sequence.explode_kmers(_parts(spark, d).withColumn("genome", F.col("protein_id") % 10), 3, ["genome", "protein_id", "family"])
    return sequence.kmer_features(occurrences, sequence.kmer_support(occurrences, ["family"]), ["family"], "genome")


# --- hits, presence, collapse, merge --------------------------------------------------------

_BEST_SQL = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1"


@query(f"SELECT l_partkey, l_orderkey, l_linenumber, b.l_suppkey, s_name AS cluster FROM ({_BEST_SQL}) b LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON b.l_suppkey = s_suppkey")
def best_hit(spark, d):
    lines = _t(spark, d, "lineitem")
    order = [-F.col("l_extendedprice"), F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    best = presence.best_of(lines, "l_partkey", order, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return presence.assign_clusters(best, _t(spark, d, "supplier").filter("s_acctbal > 0").withColumnRenamed("s_name", "cluster"), "l_suppkey", "s_suppkey", "cluster")


@query("SELECT c_custkey, c_name, o_orderkey FROM (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) USING (c_custkey)")
def cluster_compare(spark, d):
    c = _t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return presence.compare_clusters(c, o, "c_custkey")


_PRESENT_SQL = "present AS (SELECT DISTINCT s_nationkey AS genome, p_brand AS cluster FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"
_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


def _present(spark, d) -> DataFrame:
    lines = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = lines.join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return presence.presence(rows, "s_nationkey", "p_brand")


@query(f"WITH {_PRESENT_SQL} SELECT genome, cluster FROM present")
def presence_long(spark, d):
    return _present(spark, d)


@query(f"WITH {_PRESENT_SQL} SELECT n_nationkey AS genome, " + ", ".join(f"CAST(count(*) FILTER (WHERE cluster = '{b}') AS INTEGER) AS \"{b}\"" for b in _BRANDS) + " FROM nation LEFT JOIN present ON genome = n_nationkey GROUP BY n_nationkey")
def presence_wide(spark, d):
    return presence.wide(_present(spark, d), "genome", "cluster", _BRANDS, _t(spark, d, "nation").select(F.col("n_nationkey").alias("genome")))


_COLLAPSE_SQL = f"{_WORDS_SQL}, sets AS (SELECT cluster, array_to_string(list_sort(list(DISTINCT genome)), ',') AS genomes FROM words GROUP BY cluster), firsts AS (SELECT genomes, 'sc_' || (row_number() OVER (ORDER BY min(cluster)) - 1) AS feature FROM sets GROUP BY genomes)"


@query(f"WITH {_COLLAPSE_SQL} SELECT cluster, feature FROM sets JOIN firsts USING (genomes)")
def feature_collapse(spark, d):
    return presence.collapse(_words(spark, d).select("genome", "cluster").distinct())


@query(f"WITH {_COLLAPSE_SQL} SELECT DISTINCT genome, feature FROM words JOIN sets USING (cluster) JOIN firsts USING (genomes)")
def feature_assignment(spark, d):
    present = materialize(_words(spark, d).select("genome", "cluster").distinct(), "present")
    return presence.assign_features(present, presence.collapse(present))


@query(f"WITH {_WORDS_SQL} SELECT DISTINCT genome, cluster FROM words JOIN (SELECT cluster FROM words GROUP BY cluster HAVING count(DISTINCT genome) >= 2) USING (cluster)")
def shared_clusters(spark, d):
    return presence.shared_clusters(_words(spark, d).select("genome", "cluster").distinct())


@query("SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE value)")
def melt_assignments(spark, d):
    return _t(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query("""
WITH hits AS (SELECT l_partkey AS protein_id, 'S' || l_suppkey AS cluster FROM lineitem),
features AS (SELECT 'S' || s_suppkey AS cluster, 'sc_' || s_nationkey AS feature FROM supplier)
SELECT DISTINCT p_brand AS genome, feature FROM hits JOIN features USING (cluster) JOIN part ON protein_id = p_partkey
""")
def feature_transfer(spark, d):
    hits = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("protein_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("cluster")).distinct()
    features = _t(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("cluster"), F.concat(F.lit("sc_"), F.col("s_nationkey").cast("string")).alias("feature"))
    return presence.transfer_features(hits, _t(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_brand").alias("genome")), features)


@query("""
SELECT strain, phage, phenotype, n_cust, s_bal FROM (SELECT o_orderkey AS strain_key, c_nationkey AS strain, l_suppkey AS phage, l_quantity AS phenotype FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
JOIN (SELECT c_nationkey AS strain, count(*) AS n_cust FROM customer WHERE c_acctbal > 0 GROUP BY 1) USING (strain) JOIN (SELECT s_suppkey AS phage, s_acctbal AS s_bal FROM supplier WHERE s_acctbal > 0) USING (phage)
""")
def merge_tables(spark, d):
    c = _t(spark, d, "customer")
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    phenotypes = rows.select(F.col("c_nationkey").alias("strain"), F.col("l_suppkey").alias("phage"), F.col("l_quantity").alias("phenotype"))
    strains = c.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("strain")).agg(F.count(F.lit(1)).alias("n_cust"))
    phages = _t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("phage"), F.col("s_acctbal").alias("s_bal"))
    return merge.merge_features(phenotypes, strains, phages)


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region, nation")
def prediction_cross(spark, d):
    return merge.prediction_grid(_t(spark, d, "nation").select("n_nationkey", "n_name"), _t(spark, d, "region"))


@query("SELECT o_custkey AS c_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def listed_and_present(spark, d):
    return merge.listed_and_present(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), _t(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def missing_genomes(spark, d):
    return merge.absent(_t(spark, d, "part"), _t(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT event_type AS feature, count(DISTINCT user_id) AS occurrence FROM events GROUP BY 1")
def occurrence_counts(spark, d):
    return merge.occurrences(_t(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("feature")))


@query("""
WITH occ AS (SELECT l_partkey AS feature, count(DISTINCT l_suppkey) AS occurrence FROM lineitem GROUP BY 1), passed AS (SELECT cut_off, feature FROM occ, (SELECT unnest([10, 20, 30, 40, 50]) AS cut_off) WHERE occurrence >= cut_off)
SELECT cut_off, feature FROM passed WHERE cut_off IN (SELECT cut_off FROM passed GROUP BY cut_off HAVING count(*) > 20 AND count(*) < (SELECT count(*) // 20 FROM lineitem))
""")
def occurrence_cutoffs(spark, d):
    lines = _t(spark, d, "lineitem")
    occ = merge.occurrences(lines.select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("feature")))
    return merge.cutoff_tables(occ, [10, 20, 30, 40, 50], lines.count())


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL")
def null_drop(spark, d):
    o = _t(spark, d, "orders").filter("o_totalprice > 100000")
    joined = _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")
    return merge.drop_null_rows(joined)


# --- splits and weights ---------------------------------------------------------------------


@query(f"WITH {_WORDS_SQL} SELECT cluster AS feature FROM words WHERE doc_id % 5 <> 0 INTERSECT SELECT cluster FROM words WHERE doc_id % 5 = 0")
def common_features(spark, d):
    words = _words(spark, d).withColumnRenamed("cluster", "feature")
    return split.common_features(words.filter("doc_id % 5 <> 0"), words.filter("doc_id % 5 = 0"))


@query(f"WITH {_WORDS_SQL} SELECT cluster AS feature, count(DISTINCT genome) AS groups FROM words GROUP BY 1 HAVING count(DISTINCT genome) >= 2")
def group_presence_filter(spark, d):
    return split.group_presence(_words(spark, d).select(F.col("genome").alias("group"), F.col("cluster").alias("feature")), 2)


@query("""
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT o_custkey, size, CASE WHEN before < (SELECT floor(sum(size) * 0.8) FROM s) THEN 'train' ELSE 'test' END AS fold FROM b
""")
def group_split(spark, d):
    return split.cumulative_split(_t(spark, d, "orders"), "o_custkey", F.md5(F.col("o_custkey").cast("string").cast("binary")))


@query("SELECT o_custkey, count(*) AS size, coalesce(bool_or(o_totalprice > 200000), false) AS has_positive FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def group_sizes(spark, d):
    return split.group_sizes(_t(spark, d, "orders"), "o_custkey", F.col("o_totalprice") > 200000)


def _labelled(spark, d) -> DataFrame:
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")


_WEIGHTS = {
    "log10": "greatest(1.0, coalesce(CASE WHEN total > p THEN log10((total - p) / (p + 1.0)) + 1 END, 1.0))",
    "inverse_frequency": "total / (p + 1.0)",
    "balanced": "(total - p) / (p + 1.0)",
}


def _weights_sql(method: str) -> str:
    return f"SELECT source, CAST(p AS BIGINT) AS positives, CAST(total - p AS BIGINT) AS negatives, round(CASE WHEN p = 0 THEN 1.0 ELSE {_WEIGHTS[method]} END, 6) AS weight FROM (SELECT source, sum(toxic) AS p, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY source)"


def _weights_query(method: str):
    def run(spark, d):
        return split.class_weights(_labelled(spark, d), "source", "toxic", method).withColumn("weight", _r("weight"))

    run.__name__ = f"phage_weights_{method}"
    return query(_weights_sql(method))(run)


for _method in _WEIGHTS:
    _weights_query(_method)


@query(f"SELECT doc_id, CASE WHEN toxic > 0 THEN weight ELSE 1.0 END AS weight FROM documents JOIN labels USING (doc_id) JOIN ({_weights_sql('balanced')}) USING (source)")
def row_weights(spark, d):
    rows = _labelled(spark, d)
    weights = split.class_weights(rows, "source", "toxic", "balanced").withColumn("weight", _r("weight"))
    return split.row_weights(rows.select("doc_id", "source", "toxic"), weights, "source", "toxic").select("doc_id", "weight")


# --- feature scores -------------------------------------------------------------------------

_SCORED_SQL = f"{_WORDS_SQL}, lab AS (SELECT doc_id, quality AS label FROM labels), cls AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), one AS (SELECT cluster AS feature, label, count(*) AS s FROM words JOIN lab USING (doc_id) GROUP BY ALL), grid AS (SELECT feature, label, n, coalesce(s, 0) AS s FROM (SELECT * FROM (SELECT DISTINCT feature FROM one), cls) LEFT JOIN one USING (feature, label))"
_ANOVA_SQL = "SELECT feature, round(CASE WHEN total - between_ = 0 AND between_ > total * total / rows_ THEN 'inf'::DOUBLE WHEN total - between_ <> 0 THEN ((between_ - total * total / rows_) / (k - 1)) / ((total - between_) / (rows_ - k)) END, 4) AS score FROM (SELECT feature, CAST(sum(s) AS DOUBLE) AS total, CAST(sum(n) AS DOUBLE) AS rows_, sum(CAST(s AS DOUBLE) * s / n) AS between_, count(*) AS k FROM grid GROUP BY feature)"
_CHI_SQL = "SELECT feature, round(sum(CASE WHEN e > 0 THEN (s - e) * (s - e) / e END), 4) AS score FROM (SELECT feature, s, sum(s) OVER w * n / sum(n) OVER w AS e FROM grid WINDOW w AS (PARTITION BY feature)) GROUP BY feature"


def _tokens(spark, d) -> tuple[DataFrame, DataFrame]:
    return _words(spark, d).select("doc_id", F.col("cluster").alias("feature")), _t(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))


@query(f"WITH {_SCORED_SQL} {_ANOVA_SQL}")
def anova_f(spark, d):
    return select.anova_f(*_tokens(spark, d), "doc_id").withColumn("score", _r("score", 4))


@query(f"WITH {_WORDS_SQL} SELECT DISTINCT cluster AS feature, CAST(NULL AS DOUBLE) AS score FROM words JOIN labels USING (doc_id) WHERE quality = 1")
def single_class_scores(spark, d):
    """Where there is one class only, nothing is told apart and every score is null."""
    words, labels = _tokens(spark, d)
    return select.anova_f(words, labels.filter("label = 1"), "doc_id")


@query(f"WITH {_SCORED_SQL} {_CHI_SQL}")
def chi2_scores(spark, d):
    return select.chi2(*_tokens(spark, d), "doc_id").withColumn("score", _r("score", 4))


@query(f"WITH {_SCORED_SQL}, scored AS ({_CHI_SQL}) SELECT * FROM scored ORDER BY score DESC, feature LIMIT 50")
def k_best(spark, d):
    return select.top_features(chi2_scores(spark, d), 50)


@query(f"""
WITH {_WORDS_SQL}, t AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS y FROM documents), a AS (SELECT count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM t),
f AS (SELECT cluster AS feature, CAST(count(*) AS DOUBLE) AS sx, sum(y) AS sxy FROM words JOIN t USING (doc_id) GROUP BY 1),
r AS (SELECT feature, n, CASE WHEN n * sx - sx * sx > 0 THEN (n * sxy - sx * sy) * (n * sxy - sx * sy) / ((n * sx - sx * sx) * (n * syy - sy * sy)) END AS r2 FROM f, a)
SELECT feature, round(CASE WHEN r2 = 1 THEN 'inf'::DOUBLE ELSE r2 * (n - 2) / (1 - r2) END, 4) AS score FROM r
""")
def f_regression(spark, d):
    target = F.col("n_chars").cast("double").alias("target")
    targets = _t(spark, d, "documents").select("doc_id", target)
    return select.regression_f(_words_with(spark, d, target).select("doc_id", F.col("cluster").alias("feature"), "target"), targets, "doc_id").withColumn("score", _r("score", 4))


# --- evaluation -----------------------------------------------------------------------------


def _scored(spark, d) -> DataFrame:
    return _labelled(spark, d).select("lang", "toxic", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score")).withColumn("prediction", metrics.vote(F.col("score")))


_SCORES_SQL = "sc AS (SELECT lang, toxic, n_chars / (n_chars + 2000) AS score, CASE WHEN n_chars / (n_chars + 2000) > 0.5 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))"
_CONFUSION_SQL = "cf AS (SELECT lang, count(*) FILTER (WHERE toxic > 0 AND p > 0) AS tp, count(*) FILTER (WHERE toxic = 0 AND p > 0) AS fp, count(*) FILTER (WHERE toxic > 0 AND p = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND p = 0) AS tn FROM sc GROUP BY lang)"


@query(f"WITH {_SCORES_SQL}, {_CONFUSION_SQL} SELECT * FROM cf")
def confusion(spark, d):
    return evaluate.confusion(_scored(spark, d), ["lang"], "toxic", "prediction")


@query(f"WITH {_SCORES_SQL}, {_CONFUSION_SQL} SELECT lang, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END, 6) AS mcc FROM cf")
def binary_metrics(spark, d):
    rows = evaluate.classification_metrics(confusion(spark, d), ["lang"])
    return rows.select("lang", *[_r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "mcc")])


@query(f"WITH {_SCORES_SQL}, r AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM sc) SELECT lang, round(CASE WHEN sum(toxic) > 0 AND sum(1 - toxic) > 0 THEN (sum(r) FILTER (WHERE toxic > 0) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * sum(1 - toxic)) END, 6) AS auc FROM r GROUP BY lang")
def auc(spark, d):
    return evaluate.auc(_scored(spark, d), ["lang"], "toxic", "score").withColumn("auc", _r("auc"))


_CURVE_SQL = f"WITH {_SCORES_SQL}, c AS (SELECT lang, score, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM sc GROUP BY ALL), q AS (SELECT lang, score, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY lang ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS n FROM c)"


@query(f"{_CURVE_SQL} SELECT lang, round(score, 9) AS threshold, round(CASE WHEN n > 0 THEN fp / n ELSE 0.0 END, 6) AS fpr, round(CASE WHEN p > 0 THEN tp / p ELSE 0.0 END, 6) AS tpr FROM q UNION ALL SELECT DISTINCT lang, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM sc")
def roc_points(spark, d):
    return evaluate.roc_points(_scored(spark, d), ["lang"], "toxic", "score").select("lang", _r("threshold", 9).alias("threshold"), _r("fpr").alias("fpr"), _r("tpr").alias("tpr"))


@query(f"{_CURVE_SQL} SELECT lang, round(score, 9) AS threshold, round(tp / (tp + fp), 6) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 0.0 END, 6) AS recall FROM q UNION ALL SELECT DISTINCT lang, NULL, 1.0, 0.0 FROM sc")
def pr_points(spark, d):
    return evaluate.pr_points(_scored(spark, d), ["lang"], "toxic", "score").select("lang", _r("threshold", 9).alias("threshold"), _r("precision").alias("precision"), _r("recall").alias("recall"))


@query("SELECT user_id, round(median(value), 6) AS confidence, CASE WHEN median(value) > 0.5 THEN 1 ELSE 0 END AS prediction FROM events WHERE value IS NOT NULL GROUP BY user_id")
def ensemble_median(spark, d):
    events = _t(spark, d, "events").filter("value IS NOT NULL")
    return evaluate.ensemble(events, ["user_id"], "value").withColumn("confidence", _r("confidence"))


@query("SELECT l_returnflag, round(sum(e * e) / count(*), 2) AS mse, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) AS r2 FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS e FROM lineitem) GROUP BY 1")
def regression_metrics(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("predicted", 1500 * F.col("l_quantity"))
    out = evaluate.regression_metrics(rows, ["l_returnflag"], "l_extendedprice", "predicted")
    return out.select("l_returnflag", _r("mse", 2).alias("mse"), _r("r2").alias("r2"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def fitted_line(spark, d):
    out = evaluate.fitted_line(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", _r("slope", 4).alias("slope"), _r("intercept", 3).alias("intercept"))


@query("SELECT p_type, p_brand, n FROM (SELECT p_type, p_brand, count(*) AS n, rank() OVER (PARTITION BY p_type ORDER BY count(*) DESC) AS r FROM part GROUP BY 1, 2) WHERE r = 1")
def top_model_ties(spark, d):
    counts = _t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.best_with_ties(counts, ["p_type"], F.col("n"))


@query("WITH e AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL), p AS (SELECT x.g AS a, y.g AS b FROM (SELECT DISTINCT g FROM e) x, (SELECT DISTINCT g FROM e) y WHERE x.g < y.g), m AS (SELECT a, b, g = a AS of_a, v FROM p, e WHERE g = a OR g = b), r AS (SELECT a, b, of_a, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS r FROM m) SELECT a, b, round(sum(r) FILTER (WHERE of_a) - count(*) FILTER (WHERE of_a) * (count(*) FILTER (WHERE of_a) + 1) / 2.0, 1) AS u FROM r GROUP BY a, b")
def mannwhitney_u(spark, d):
    return evaluate.mann_whitney(_t(spark, d, "events"), "event_type", "value").select("a", "b", _r("u", 1).alias("u"))


@query("""
WITH e AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL), p AS (SELECT x.g AS a, y.g AS b FROM (SELECT DISTINCT g FROM e) x, (SELECT DISTINCT g FROM e) y WHERE x.g < y.g),
m AS (SELECT a, b, g = a AS of_a, v FROM p, e WHERE g = a OR g = b), r AS (SELECT a, b, of_a, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS r FROM m),
u AS (SELECT a, b, CAST(count(*) FILTER (WHERE of_a) AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE NOT of_a) AS DOUBLE) AS nb, CAST(sum(r) FILTER (WHERE of_a) AS DOUBLE) AS s FROM r GROUP BY a, b),
t AS (SELECT a, b, sum(n * n * n - n) AS ties FROM (SELECT a, b, v, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY ALL) GROUP BY a, b),
z AS (SELECT a, b, s - na * (na + 1) / 2 AS u, greatest(0, (abs(s - na * (na + 1) / 2 - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1))))) / sqrt(2) AS x FROM u JOIN t USING (a, b)),
q AS (SELECT *, 1 / (1 + 0.5 * x) AS k FROM z)
SELECT a, b, round(u, 1) AS u, round(least(1.0, k * exp(-x * x - 1.26551223 + k * (1.00002368 + k * (0.37409196 + k * (0.09678418 + k * (-0.18628806 + k * (0.27886807 + k * (-1.13520398 + k * (1.48851587 + k * (-0.82215223 + k * 0.17087277)))))))))), 6) AS p_value FROM q
""")
def mannwhitney_p(spark, d):
    return evaluate.mann_whitney(_t(spark, d, "events"), "event_type", "value").select("a", "b", _r("u", 1).alias("u"), _r("p_value").alias("p_value"))


@query("""
WITH v AS (SELECT r_name AS g, n_name, sum(c_acctbal) AS v FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), size AS (SELECT g, count(*) AS n FROM v GROUP BY g),
p AS (SELECT x.g AS a, y.g AS b, x.n AS na, y.n AS nb FROM size x JOIN size y ON x.g < y.g), u AS (SELECT a, b, na, nb, count(*) FILTER (WHERE x.v > y.v) AS u FROM p JOIN v x ON x.g = a JOIN v y ON y.g = b GROUP BY ALL),
draw AS (SELECT na, nb, mask, [i FOR i IN range(1, na + nb + 1) IF (mask >> (i - 1)) & 1 = 1] AS ranks FROM (SELECT DISTINCT na, nb FROM p) s, LATERAL (SELECT unnest(range(CAST(pow(2, na + nb) AS BIGINT))) AS mask)),
way AS (SELECT na, nb, list_sum(ranks) - na * (na + 1) / 2 AS u FROM draw WHERE len(ranks) = na),
exact AS (SELECT u.a, u.b, u.u, least(1.0, 2.0 * count(*) FILTER (WHERE way.u <= least(u.u, u.na * u.nb - u.u)) / count(*)) AS p FROM u JOIN way USING (na, nb) GROUP BY ALL)
SELECT a, b, CAST(u AS DOUBLE) AS u, round(p, 9) AS p_value FROM exact
""")
def mannwhitney_exact(spark, d):
    """Regions by their nations' balances: few values without ties, so the exact distribution of U."""
    nations = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(_t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = nations.groupBy(F.col("r_name").alias("g"), "n_name").agg(F.sum("c_acctbal").alias("v"))
    return evaluate.mann_whitney(sums, "g", "v").select("a", "b", "u", _r("p_value", 9).alias("p_value"))


@query("SELECT l_returnflag, CAST(median(l_extendedprice) AS DOUBLE) AS price, CAST(median(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def exact_medians(spark, d):
    """Medians of groups of a third of all rows each, by counted values."""
    rows = _t(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("l_extendedprice"), F.col("l_quantity").cast("double").alias("l_quantity"))
    return evaluate.exact_median(rows, ["l_returnflag"], "l_extendedprice", "price").join(evaluate.exact_median(rows, ["l_returnflag"], "l_quantity", "quantity"), "l_returnflag")


@query("SELECT count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS sd, min(n_chars) AS least, CAST(median(n_chars) AS DOUBLE) AS median, max(n_chars) AS most, count(*) FILTER (WHERE n_chars >= 100) AS reach_0, count(*) FILTER (WHERE n_chars >= 1000) AS reach_1, count(*) FILTER (WHERE n_chars >= 10000) AS reach_2 FROM documents")
def length_description(spark, d):
    out = evaluate.describe(_t(spark, d, "documents"), "n_chars", [100, 1000, 10000])
    return out.withColumns({"mean": _r("mean", 4), "sd": _r("sd", 4)})


@query("SELECT l_linestatus, " + ", ".join(f"median(l_quantity) FILTER (WHERE l_returnflag = '{f}') AS {f}" for f in "ANR") + " FROM lineitem GROUP BY 1")
def dataset_medians(spark, d):
    return evaluate.by_dataset(_t(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "view")) + " FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1")
def unique_cells(spark, d):
    counts = _t(spark, d, "events").filter(F.col("event_type").isin("click", "error", "view")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return presence.spread_values(counts, "user_id", "event_type", ["click", "error", "view"], "n")


@query("SELECT event_type AS run, user_id % 10 AS feature, CAST(event_id % 2 AS BIGINT) AS value, round(median(value), 6) AS median FROM events GROUP BY 1, 2, 3")
def shap_rollup(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 10).alias("feature"), (F.col("event_id") % 2).alias("v"), F.col("value").alias("shap_value"))
    return evaluate.median_by_run(e, "run", "feature", "v", "shap_value").select("run", "feature", F.col("v").alias("value"), _r("median").alias("median"))


@query("SELECT user_id AS feature, round(avg(abs(value)), 6) AS mean_abs FROM events GROUP BY 1 ORDER BY avg(abs(value)) DESC, 1 LIMIT 20")
def top_attributions(spark, d):
    return evaluate.top_by_mean_abs(_t(spark, d, "events").withColumnRenamed("user_id", "feature"), "feature", "value").withColumn("mean_abs", _r("mean_abs"))


# --- annotation and coverage ----------------------------------------------------------------


@query("""
WITH f AS (SELECT DISTINCT p_type AS feature, p_brand AS cluster FROM part), c AS (SELECT p_brand AS cluster, p_partkey AS protein_id FROM part),
r AS (SELECT feature, cluster, protein_id FROM f JOIN (SELECT DISTINCT p_type AS feature FROM part WHERE p_size > 25) USING (feature) LEFT JOIN c USING (cluster))
SELECT feature, cluster, protein_id, unique_clusters, unique_proteins FROM r JOIN (SELECT feature, count(DISTINCT cluster) AS unique_clusters, count(DISTINCT protein_id) AS unique_proteins FROM r GROUP BY 1) USING (feature)
""")
def predictive_proteins(spark, d):
    part = _t(spark, d, "part")
    features = part.select(F.col("p_type").alias("feature"), F.col("p_brand").alias("cluster")).distinct()
    return annotate.predictive_proteins(part.filter("p_size > 25").select(F.col("p_type").alias("feature")), features, part.select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("protein_id")))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1")
def first_per_key(spark, d):
    return annotate.first_per_key(_t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("SELECT f.protein_id, family, member FROM (SELECT p_name AS protein_id, min(p_type) AS family FROM part GROUP BY 1) f JOIN (SELECT DISTINCT p_type, p_name AS member FROM part) m ON p_type = family")
def family_members(spark, d):
    part = _t(spark, d, "part").select(F.col("p_type").alias("cluster"), F.col("p_name").alias("protein_id"))
    return annotate.family_members(part, part)


@query("SELECT genome, feature, protein_id FROM (SELECT p_partkey AS protein_id, p_type AS feature FROM part) JOIN (SELECT DISTINCT l_partkey AS protein_id, l_suppkey AS genome FROM lineitem) USING (protein_id) JOIN (SELECT DISTINCT s_suppkey AS genome, p_type AS feature FROM supplier, (SELECT DISTINCT p_type FROM part) WHERE s_acctbal > 5000) USING (genome, feature)")
def feature_overview(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_type").alias("feature"))
    genomes = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("protein_id"), F.col("l_suppkey").alias("genome")).distinct()
    assigned = merge.prediction_grid(part.select("feature").distinct(), _t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("genome")))
    return annotate.feature_overview(part, genomes, assigned).select("genome", "feature", "protein_id")


@query("SELECT feature, round(importance, 6) AS importance, round(shap, 6) AS shap FROM (SELECT user_id AS feature, avg(value) AS importance FROM events WHERE event_type = 'view' GROUP BY 1) JOIN (SELECT user_id AS feature, avg(abs(value)) AS shap FROM events WHERE event_type = 'click' GROUP BY 1) USING (feature)")
def importance_rollup(spark, d):
    e = _t(spark, d, "events").withColumnRenamed("user_id", "feature")
    out = annotate.importance_rollup(e.filter("event_type = 'view'").withColumnRenamed("value", "importance"), e.filter("event_type = 'click'").withColumnRenamed("value", "shap_value"))
    return out.select("feature", _r("importance").alias("importance"), _r("shap").alias("shap"))


@query("SELECT event_id, round(value / m, 6) AS scaled FROM events JOIN (SELECT user_id, nullif(max(value), 0) AS m FROM events GROUP BY 1) USING (user_id)")
def scaled_by_max(spark, d):
    return annotate.scaled_by_max(_t(spark, d, "events"), "user_id", "value").select("event_id", _r("scaled").alias("scaled"))


_SEGMENTS_SQL = "e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS c FROM events), f AS (SELECT *, CASE WHEN c <> lag(c) OVER w THEN 1 WHEN lag(c) OVER w IS NULL THEN 1 ELSE 0 END AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM f), seg AS (SELECT user_id, c AS coverage, CAST(seg AS BIGINT) AS segment_id, min(event_id) AS start, max(event_id) + 1 AS stop FROM s GROUP BY ALL)"


def _event_segments(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("index"), (F.col("event_type") == "error").cast("int").alias("coverage"))
    return coverage.segments(e, ["user_id"])


@query(f"WITH {_SEGMENTS_SQL} SELECT user_id, coverage, segment_id, start, stop FROM seg")
def coverage_segments(spark, d):
    return _event_segments(spark, d)


@query("""
WITH p AS (SELECT p_partkey AS protein_id, p_name, p_brand AS family FROM part), k AS (SELECT * FROM (VALUES ('f', 're'), ('f', 'in'), ('f', 'ink'), ('g', 'al')) v(feature, kmer)),
h AS (SELECT feature, protein_id, i - 1 AS a, i + length(kmer) - 2 AS b FROM (SELECT *, unnest(range(1, length(p_name) + 1)) AS i FROM p), k WHERE substr(p_name, i, length(kmer)) = kmer),
r AS (SELECT feature, protein_id, family, p_name, j - 1 AS i FROM (SELECT *, unnest(range(1, length(p_name) + 1)) AS j FROM p), (SELECT DISTINCT feature FROM k))
SELECT r.feature, family, r.protein_id, CAST(i AS INTEGER) AS "index", substr(p_name, i + 1, 1) AS residue, CAST(max(CASE WHEN h.protein_id IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS coverage
FROM r LEFT JOIN h ON r.protein_id = h.protein_id AND r.feature = h.feature AND i BETWEEN a AND b GROUP BY ALL
""")
def many_kmer_coverage(spark, d):
    """Residues that the k-mers of two features cover, all looked up in one pass of each name."""
    parts = _parts(spark, d)
    kmers = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("kmer")) for f, k in (("f", "re"), ("f", "in"), ("f", "ink"), ("g", "al"))]))
    asked = parts.select("family", "protein_id", kmers.alias("k")).select("k.feature", "family", "protein_id", "k.kmer")
    return coverage.covered_residues(parts.withColumnRenamed("sequence", "aligned"), asked)


@query("WITH p AS (SELECT p_partkey AS protein_id, p_name, p_brand AS family FROM part), h AS (SELECT protein_id, i - 1 AS a, i AS b FROM (SELECT *, unnest(range(1, length(p_name))) AS i FROM p) WHERE substr(p_name, i, 2) = 're'), r AS (SELECT protein_id, family, p_name, j - 1 AS i FROM (SELECT *, unnest(range(1, length(p_name) + 1)) AS j FROM p)) SELECT 'f' AS feature, family, r.protein_id, CAST(i AS INTEGER) AS \"index\", substr(p_name, i + 1, 1) AS residue, CAST(max(CASE WHEN h.protein_id IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS coverage FROM r LEFT JOIN h ON r.protein_id = h.protein_id AND i BETWEEN a AND b WHERE true GROUP BY ALL")
def residue_coverage(spark, d):
    aligned = _parts(spark, d).select(F.lit("f").alias("feature"), "family", "protein_id", F.col("sequence").alias("aligned"), F.lit("re").alias("kmer"))
    return coverage.residue_coverage(coverage.kmer_ranges(aligned))


@query("WITH a AS (SELECT p_partkey AS protein_id, p_brand AS family, p_size % 4 + 1 AS lead, repeat('-', p_size % 4 + 1) || p_name AS al FROM part), s AS (SELECT family, min(lead) AS shared FROM a GROUP BY 1) SELECT family, protein_id, substr(al, shared + 1) AS aligned, CAST(lead - shared AS INTEGER) AS start_index FROM a JOIN s USING (family)")
def trimmed_alignments(spark, d):
    lead = F.expr("repeat('-', CAST(p_size % 4 + 1 AS INT))")
    aligned = _t(spark, d, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_brand").alias("family"), F.concat(lead, "p_name").alias("aligned"))
    return coverage.trim_leading_gaps(aligned).select("family", "protein_id", "aligned", "start_index")


@query("WITH seg AS (SELECT p_partkey AS protein_id, p_brand AS family, 'f' AS feature, 1 AS coverage, CAST(p_size AS BIGINT) AS segment_id, 0 AS start, p_size AS stop FROM part WHERE p_size > 25) SELECT * FROM seg UNION ALL SELECT p_partkey, p_brand, NULL, 0, NULL, 0, CAST(length(replace(p_name, '-', '')) AS INTEGER) FROM part WHERE p_partkey NOT IN (SELECT protein_id FROM seg)")
def uncovered_union(spark, d):
    part = _t(spark, d, "part")
    found = part.filter("p_size > 25").select(F.lit("f").alias("feature"), F.col("p_brand").alias("family"), F.col("p_partkey").alias("protein_id"), F.lit(1).alias("coverage"), F.col("p_size").cast("long").alias("segment_id"), F.lit(0).alias("start"), F.col("p_size").alias("stop"))
    return coverage.add_uncovered(found, part.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("protein_id"), F.col("p_name").alias("aligned")))


# --- report tables, comparison, and queries that SQL has no twin for ---------------------------


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in ("click", "error", "view")) + " FROM events GROUP BY 1")
def pivot_mean(spark, d):
    out = evaluate.spread(_t(spark, d, "events"), "user_id", "event_type", ["click", "error", "view"], F.avg("value"))
    return out.select("user_id", *[_r(c).alias(c) for c in ("click", "error", "view")])


@query("SELECT l_returnflag, " + ", ".join(f'CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = {n}), 0) AS DOUBLE) AS "{n}"' for n in (1, 2, 3)) + " FROM lineitem GROUP BY 1")
def pivot_sum(spark, d):
    return evaluate.spread(_t(spark, d, "lineitem"), "l_returnflag", "l_linenumber", [1, 2, 3], F.sum("l_quantity")).na.fill(0.0)


@query("""
WITH p AS (SELECT event_type AS model, event_id % 3 AS cut_off, user_id AS strain, CAST(user_id % 2 AS DOUBLE) AS label, value / 100 AS confidence FROM events WHERE value IS NOT NULL),
v AS (SELECT model, cut_off, strain, label, CASE WHEN median(confidence) > 0.5 THEN 1 ELSE 0 END AS y FROM p GROUP BY ALL),
c AS (SELECT model, cut_off, CAST(count(*) FILTER (WHERE label > 0 AND y > 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND y > 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE label > 0 AND y = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label = 0 AND y = 0) AS DOUBLE) AS tn FROM v GROUP BY ALL),
m AS (SELECT model, cut_off, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc FROM c)
SELECT model, cut_off, round(mcc, 6) AS mcc FROM m QUALIFY rank() OVER (PARTITION BY model ORDER BY mcc DESC) = 1
""")
def method_comparison(spark, d):
    e = _t(spark, d, "events").filter("value IS NOT NULL")
    rows = e.select(F.col("event_type").alias("model"), (F.col("event_id") % 3).alias("cut_off"), F.lit("r").alias("run"), F.col("user_id").alias("strain"), (F.col("user_id") % 2).cast("double").alias("label"), (F.col("value") / 100).alias("confidence"))
    return evaluate.compare_methods(rows, ["strain"])[0].select("model", "cut_off", _r("mcc").alias("mcc"))


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) >= 4), k AS (SELECT DISTINCT p_name, substr(p_name, i, 4) AS m FROM (SELECT *, unnest(range(1, length(p_name) - 2)) AS i FROM n)), s AS (SELECT p_name, count(*) AS c FROM k GROUP BY 1)
SELECT a.p_name AS query, b.p_name AS target, round(count(*) / least(any_value(x.c), any_value(y.c)), 6) AS identity FROM k a JOIN k b USING (m) JOIN s x ON x.p_name = a.p_name JOIN s y ON y.p_name = b.p_name GROUP BY 1, 2 HAVING count(*) / least(any_value(x.c), any_value(y.c)) >= 0.4
""")
def homology_hits(spark, d):
    names = _t(spark, d, "part").select("p_name").distinct().select(F.col("p_name").alias("protein_id"), F.col("p_name").alias("sequence"))
    return cluster.homology_hits(names, names, k=4, least_identity=0.4).select("query", "target", _r("identity").alias("identity"))


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) >= 4), k AS (SELECT DISTINCT p_name, substr(p_name, i, 4) AS m FROM (SELECT *, unnest(range(1, length(p_name) - 2)) AS i FROM n)), s AS (SELECT p_name, count(*) AS c FROM k GROUP BY 1),
link AS (SELECT a.p_name AS a, b.p_name AS b FROM k a JOIN k b USING (m) JOIN s x ON x.p_name = a.p_name JOIN s y ON y.p_name = b.p_name GROUP BY 1, 2 HAVING count(*) / least(any_value(x.c), any_value(y.c)) >= 0.6 AND count(*) / any_value(x.c) >= 0.5 AND count(*) / any_value(y.c) >= 0.5),
reach AS (SELECT DISTINCT p_name AS a, p_name AS b FROM part UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT min(b) AS cluster, a AS protein_id FROM reach GROUP BY a
""")
def family_clusters(spark, d):
    names = _t(spark, d, "part").select("p_name").distinct().select(F.col("p_name").alias("protein_id"), F.col("p_name").alias("sequence"))
    return cluster.protein_families(names, k=4, least_identity=0.6, coverage=0.5)


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL), k AS (SELECT DISTINCT p_name, substr(p_name, i, 4) AS m FROM (SELECT *, unnest(range(1, length(p_name) - 2)) AS i FROM n WHERE length(p_name) >= 4)), s AS (SELECT p_name, count(*) AS c FROM k GROUP BY 1),
link AS (SELECT a.p_name AS a, b.p_name AS b FROM k a JOIN k b USING (m) JOIN s x ON x.p_name = a.p_name JOIN s y ON y.p_name = b.p_name WHERE a.p_name <> b.p_name GROUP BY 1, 2 HAVING count(*) / least(any_value(x.c), any_value(y.c)) >= 0.4),
ranked AS (SELECT p_name, row_number() OVER (ORDER BY count(b) DESC, length(p_name) DESC, p_name) AS p FROM n LEFT JOIN link ON a = p_name GROUP BY p_name),
near AS (SELECT x.p, x.p_name, list(y.p) FILTER (WHERE y.p < x.p) AS before FROM ranked x LEFT JOIN link ON link.a = x.p_name LEFT JOIN ranked y ON y.p_name = link.b GROUP BY x.p, x.p_name),
walk AS (
  SELECT CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS heads
  UNION ALL
  SELECT near.p, CASE WHEN list_has_any(coalesce(near.before, []), heads) THEN heads ELSE list_append(heads, near.p) END FROM walk JOIN near ON near.p = walk.p + 1),
heads AS (SELECT unnest(heads) AS h FROM walk WHERE p = (SELECT count(*) FROM n)),
joined AS (SELECT p, p_name, coalesce((SELECT min(h) FROM heads WHERE list_contains(before, h)), p) AS h FROM near)
SELECT r.p_name AS cluster, joined.p_name AS protein_id FROM joined JOIN ranked r ON r.p = joined.h
""")
def family_cover(spark, d):
    """Families by greedy set cover of the names that share k-mers."""
    names = _t(spark, d, "part").select("p_name").distinct().select(F.col("p_name").alias("protein_id"), F.col("p_name").alias("sequence"))
    return align.cover_families(names, cluster.homology_hits(names, names, k=4, least_identity=0.4))


@query()
def alignment_hits(spark, d):
    """Local alignments of all part names that share seeds."""
    names = _t(spark, d, "part").select("p_name").distinct().select(F.col("p_name").alias("protein_id"), F.upper("p_name").alias("sequence"))
    return align.alignment_hits(names, names, k=4, least_identity=0.4, least_shared=0.3).select("query", "target", _r("score").alias("score"), _r("identity").alias("identity"), "query_start", "query_end", "target_start", "target_end")


@query("""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), size AS (SELECT count(*) AS n FROM v),
s AS (
  SELECT 0 AS step, x.vec_id AS a, y.vec_id AS b, round(list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d, 1 AS na, 1 AS nb FROM v x JOIN v y ON x.vec_id < y.vec_id
  UNION ALL
  (WITH least_d AS (SELECT min(d) AS d FROM s), m AS (SELECT s.* FROM s JOIN least_d USING (d) ORDER BY a, b LIMIT 1),
  near AS (
    SELECT m.step, m.a, m.na + m.nb AS n, CASE WHEN s.a IN (m.a, m.b) THEN s.b ELSE s.a END AS other, any_value(CASE WHEN s.a IN (m.a, m.b) THEN s.nb ELSE s.na END) AS nk, sum((CASE WHEN s.a IN (m.a, m.b) THEN s.na ELSE s.nb END + CASE WHEN s.a IN (m.a, m.b) THEN s.nb ELSE s.na END) * s.d) AS w, m.d
    FROM s, m WHERE (s.a IN (m.a, m.b)) <> (s.b IN (m.a, m.b)) GROUP BY ALL)
  SELECT s.step + 1, s.a, s.b, s.d, s.na, s.nb FROM s, m, size WHERE s.a NOT IN (m.a, m.b) AND s.b NOT IN (m.a, m.b) AND s.step < size.n - 11
  UNION ALL
  SELECT step + 1, least(a, other), greatest(a, other), round((w - nk * d) / (near.n + nk), 9), CASE WHEN a < other THEN near.n ELSE nk END, CASE WHEN a < other THEN nk ELSE near.n END FROM near, size WHERE step < size.n - 11)),
merged AS (SELECT m.b AS child, m.a AS parent FROM (SELECT min({'d': d, 'a': a, 'b': b}) AS m FROM s GROUP BY step)),
up AS (SELECT vec_id, vec_id AS "group" FROM v UNION ALL SELECT up.vec_id, parent FROM up JOIN merged ON up."group" = child)
SELECT vec_id, min("group") AS "group" FROM up GROUP BY vec_id
""")
def hierarchical_clusters(spark, d):
    """Ward's ten clusters of all vectors."""
    return hierarchy.ward_groups(*hierarchy.dense_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding"), "vec_id", 10)


@query()
def density_clusters(spark, d):
    """HDBSCAN of all vectors."""
    return hierarchy.hdbscan_groups(*hierarchy.dense_vectors(_t(spark, d, "embeddings"), "vec_id", "embedding"), "vec_id", 5)


@query()
def bisected_clusters(spark, d):
    vectors = _t(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return cluster.genome_clusters(vectors, "vec_id", [f"e{i}" for i in range(64)], 10)


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT o_custkey % 200 AS genome, l_partkey % 40 AS cluster FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40),
s AS (SELECT genome, count(*) AS n FROM p GROUP BY 1), near AS (SELECT x.genome AS a, y.genome AS b FROM p x JOIN p y ON x.cluster = y.cluster AND x.genome <> y.genome JOIN s t ON t.genome = x.genome JOIN s u ON u.genome = y.genome GROUP BY 1, 2 HAVING count(*) >= 0.6 * (any_value(t.n) + any_value(u.n) - count(*))),
core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 2), link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT a, a AS b FROM core UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a), own AS (SELECT a, min(CAST(b AS VARCHAR)) AS g FROM reach GROUP BY a),
border AS (SELECT b, min(g) AS g FROM near JOIN own USING (a) GROUP BY b)
SELECT CAST(s.genome AS VARCHAR) AS genome, coalesce(own.g, border.g, CAST(s.genome AS VARCHAR)) AS "group" FROM s LEFT JOIN own ON own.a = s.genome LEFT JOIN border ON border.b = s.genome
""")
def dense_groups(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "lineitem").filter("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey"))
    return cluster.dense_groups(rows.select((F.col("o_custkey") % 200).cast("string").alias("genome"), (F.col("l_partkey") % 40).alias("cluster")), 0.6)


@query()
def gbt_ensemble(spark, d):
    """Trees on word presence against quality: the votes of three seeds on all labelled rows, with
    words chosen and trees fitted on the training fold."""
    words, labels = _tokens(spark, d)
    labels = materialize(split.split_rows(labels, 0, positive=F.col("label") > 0), "labels")
    train = labels.filter("fold = 'train'").drop("fold")
    best = [r.feature for r in select.top_features(select.anova_f(words, train, "doc_id"), 20).collect()]
    held = words.filter(F.col("feature").isin(best)).groupBy("doc_id").agg(F.collect_set("feature").alias(model.HELD))
    rows = materialize(labels.join(held, "doc_id", "left").withColumn(model.HELD, F.coalesce(model.HELD, F.array().cast("array<string>"))), "held")
    models = [(f"run_{i}", model.fit(rows.filter("fold = 'train'"), best, model.Settings(label="label", seed=i), 5, 0.1, 3)) for i in range(3)]
    return evaluate.ensemble(model.score_all(models, rows, ["doc_id"]), ["doc_id"])


def _boosting_examples(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents' words against quality in five runs, each of which leaves out a fifth of the rows."""
    words, labels = _tokens(spark, d)
    runs = [f"run_{k}" for k in range(5)]
    each = labels.select(F.col("doc_id").cast("string").alias("row"), "label", F.col("doc_id"), F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    examples = each.select(F.concat(F.lit("run_"), F.col("k").cast("string")).alias("run"), "row", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight"), F.when(F.col("doc_id") % 5 == F.col("k"), "test").otherwise("train").alias("fold"))
    return examples, words.select(F.col("doc_id").cast("string").alias("row"), "feature"), runs


@query(f"""
WITH {_WORDS_SQL}, ex AS (SELECT 'run_' || k AS run, doc_id, CASE WHEN quality > 0 THEN 0.5 ELSE -0.5 END AS g, 0.25 AS h FROM labels, (SELECT unnest(range(5)) AS k) WHERE doc_id % 5 <> k AND quality IS NOT NULL),
cell AS (SELECT run, w.cluster AS feature, doc_id, g, h FROM ex JOIN (SELECT DISTINCT doc_id, cluster FROM words) w USING (doc_id)),
whole AS (SELECT run, sum(g) AS g, sum(h) AS h FROM ex GROUP BY run),
held AS (SELECT run, feature, sum(g) AS g, sum(h) AS h FROM cell GROUP BY 1, 2),
zero AS (SELECT run, feature, round(x.g * x.g / (x.h + 3) + (w.g - x.g) * (w.g - x.g) / (w.h - x.h + 3) - w.g * w.g / (w.h + 3), 9) AS gain FROM held x JOIN whole w USING (run)),
first AS (SELECT run, feature FROM zero QUALIFY row_number() OVER (PARTITION BY run ORDER BY gain DESC, feature) = 1),
leaf AS (SELECT ex.run, ex.doc_id, count(cell.doc_id) AS leaf FROM ex JOIN first USING (run) LEFT JOIN cell ON cell.run = ex.run AND cell.doc_id = ex.doc_id AND cell.feature = first.feature GROUP BY 1, 2),
whole1 AS (SELECT run, leaf, sum(g) AS g, sum(h) AS h FROM ex JOIN leaf USING (run, doc_id) GROUP BY 1, 2),
held1 AS (SELECT run, feature, leaf, sum(g) AS g, sum(h) AS h FROM cell JOIN leaf USING (run, doc_id) GROUP BY 1, 2, 3),
one AS (SELECT run, feature, sum(x.g * x.g / (x.h + 3) + (w.g - x.g) * (w.g - x.g) / (w.h - x.h + 3) - w.g * w.g / (w.h + 3)) AS gain FROM held1 x JOIN whole1 w USING (run, leaf) GROUP BY 1, 2)
SELECT run, 0 AS level, feature, round(gain, 6) AS gain FROM zero UNION ALL SELECT run, 1, feature, round(gain, 6) FROM one
""")
def boosting_gains(spark, d):
    """The gains of every word at the first two levels of a tree, for five runs at once."""
    examples, words, runs = _boosting_examples(spark, d)
    codes = materialize(boosting.number_features(words), "codes")
    fits = [boosting.Fit(r, r, 0.1, 2, 1) for r in runs]
    forest = boosting.Forest(boosting.cells(examples, words, codes, runs), fits, runs, None, "classification")
    live = list(range(len(fits)))
    totals = forest.totals(live)
    start = [[totals[k][:2]] for k in live]
    best = forest.best_splits(live, [[] for _ in live], start)
    split_sums = [[(g - a, h - b), (a, b)] for ((g, h),), ((a, b),) in ((start[k], best[k][2]) for k in live)]
    found = [forest.gains(live, [[] for _ in live], start), forest.gains(live, [[best[k][1]] for k in live], split_sums)]
    names = spark.createDataFrame([(k, f.run) for k, f in enumerate(fits)], "fit int, run string")
    rows = [df.select("fit", "code", "gain", F.lit(level).alias("level")) for level, df in enumerate(found)]
    return rows[0].unionByName(rows[1]).join(F.broadcast(names), "fit").join(codes, "code").select("run", "level", "feature", _r("gain").alias("gain"))


@query()
def boosted_ensemble(spark, d):
    """Symmetric trees on all words against quality: the votes of five runs on all labelled rows."""
    examples, words, runs = _boosting_examples(spark, d)
    codes = materialize(boosting.number_features(words), "codes")
    data = materialize(boosting.cells(examples, words, codes, runs), "cells")
    trees, grown = boosting.fit_all(data, [boosting.Fit(r, r, 0.3, 2, 3) for r in runs], runs)
    models = boosting.collect_models(boosting.cut_trees(trees, {g.fit.name: g.length() for g in grown}))
    scored = boosting.score_rows(data, models, {g.fit.name: g.start for g in grown})
    return evaluate.ensemble(scored.select(F.col("row").cast("long").alias("doc_id"), F.col("fit").alias("run"), "confidence"), ["doc_id"])
