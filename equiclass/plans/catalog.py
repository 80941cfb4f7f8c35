"""The registered queries: each runs one operator over a whole driver table.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the SQL that
computes the same rows by brute force (``plans.oracle``). Vector results are given in
long form (one row per position) so that they compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import sql_hash_hex, sql_uniform01
from ..functions.vectors import (common_indices, cosine_similarity, dot, euclidean_distance,
                                 l2_norm, nonzero_indices, sparse_interpolate, union_indices)
from ..operators.classes import class_rows
from ..operators.encode import nominal_index
from ..operators.neighbors import nearest_neighbors
from ..operators.oversample import oversample
from ..operators.profile import (class_counts, class_profile, code_counts, compare_profiles,
                                 feature_stats)
from ..operators.pruned import pruned_neighbors
from ..operators.resample import resample_uniform
from ..operators.sample import sample_bernoulli, sample_exact, sample_with_replacement
from ..operators.smote import smote, smote_percent
from ..operators.undersample import undersample_pair, undersample_spread
from ..sources.readers import format_labeled_vectors, parse_labeled_vectors
from ..sources.textrows import csv_line, parse_csv, stored_lines
from . import oracle
from .workflows import resampling_report

SEED = 42

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
CONV = ["conv_id", "turn", "role", "text"]
LABELS = ["doc_id", "quality", "toxic"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# lineitem has no key column; these integer and string columns identify a row.
LINEITEM_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long_form(df: DataFrame, features_col: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(features_col).alias("dim", "value"))


def _vector_long(df: DataFrame) -> DataFrame:
    return _long_form(df, "embedding", ["label", "is_synthetic", "source_id", "neighbor_id"])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


# --- Spark side ---------------------------------------------------------------------------

def q_class_counts_lang(spark, d):
    return class_counts(table(spark, d, "documents"), "lang")


def q_class_profile_quality(spark, d):
    return class_profile(table(spark, d, "labels"), "quality")


def q_oversample_lang(spark, d):
    return oversample(table(spark, d, "documents"), "lang", ["doc_id"], seed=SEED)


def q_oversample_brand25(spark, d):
    return oversample(table(spark, d, "part"), "p_brand", ["p_partkey"], seed=SEED)


def q_oversample_users(spark, d):
    return oversample(table(spark, d, "events"), "user_id", ["event_id"], seed=SEED)


def q_oversample_nation(spark, d):
    return oversample(table(spark, d, "customer"), "c_nationkey", ["c_custkey"], seed=SEED)


def q_oversample_lineitem(spark, d):
    return oversample(table(spark, d, "lineitem"), "l_returnflag", LINEITEM_IDS, seed=SEED)


def q_sample_exact_lineitem(spark, d):
    return sample_exact(table(spark, d, "lineitem"), "l_returnflag", LINEITEM_IDS, 15000, seed=SEED)


def q_sample_exact_role(spark, d):
    return sample_exact(table(spark, d, "conversations"), "role", ["conv_id", "turn"], 100, seed=SEED)


def q_sample_bernoulli_events(spark, d):
    return sample_bernoulli(table(spark, d, "events"), ["event_id"], 0.1, seed=SEED)


def q_sample_replace_lang(spark, d):
    return sample_with_replacement(table(spark, d, "documents"), "lang", ["doc_id"], 50, seed=SEED)


def q_undersample_spread_lang(spark, d):
    return undersample_spread(table(spark, d, "documents"), "lang", ["doc_id"], 1.0, seed=SEED)


def q_undersample_spread_segment(spark, d):
    return undersample_spread(table(spark, d, "customer"), "c_mktsegment", ["c_custkey"], 1.5,
                              seed=SEED)


def q_undersample_pair_toxic(spark, d):
    return undersample_pair(table(spark, d, "labels"), "toxic", ["doc_id"], 1, 0, 1.0, seed=SEED)


def q_undersample_pair_exact(spark, d):
    return undersample_pair(table(spark, d, "labels"), "toxic", ["doc_id"], 1, 0, 1.0, seed=SEED,
                            exact=True)


def q_resample_uniform_quality(spark, d):
    return resample_uniform(table(spark, d, "labels"), "quality", ["doc_id"], bias=1.0, seed=SEED)


def q_resample_uniform_role(spark, d):
    return resample_uniform(table(spark, d, "conversations"), "role", ["conv_id", "turn"],
                            bias=0.5, size_percent=80.0, seed=SEED)


def q_nominal_index_psize(spark, d):
    return nominal_index(table(spark, d, "part"), "p_size")


def q_code_counts_psize(spark, d):
    coded = nominal_index(table(spark, d, "part"), "p_size")
    return code_counts(coded, "p_size_code", 64)


def q_feature_stats_lineitem(spark, d):
    return feature_stats(table(spark, d, "lineitem"), LINEITEM_NUM, digits=2)


def q_knn_cosine(spark, d):
    e = _vectors(spark, d)
    return nearest_neighbors(e, e, "label", "vec_id", "v", 5, "cosine")


def q_knn_euclidean(spark, d):
    e = _vectors(spark, d)
    return nearest_neighbors(e, e, "label", "vec_id", "v", 5, "euclidean")


def q_smote_embeddings(spark, d):
    out = smote(table(spark, d, "embeddings"), "label", "embedding", "vec_id", k=5,
                sampling_rate=0.5, ratio_to_max=1.0, seed=SEED)
    return _vector_long(out)


def q_smote_percent(spark, d):
    out = smote_percent(table(spark, d, "embeddings"), "label", "embedding", "vec_id",
                        percent=100, k=5, seed=SEED)
    return _vector_long(out)


def q_compare_oversample(spark, d):
    docs = table(spark, d, "documents")
    return compare_profiles(docs, oversample(docs, "lang", ["doc_id"], seed=SEED), "lang")


def q_parse_vectors(spark, d):
    e = table(spark, d, "embeddings")
    lines = e.select("vec_id", format_labeled_vectors("label", "embedding").alias("value"))
    parsed = parse_labeled_vectors(lines, "value", size=64)
    return _long_form(parsed, "features", ["vec_id", "label"])


def q_resampling_report_segment(spark, d):
    return resampling_report(table(spark, d, "customer"), "c_mktsegment",
                             ["c_acctbal", "c_nationkey"], "c_custkey", seed=SEED)


def q_oversample_orders_priority(spark, d):
    return oversample(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"], seed=SEED)


def q_undersample_spread_orders_status(spark, d):
    return undersample_spread(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], 1.0,
                              seed=SEED)


def q_sample_exact_events_type(spark, d):
    return sample_exact(table(spark, d, "events"), "event_type", ["event_id"], 1500, seed=SEED)


def q_sample_bernoulli_documents(spark, d):
    return sample_bernoulli(table(spark, d, "documents"), ["doc_id"], 0.3, seed=7)


def q_resample_uniform_segment(spark, d):
    return resample_uniform(table(spark, d, "customer"), "c_mktsegment", ["c_custkey"], bias=0.0,
                            size_percent=50.0, seed=SEED)


def q_smote_embeddings_euclidean(spark, d):
    out = smote(table(spark, d, "embeddings"), "label", "embedding", "vec_id", k=4,
                sampling_rate=1.0, ratio_to_max=0.9, seed=7, metric="euclidean")
    return _vector_long(out)


def q_vector_functions(spark, d):
    e = _vectors(spark, d)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    p = e.join(nxt, "vec_id")
    return p.select(
        "vec_id",
        dot("v", "w").alias("dot"),
        l2_norm("v").alias("norm_a"),
        l2_norm("w").alias("norm_b"),
        cosine_similarity("v", "w").alias("cosine"),
        euclidean_distance("v", "w").alias("euclidean"),
        F.size(common_indices(nonzero_indices("v"), nonzero_indices("w"))).alias("n_common"),
        F.size(union_indices(nonzero_indices("v"), nonzero_indices("w"))).alias("n_union"),
    )


# The same rows through the branches that large inputs take: many rank buckets, many tiles,
# codes numbered by a shuffle.

def q_oversample_lineitem_bucketed(spark, d):
    return oversample(table(spark, d, "lineitem"), "l_returnflag", LINEITEM_IDS, seed=SEED, bucket_rows=256)


def q_sample_exact_lineitem_bucketed(spark, d):
    return sample_exact(table(spark, d, "lineitem"), "l_returnflag", LINEITEM_IDS, 15000, seed=SEED,
                        bucket_rows=64)


def q_undersample_spread_lang_bucketed(spark, d):
    return undersample_spread(table(spark, d, "documents"), "lang", ["doc_id"], 1.0, seed=SEED, bucket_rows=16)


def q_sample_replace_lang_bucketed(spark, d):
    return sample_with_replacement(table(spark, d, "documents"), "lang", ["doc_id"], 50, seed=SEED,
                                   bucket_rows=16)


def q_resample_uniform_quality_bucketed(spark, d):
    return resample_uniform(table(spark, d, "labels"), "quality", ["doc_id"], bias=1.0, seed=SEED, bucket_rows=16)


def q_knn_cosine_tiled(spark, d):
    e = _vectors(spark, d)
    return nearest_neighbors(e, e, "label", "vec_id", "v", 5, "cosine", tile=16)


def q_knn_cosine_pruned(spark, d):
    e = _vectors(spark, d)
    return pruned_neighbors(e, e, "label", "vec_id", "v", 5, "cosine", tile=64)


def q_nominal_index_distributed(spark, d):
    return nominal_index(table(spark, d, "part"), "p_size", max_local=0)


def q_class_rows_german(spark, d):
    return class_rows(table(spark, d, "documents"), "lang", "de")


def q_text_lines(spark, d):
    """Non-blank lines of every stored text, with their positions."""
    return stored_lines(table(spark, d, "documents"), "text", ["doc_id"])


def q_csv_strings_customer(spark, d):
    """Headerless lines, all strings, class = last column: rows per class."""
    lines = table(spark, d, "customer").select(csv_line(*CUSTOMER).alias("value"))
    rows, cls = parse_csv(lines, len(CUSTOMER))
    return class_counts(rows, cls)


def q_csv_typed_orders(spark, d):
    """Typed lines; every order of a customer whose key ends in 7 has a price that is no number."""
    price = F.when(F.col("o_custkey") % 10 == 7, F.lit("n/a, unknown")).otherwise(F.col("o_totalprice").cast("string"))
    lines = table(spark, d, "orders").withColumn("o_totalprice", price).select(
        "o_orderkey", csv_line("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").alias("value"))
    rows, _ = parse_csv(lines, "key bigint, customer int, price double, priority string",
                        keep=["o_orderkey"], corrupt_col="bad")
    return rows.select("o_orderkey", "key", "customer", "price", "priority", F.col("bad").isNotNull().alias("is_bad"))


def q_csv_header_customer(spark, d):
    """One file per nation, each with its header line; class = last column."""
    customer = table(spark, d, "customer")
    head = customer.select("c_nationkey").distinct().select(
        "c_nationkey", F.lit(0).alias("position"), F.lit(",".join(CUSTOMER)).alias("value"))
    lines = head.unionByName(customer.select(
        "c_nationkey", F.lit(1).alias("position"), csv_line(*CUSTOMER).alias("value")))
    schema = "c_custkey bigint, c_name string, nation int, c_acctbal double, c_mktsegment string"
    rows, _ = parse_csv(lines, schema, header=True, position_col="position", keep=["c_nationkey"])
    return rows


def q_csv_repeated_supplier(spark, d):
    """An input given three times is read three times: rows per class."""
    lines = table(spark, d, "supplier").select(csv_line("s_suppkey", "s_name", "s_nationkey").alias("value"))
    rows, cls = parse_csv(lines.unionAll(lines).unionAll(lines), "s_suppkey bigint, s_name string, s_nationkey int")
    return class_counts(rows, cls)


def q_sparse_interpolation(spark, d):
    """Positive entries of every vector, a quarter of the way to the next id's; long form."""
    rows = table(spark, d, "embeddings").select("vec_id", F.expr(
        "filter(transform(embedding, (v, i) -> struct(i, cast(v as double) as v)), e -> e.v > 0)").alias("own"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("own").alias("next"))
    pairs = rows.join(after, "vec_id")
    found = sparse_interpolate((F.col("own.i"), F.col("own.v")), (F.col("next.i"), F.col("next.v")),
                               lambda i: F.lit(0.25))
    return pairs.select("vec_id", F.explode(found).alias("e")).select(
        "vec_id", F.col("e.i").alias("dim"), F.col("e.v").alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "class_counts_lang": q_class_counts_lang,
    "class_profile_quality": q_class_profile_quality,
    "oversample_lang": q_oversample_lang,
    "oversample_brand25": q_oversample_brand25,
    "oversample_users": q_oversample_users,
    "oversample_nation": q_oversample_nation,
    "oversample_lineitem": q_oversample_lineitem,
    "sample_exact_lineitem": q_sample_exact_lineitem,
    "sample_exact_role": q_sample_exact_role,
    "sample_bernoulli_events": q_sample_bernoulli_events,
    "sample_replace_lang": q_sample_replace_lang,
    "undersample_spread_lang": q_undersample_spread_lang,
    "undersample_spread_segment": q_undersample_spread_segment,
    "undersample_pair_toxic": q_undersample_pair_toxic,
    "undersample_pair_exact": q_undersample_pair_exact,
    "resample_uniform_quality": q_resample_uniform_quality,
    "resample_uniform_role": q_resample_uniform_role,
    "nominal_index_psize": q_nominal_index_psize,
    "code_counts_psize": q_code_counts_psize,
    "feature_stats_lineitem": q_feature_stats_lineitem,
    "knn_cosine": q_knn_cosine,
    "knn_euclidean": q_knn_euclidean,
    "smote_embeddings": q_smote_embeddings,
    "smote_percent": q_smote_percent,
    "compare_oversample": q_compare_oversample,
    "parse_vectors": q_parse_vectors,
    "vector_functions": q_vector_functions,
    "resampling_report_segment": q_resampling_report_segment,
    "oversample_orders_priority": q_oversample_orders_priority,
    "undersample_spread_orders_status": q_undersample_spread_orders_status,
    "sample_exact_events_type": q_sample_exact_events_type,
    "sample_bernoulli_documents": q_sample_bernoulli_documents,
    "resample_uniform_segment": q_resample_uniform_segment,
    "oversample_lineitem_bucketed": q_oversample_lineitem_bucketed,
    "sample_exact_lineitem_bucketed": q_sample_exact_lineitem_bucketed,
    "undersample_spread_lang_bucketed": q_undersample_spread_lang_bucketed,
    "sample_replace_lang_bucketed": q_sample_replace_lang_bucketed,
    "resample_uniform_quality_bucketed": q_resample_uniform_quality_bucketed,
    "knn_cosine_tiled": q_knn_cosine_tiled,
    "nominal_index_distributed": q_nominal_index_distributed,
    "class_rows_german": q_class_rows_german,
    "knn_cosine_pruned": q_knn_cosine_pruned,
    "text_lines": q_text_lines,
    "csv_strings_customer": q_csv_strings_customer,
    "csv_typed_orders": q_csv_typed_orders,
    "csv_header_customer": q_csv_header_customer,
    "csv_repeated_supplier": q_csv_repeated_supplier,
    "sparse_interpolation": q_sparse_interpolation,
    "smote_embeddings_euclidean": q_smote_embeddings_euclidean,
}


# --- SQL side -------------------------------------------------------------------------------

def _round2(x: str) -> str:
    return f"floor(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


def _feature_stats_sql() -> str:
    parts = []
    for c in LINEITEM_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, count({x}) AS n, {_round2(f'avg({x})')} AS mean, "
            f"{_round2(f'var_samp({x})')} AS variance, "
            f"count(*) FILTER (WHERE {x} <> 0) AS non_zeros FROM lineitem")
    return "\nUNION ALL\n".join(parts)


_E = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL"


def _knn_sql(metric: str) -> str:
    return ("WITH " + oracle.pairs(_E, metric, 5).strip() +
            "\nSELECT label, seed_id, neighbor_id, CAST(k_rank AS INTEGER) AS k_rank, score FROM nn")


def _originals_long(min_rows: int) -> str:
    return ("SELECT label, false AS is_synthetic, vec_id AS source_id, CAST(NULL AS BIGINT) AS neighbor_id, "
            "CAST(i AS INTEGER) AS dim, v[i + 1] AS value FROM "
            f"(SELECT e.*, unnest(range(len(e.v))) AS i FROM e JOIN sz USING (label) WHERE sz.n >= {min_rows}) o")


def _smote_sql(metric: str = "cosine", k: int = 5, rate: float = 0.5, ratio: float = 1.0,
               seed: int = SEED) -> str:
    h_seed = sql_hash_hex(seed, ["e.vec_id"])
    h_pick = sql_hash_hex(seed, ["seed_id", "neighbor_id"])
    gap = sql_uniform01(seed, ["seed_id", "neighbor_id", "i"])
    if metric == "cosine":
        score = (f"CASE WHEN a.nv <> 0 AND b.nv <> 0 THEN {oracle.dot('a.v', 'b.v')} / (a.nv * b.nv) "
                 f"ELSE 0.0::DOUBLE END")
        order = "score DESC, neighbor_id"
    else:
        score = f"sqrt({oracle.sqdist('a.v', 'b.v')})"
        order = "score, neighbor_id"
    return f"""
WITH e AS ({_E}),
sz AS (SELECT label, count(*) AS n FROM e GROUP BY label),
mx AS (SELECT max(n) AS m FROM sz),
p0 AS (SELECT label, n,
              CASE WHEN CAST(n AS DOUBLE) < m * {ratio!r}::DOUBLE
                   THEN CAST(trunc(m * {ratio!r}::DOUBLE - n) AS BIGINT) ELSE 0 END AS need,
              greatest(0, least(CASE WHEN n >= {k} THEN {k} ELSE CAST(trunc(n * 0.5::DOUBLE) AS BIGINT) END,
                                n - 1)) AS kc
       FROM sz, mx WHERE n > 1),
p1 AS (SELECT *, CASE WHEN kc > 0 THEN greatest(1, least(kc, CAST(floor(kc * {rate!r}::DOUBLE + 0.5::DOUBLE)
                  AS BIGINT))) ELSE 0 END AS r FROM p0),
pl AS (SELECT *, CASE WHEN need > 0 AND r > 0 THEN least(n, (need + r - 1) // r) ELSE 0 END AS seeds
       FROM p1),
rk AS (SELECT e.*, pl.need, pl.kc, pl.r, pl.seeds,
              row_number() OVER (PARTITION BY e.label ORDER BY {h_seed}, e.vec_id) AS seed_rank
       FROM e JOIN pl USING (label) WHERE pl.seeds > 0),
en AS (SELECT *, sqrt({oracle.dot('v', 'v')}) AS nv FROM rk),
pr AS (SELECT a.label, a.vec_id AS seed_id, b.vec_id AS neighbor_id, a.seed_rank, a.need, a.kc, a.r,
              a.v AS x, b.v AS y, {score} AS score
       FROM en a JOIN en b ON a.label = b.label AND a.vec_id <> b.vec_id
       WHERE a.seed_rank <= a.seeds),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {order})
                             AS k_rank FROM pr) q WHERE k_rank <= kc),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {h_pick}, neighbor_id)
                             AS pick FROM nn) q
       WHERE pick <= r AND (seed_rank - 1) * r + pick <= need),
sl AS (SELECT label, seed_id, neighbor_id, x, y, unnest(range(len(x))) AS i FROM pk)
{_originals_long(2)}
UNION ALL
SELECT label, true, seed_id, neighbor_id, CAST(i AS INTEGER), x[i + 1] + {gap} * (y[i + 1] - x[i + 1])
FROM sl"""


def _smote_percent_sql() -> str:
    draw = sql_uniform01(SEED, ["seed_id", "1"])
    gap = sql_uniform01(SEED, ["seed_id", "j", "i"])
    return f"""
WITH e AS ({_E}),
sz AS (SELECT label, count(*) AS n FROM e GROUP BY label),
mn AS (SELECT label AS ml, n AS nm, least(5, n - 1) AS kc FROM sz ORDER BY n, label LIMIT 1),
c AS (SELECT e.*, mn.kc FROM e JOIN mn ON e.label = mn.ml),
pr AS (SELECT a.label, a.vec_id AS seed_id, b.vec_id AS neighbor_id, a.kc, a.v AS x, b.v AS y,
              sqrt({oracle.sqdist('a.v', 'b.v')}) AS score
       FROM c a JOIN c b ON a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score, neighbor_id)
                             AS k_rank FROM pr) q WHERE k_rank <= kc),
dr AS (SELECT DISTINCT seed_id, 1 AS j, CAST(floor({draw} * kc) + 1 AS BIGINT) AS want FROM nn),
pk AS (SELECT nn.*, dr.j FROM nn JOIN dr ON nn.seed_id = dr.seed_id AND nn.k_rank = dr.want),
sl AS (SELECT label, seed_id, neighbor_id, j, x, y, unnest(range(len(x))) AS i FROM pk)
{_originals_long(1)}
UNION ALL
SELECT label, true, seed_id, neighbor_id, CAST(i AS INTEGER), x[i + 1] + {gap} * (y[i + 1] - x[i + 1])
FROM sl"""


def _vector_functions_sql() -> str:
    def nz(v):
        return f"list_filter(list_transform({v}, lambda x, i: CASE WHEN x <> 0 THEN i END), lambda i: i IS NOT NULL)"
    return f"""
WITH e AS ({_E}),
p AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id,
       {oracle.dot('v', 'w')} AS dot,
       sqrt({oracle.dot('v', 'v')}) AS norm_a,
       sqrt({oracle.dot('w', 'w')}) AS norm_b,
       CASE WHEN sqrt({oracle.dot('v', 'v')}) <> 0 AND sqrt({oracle.dot('w', 'w')}) <> 0
            THEN {oracle.dot('v', 'w')} / (sqrt({oracle.dot('v', 'v')}) * sqrt({oracle.dot('w', 'w')}))
            ELSE 0.0::DOUBLE END AS cosine,
       sqrt({oracle.sqdist('v', 'w')}) AS euclidean,
       CAST(len(list_intersect({nz('v')}, {nz('w')})) AS INTEGER) AS n_common,
       CAST(len(list_distinct(list_concat({nz('v')}, {nz('w')}))) AS INTEGER) AS n_union
FROM p"""


ORACLE: dict[str, str] = {
    "class_counts_lang": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "class_profile_quality": """
WITH s AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_classes, max(n) AS n_max, min(n) AS n_min FROM s)
SELECT quality, n, CAST(n AS DOUBLE) / CAST(n_total AS DOUBLE) * 100.0::DOUBLE AS share_pct,
       n_total, n_classes, n_max, n_min,
       CAST(n_max AS DOUBLE) / CAST(n_total AS DOUBLE) * 100.0::DOUBLE AS majority_pct,
       CAST(n_max AS DOUBLE) / CAST(n_min AS DOUBLE) AS imbalance_ratio
FROM s, t""",
    "oversample_lang": oracle.oversample("documents", "lang", ["doc_id"], DOCS),
    "oversample_brand25": oracle.oversample("part", "p_brand", ["p_partkey"], PART),
    "oversample_users": oracle.oversample("events", "user_id", ["event_id"], EVENTS),
    "oversample_nation": oracle.oversample(
        "customer", "c_nationkey", ["c_custkey"],
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "oversample_lineitem": oracle.oversample("lineitem", "l_returnflag", LINEITEM_IDS, LINEITEM),
    "sample_exact_lineitem": oracle.sample_exact("lineitem", "l_returnflag", LINEITEM_IDS, LINEITEM,
                                                 15000),
    "sample_exact_role": oracle.sample_exact("conversations", "role", ["conv_id", "turn"], CONV, 100),
    "sample_bernoulli_events":
        f"SELECT * FROM events WHERE {sql_uniform01(SEED, ['event_id'])} < 0.1::DOUBLE",
    "sample_replace_lang": oracle.draws_join("documents", "lang", ["doc_id"], DOCS, "50"),
    "undersample_spread_lang": oracle.undersample_spread("documents", "lang", ["doc_id"], DOCS, 1.0),
    "undersample_spread_segment": oracle.undersample_spread(
        "customer", "c_mktsegment", ["c_custkey"],
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], 1.5),
    "undersample_pair_toxic": f"""
WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM labels)
SELECT l.doc_id, l.quality, l.toxic FROM labels l, c
WHERE l.toxic = 1
   OR (l.toxic = 0 AND {sql_uniform01(SEED, ['l.doc_id'])} < least(1.0::DOUBLE, 1.0::DOUBLE * c.a / c.b))""",
    "undersample_pair_exact": f"""
WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM labels),
r AS ({oracle.ranked('labels', 'toxic', ['doc_id'], SEED, 'toxic = 0')})
SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1
UNION ALL
SELECT r.doc_id, r.quality, r.toxic FROM r, c WHERE r.rk <= least(c.b, CAST(floor(1.0::DOUBLE * c.a) AS BIGINT))""",
    "resample_uniform_quality": oracle.resample_uniform("labels", "quality", ["doc_id"], LABELS, 1.0),
    "resample_uniform_role": oracle.draws_join(
        "conversations", "role", ["conv_id", "turn"], CONV,
        "CAST(floor(80.0::DOUBLE / 100 * (0.5::DOUBLE * CAST(s.n AS DOUBLE) + t.half)) AS BIGINT)",
        SEED, ",\nt AS (SELECT 0.5::DOUBLE * CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS half FROM s)"),
    "nominal_index_psize": """
SELECT *, CASE WHEN p_size IS NULL THEN NULL
               ELSE CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) END AS p_size_code
FROM part""",
    "code_counts_psize": """
WITH c AS (SELECT CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) AS p_size_code FROM part
           WHERE p_size IS NOT NULL),
k AS (SELECT p_size_code, count(*) AS n FROM c GROUP BY p_size_code)
SELECT CAST(r.range AS INTEGER) AS p_size_code, coalesce(k.n, 0) AS n
FROM range(64) r LEFT JOIN k ON k.p_size_code = r.range""",
    "feature_stats_lineitem": _feature_stats_sql(),
    "knn_cosine": _knn_sql("cosine"),
    "knn_euclidean": _knn_sql("euclidean"),
    "smote_embeddings": _smote_sql(),
    "smote_embeddings_euclidean": _smote_sql("euclidean", k=4, rate=1.0, ratio=0.9, seed=7),
    "smote_percent": _smote_percent_sql(),
    "compare_oversample": """
WITH s AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
m AS (SELECT max(n) AS mx FROM s),
b AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT b.lang, b.n AS n_before, CASE WHEN b.lang IS NULL THEN 0 ELSE m.mx END AS n_after,
       CASE WHEN b.lang IS NULL THEN 0 ELSE m.mx END - b.n AS delta
FROM b, m""",
    "parse_vectors": """
SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(i AS INTEGER) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS value
FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS i FROM embeddings) q""",
    "vector_functions": _vector_functions_sql(),
    "oversample_orders_priority": oracle.oversample("orders", "o_orderpriority", ["o_orderkey"], ORDERS),
    "undersample_spread_orders_status": oracle.undersample_spread(
        "orders", "o_orderstatus", ["o_orderkey"], ORDERS, 1.0),
    "sample_exact_events_type": oracle.sample_exact("events", "event_type", ["event_id"], EVENTS, 1500),
    "sample_bernoulli_documents":
        f"SELECT * FROM documents WHERE {sql_uniform01(7, ['doc_id'])} < 0.3::DOUBLE",
    "resample_uniform_segment": oracle.draws_join(
        "customer", "c_mktsegment", ["c_custkey"], CUSTOMER,
        "CAST(floor(50.0::DOUBLE / 100 * (1.0::DOUBLE * CAST(s.n AS DOUBLE) + t.u)) AS BIGINT)",
        SEED, ",\nt AS (SELECT 0.0::DOUBLE * CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS u FROM s)"),
    "resampling_report_segment": """
WITH c AS (SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS class_code
           FROM customer WHERE c_mktsegment IS NOT NULL),
s AS (SELECT class_code, count(*) AS n FROM c GROUP BY class_code),
t AS (SELECT min(n) AS mn, CAST(sum(n) AS DOUBLE) AS tot, CAST(count(*) AS DOUBLE) AS k,
             ceil(CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100.0::DOUBLE * CAST(count(*) AS DOUBLE)
                  * 10.0::DOUBLE) / 10.0::DOUBLE AS pct FROM s),
mi AS (SELECT class_code AS mcode FROM s ORDER BY n, class_code LIMIT 1)
SELECT 'original' AS step, class_code, n FROM s
UNION ALL
SELECT 'spread_subsample', class_code, least(n, CAST(floor(1.0::DOUBLE * mn) AS BIGINT)) FROM s, t
UNION ALL
SELECT 'smote', class_code, n + CASE WHEN class_code = mcode AND n >= 2 THEN n ELSE 0 END FROM s, mi
UNION ALL
SELECT 'resample', class_code,
       CAST(floor(pct / 100.0::DOUBLE * (0.0::DOUBLE * CAST(n AS DOUBLE) + 1.0::DOUBLE * tot / k)) AS BIGINT)
FROM s, t""",
}

ORACLE |= {name: ORACLE[name.rsplit("_", 1)[0]] for name in (
    "oversample_lineitem_bucketed", "sample_exact_lineitem_bucketed", "undersample_spread_lang_bucketed",
    "sample_replace_lang_bucketed", "resample_uniform_quality_bucketed", "knn_cosine_tiled")}
ORACLE["nominal_index_distributed"] = ORACLE["nominal_index_psize"]
ORACLE["class_rows_german"] = "SELECT * FROM documents WHERE lang = 'de'"
ORACLE |= {
    "knn_cosine_pruned": ORACLE["knn_cosine"],
    "text_lines": """
SELECT doc_id, CAST(i AS INTEGER) AS line_no, lines[i] AS value
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
  SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines
  FROM documents WHERE text IS NOT NULL) q) r
WHERE trim(lines[i], ' ') <> ''""",
    "csv_strings_customer": """
SELECT c_mktsegment AS _c4, count(*) AS n FROM customer GROUP BY c_mktsegment""",
    "csv_typed_orders": """
SELECT o_orderkey, o_orderkey AS key, CAST(o_custkey AS INTEGER) AS customer,
       CASE WHEN o_custkey % 10 = 7 THEN NULL ELSE o_totalprice END AS price,
       o_orderpriority AS priority, o_custkey % 10 = 7 AS is_bad FROM orders""",
    "csv_header_customer": """
SELECT c_nationkey, c_custkey, c_name, c_nationkey AS nation, c_acctbal, c_mktsegment FROM customer""",
    "csv_repeated_supplier": "SELECT s_nationkey, 3 * count(*) AS n FROM supplier GROUP BY s_nationkey",
    "sparse_interpolation": """
WITH s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v
           FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings) q
           WHERE embedding[i + 1] > 0),
p AS (SELECT a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
x AS (SELECT s.* FROM s JOIN p USING (vec_id)),
y AS (SELECT p.vec_id, s.i, s.v FROM p JOIN s ON s.vec_id = p.vec_id + 1)
SELECT coalesce(x.vec_id, y.vec_id) AS vec_id, CAST(coalesce(x.i, y.i) AS INTEGER) AS dim,
       coalesce(x.v, 0::DOUBLE) + 0.25::DOUBLE * (coalesce(y.v, 0::DOUBLE) - coalesce(x.v, 0::DOUBLE)) AS value
FROM x FULL OUTER JOIN y ON x.vec_id = y.vec_id AND x.i = y.i""",
}
