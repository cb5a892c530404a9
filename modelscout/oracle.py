"""The same results in SQL for DuckDB, written independently of the Spark code."""
from __future__ import annotations

# Fixed catalogue: algo_id, impl_type, algo_type, algo_name.
CATALOGUE = [
    (0, 0, 1, "Lasso Logistic Regression"),
    (1, 0, 2, "Random Forest"),
    (2, 0, 2, "Gradient Boosting"),
    (3, 0, 2, "Boosted Trees (leaf by leaf)"),
    (4, 0, 1, "Logistic Regression"),
    (5, 0, 1, "Ridge Logistic Regression"),
    (6, 1, 1, "Lasso Logistic Regression"),
    (7, 1, 1, "Ridge Logistic Regression"),
    (8, 1, 2, "Random Forest"),
    (9, 1, 2, "Gradient Boosting"),
]
SHAP_WEIGHTS = {"l_quantity": 0.02, "l_discount": 1.5, "l_tax": -2.0}
WA, WB = "0.02", "-0.0001"

GAPPY_LINEITEM = """gappy AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount,
         CASE WHEN l_suppkey % 11 <> 0 THEN l_tax END AS l_tax,
         CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""
GAPPY_PART = """gappy AS (
  SELECT p_partkey, p_brand, CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS DOUBLE) AS p_size,
         CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS p_retailprice,
         CAST(CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 37 % 101 END AS DOUBLE) AS p_weight
  FROM part)"""
SCORED = """scored AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_discount * 10 AS score,
         CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM lineitem)"""
COUNTS = SCORED + """, c AS (
  SELECT CAST(count(*) FILTER (y = 1 AND prediction = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (y = 0 AND prediction = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (y = 0 AND prediction = 0) AS DOUBLE) AS tn,
         CAST(count(*) FILTER (y = 1 AND prediction = 0) AS DOUBLE) AS fn
  FROM scored)"""
DETAIL = """detail AS (
  SELECT o_orderkey AS id, o_custkey AS experiment_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 + CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END AS algo_id,
         round(o_totalprice / 1000000, 6) AS auc, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS precision,
         CAST(o_orderkey % 10 AS DOUBLE) / 10 AS recall, CAST(o_custkey % 100 AS DOUBLE) / 100 AS accuracy
  FROM orders)"""
ALGO = "algo(algo_id, impl_type, algo_type, algo_name) AS (VALUES " + ", ".join(
    f"({r[0]}, {r[1]}, {r[2]}, '{r[3]}')" for r in CATALOGUE
) + ")"

LINEITEM = [
    ("l_orderkey", 1), ("l_partkey", 1), ("l_suppkey", 1), ("l_linenumber", 1), ("l_quantity", 1),
    ("l_extendedprice", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 2), ("l_linestatus", 2), ("l_shipdate", 2),
]
CUSTOMER = [("c_custkey", 1), ("c_name", 2), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 2)]
DOCUMENTS = [("doc_id", 1), ("text", 2), ("lang", 2), ("source", 2), ("n_chars", 1)]
LABELS = [("doc_id", 1), ("quality", 1), ("toxic", 1)]


def summary_sql(source: str, cols: list[tuple[str, int]]) -> str:
    """One SELECT per column, in the layout of the column summary."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        if kind == 1:
            stats = (
                f"avg({c}) AS ds_mean, stddev_samp({c}) AS ds_std, CAST(min({c}) AS DOUBLE) AS ds_min, "
                + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {n}" for p, n in
                            ((0.25, "ds_25"), (0.5, "ds_50"), (0.75, "ds_75")))
                + f", CAST(max({c}) AS DOUBLE) AS ds_max"
            )
        else:
            stats = ", ".join(
                f"CAST(NULL AS DOUBLE) AS {n}" for n in ("ds_mean", "ds_std", "ds_min", "ds_25", "ds_50", "ds_75", "ds_max")
            )
        parts.append(
            f"SELECT {i} AS var_id, '{c}' AS var_name, {kind} AS var_type, count({c}) AS ds_count, "
            f"count(DISTINCT {c}) AS ds_unique, {stats} FROM {source}"
        )
    return "\nUNION ALL ".join(parts)


STATS = ("ds_mean", "ds_std", "ds_min", "ds_25", "ds_50", "ds_75", "ds_max")
ROUNDED_STATS = ", ".join(f"round({n}, 4) AS {n}" for n in STATS)


def per_column(source: str, cols: list[tuple[str, int]], expr: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {i} AS var_id, '{c}' AS var_name, {expr.format(c=c)} FROM {source}" for i, (c, _) in enumerate(cols)
    )


def notes_sql(source: str, cols: list[tuple[str, int]]) -> str:
    return f"""SELECT var_id, var_name, n - ds_count AS missing,
      concat_ws(', ', CASE WHEN n > ds_count THEN 'missing values(' || (n - ds_count) || ')' END,
                CASE WHEN var_type = 2 AND ds_unique > ds_count / 2.0 THEN 'too many unique' END) AS quality
    FROM ({summary_sql(source, cols)}) s, (SELECT count(*) AS n FROM {source}) r"""


def roles_sql(source: str, cols: list[tuple[str, int]]) -> str:
    return f"""SELECT var_id, var_name, CASE WHEN ds_unique = 2 THEN 1 ELSE 0 END AS target_candidate,
      CASE WHEN var_type = 2 THEN 1 ELSE 0 END AS category,
      CASE WHEN var_type = 2 AND ds_unique > ds_count / 2.0 THEN 1 ELSE 0 END AS unused
    FROM ({summary_sql(source, cols)}) s"""


def flag_sql(threshold: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_extendedprice,
      CASE WHEN l_extendedprice >= t THEN 1 ELSE 0 END AS flag FROM lineitem, (SELECT {threshold} AS t FROM lineitem) q"""


def auc_sql(source: str, y: str, score: str) -> str:
    return f"""(SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM (
        SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {score} AS s, CAST(count(*) FILTER ({y} = 1) AS DOUBLE) AS pos,
                     CAST(count(*) FILTER ({y} = 0) AS DOUBLE) AS neg FROM {source} GROUP BY 1) g) w)"""


def bucket(key: str) -> str:
    return f"substr(md5({key} || ':4000'), 1, 4)"


LINE_BUCKET = bucket("l_orderkey || ':' || l_partkey || ':' || l_linenumber")
PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SHOWN = {"ds_mean": "mean", "ds_std": "std", "ds_min": "min", "ds_25": "q25", "ds_50": "q50", "ds_75": "q75", "ds_max": "max"}


def knn_sql(cols: list[str]) -> str:
    d = len(cols)
    ok = [f"(r.{c} IS NOT NULL AND t.{c} IS NOT NULL)" for c in cols]
    shared = " + ".join(f"CAST({o} AS INTEGER)" for o in ok)
    total = " + ".join(f"CASE WHEN {o} THEN (r.{c} - t.{c}) * (r.{c} - t.{c}) ELSE 0.0 END" for c, o in zip(cols, ok))
    fills = []
    for c in cols:
        fills.append(f"""{c}_fill AS (SELECT k, avg(v) AS v FROM (
          SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY dist, v) AS rn FROM (
            SELECT r.p_partkey AS k, t.{c} AS v, {shared} AS shared, CAST({d} AS DOUBLE) / ({shared}) * ({total}) AS dist
            FROM gappy r, donors t WHERE r.{c} IS NULL AND t.{c} IS NOT NULL AND ({shared}) > 0) p) q
          WHERE rn <= 2 GROUP BY k)""")
    out = ", ".join(
        f"round(coalesce(g.{c}, {c}_fill.v, (SELECT avg({c}) FROM donors)), 4) AS {c}" for c in cols
    )
    joins = " ".join(f"LEFT JOIN {c}_fill ON {c}_fill.k = g.p_partkey" for c in cols)
    return f"""WITH {GAPPY_PART}, donors AS (SELECT * FROM gappy WHERE {bucket('p_partkey')} < 'cccc'),
      {', '.join(fills)} SELECT g.p_partkey, {out} FROM gappy g {joins}"""


ORACLE = {
    "csv_round_trip": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "tsv_round_trip": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "csv_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "csv_documents_one_file": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "tsv_conversations": "SELECT conv_id, turn, role, text FROM conversations",
    "import_documents": f"""SELECT var_id, var_name, var_type, ds_count, ds_unique, {ROUNDED_STATS}
      FROM ({summary_sql('documents', DOCUMENTS)}) s""",
    "parquet_round_trip": "SELECT * FROM lineitem",
    "import_dataset": f"""SELECT var_id, var_name, var_type, ds_count, ds_unique, {ROUNDED_STATS},
      'customer' AS dataset_name, (SELECT count(*) FROM customer) AS row_number, 5 AS column_number
      FROM ({summary_sql('customer', CUSTOMER)}) s""",
    "append_to_dataset": f"""SELECT var_id, var_name, var_type, ds_count, ds_mean, ds_std, ds_min, ds_max,
      (SELECT count(*) FROM customer) AS row_number
      FROM (SELECT var_id, var_name, var_type, ds_count, {ROUNDED_STATS} FROM ({summary_sql('customer', CUSTOMER)}) s) t""",
    "result_store_round_trip": f"""WITH {DETAIL} SELECT id, experiment_id, algo_id, auc, precision, recall, accuracy
      FROM detail WHERE experiment_id IN (SELECT c_custkey FROM customer)""",
    "metadata_filter": """SELECT c_custkey AS id, c_name AS experiment_name, c_mktsegment AS target_name,
      'c_acctbal, ' || c_mktsegment AS features, CAST(c_nationkey AS BIGINT) AS dataset_id
      FROM customer WHERE c_nationkey = 7""",
    "list_datasets": """SELECT CAST(c_nationkey AS BIGINT) AS id, 'customers of nation ' || c_nationkey AS dataset_name,
      c_nationkey % 2 AS stored, count(*) AS row_number, 5 AS column_number FROM customer GROUP BY c_nationkey""",
    "delete_dataset": """SELECT CAST(c_nationkey AS BIGINT) AS dataset_id,
      'customers of nation ' || c_nationkey AS dataset_name, count(*) AS runs
      FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey""",
    "table_shape": "SELECT count(*) AS row_number, 11 AS column_number FROM lineitem",
    "profile_numeric": f"""WITH {GAPPY_LINEITEM} SELECT var_id, var_name, var_type, ds_count, ds_unique, {ROUNDED_STATS}
      FROM ({summary_sql('gappy', LINEITEM)}) s WHERE var_type = 1""",
    "profile_string": f"SELECT * FROM ({summary_sql('documents', DOCUMENTS)}) s WHERE var_type = 2",
    "top_value": f"WITH {GAPPY_LINEITEM} "
    + " UNION ALL ".join(
        f"""SELECT {i} AS var_id, '{c}' AS var_name, top, freq FROM (SELECT CAST({c} AS VARCHAR) AS top, count(*) AS freq,
        row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rn FROM gappy WHERE {c} IS NOT NULL
        GROUP BY {c}) t{i} WHERE rn = 1"""
        for i, c in ((3, "l_linenumber"), (8, "l_returnflag"), (9, "l_linestatus"))
    ),
    "distinct_counts": f"WITH {GAPPY_LINEITEM} " + per_column("gappy", LINEITEM, "count(DISTINCT {c}) AS ds_unique"),
    "distinct_counts_with_null": f"WITH {GAPPY_LINEITEM} "
    + per_column("gappy", LINEITEM, "count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS ds_unique"),
    "missing_counts": f"WITH {GAPPY_LINEITEM} " + per_column("gappy", LINEITEM, "count(*) - count({c}) AS missing"),
    "quality_report": f"WITH {GAPPY_LINEITEM} {notes_sql('gappy', LINEITEM)} UNION ALL {notes_sql('customer', CUSTOMER)}",
    "variable_summary": f"""SELECT var_id, var_name AS variable,
      CASE WHEN var_type = 1 THEN 'Numeric' ELSE 'String' END AS type,
      CASE WHEN var_type = 2 AND ds_unique > ds_count / 2.0 THEN 'too many unique' ELSE '' END AS quality,
      ds_count AS count, ds_unique AS unique,
      {', '.join(f"coalesce(CAST(CAST(round({c}, 4) AS DECIMAL(38,4)) AS VARCHAR), '-') AS {n}" for c, n in SHOWN.items())}
      FROM ({summary_sql('lineitem', LINEITEM)}) s""",
    "suggest_roles": " UNION ALL ".join(
        (roles_sql("lineitem", LINEITEM), roles_sql("customer", CUSTOMER), roles_sql("labels", LABELS))
    ),
    "value_counts": f"WITH {GAPPY_LINEITEM} SELECT l_returnflag AS value, count(*) AS n FROM gappy GROUP BY 1",
    "histogram_numeric": """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
      b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, (hi - lo) / 20 AS w
            FROM lineitem, e)
      SELECT bin, round(lo + w * bin, 4) AS lo, round(lo + w * (bin + 1), 4) AS hi, count(*) AS n FROM b GROUP BY bin, b.lo, w""",
    "box_stats": """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
        quantile_cont(value, 0.75) AS q3 FROM events)
      SELECT min(value) AS min, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, max(value) AS max,
        min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_fence,
        max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_fence,
        count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
      FROM events, q GROUP BY q1, q2, q3""",
    "preview": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sample_about": """SELECT event_id, value FROM events, (SELECT count(*) AS n FROM events) c
      WHERE n <= 1000 OR substr(md5(event_id || ':0'), 1, 8) <
        format('{:08x}', CAST(floor(CAST(1000 AS DOUBLE) / n * 4294967296) AS BIGINT))""",
    "grubbs_statistic": """SELECT event_type, n, round(mean, 4) AS mean, round(std, 4) AS std,
        CASE WHEN hi - mean > mean - lo THEN hi ELSE lo END AS furthest,
        round(greatest(hi - mean, mean - lo) / std, 4) AS g
      FROM (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo,
              max(value) AS hi FROM events GROUP BY event_type) s""",
    "select_features": """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
      'o_orderkey, o_totalprice, o_orderpriority' AS features, 'o_orderpriority' AS categories FROM orders""",
    "drop_sentinel": """SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders
      WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0""",
    "filter_between": "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "cast_columns": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
      TRY_CAST(regexp_replace(o_orderpriority, '-.*', '') AS INTEGER) AS rank,
      TRY_CAST(o_orderstatus AS INTEGER) AS o_orderstatus FROM orders""",
    "drop_incomplete": f"""WITH {GAPPY_PART} SELECT * FROM gappy
      WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL AND p_weight IS NOT NULL""",
    "flag_weighted_mean": flag_sql("sum(l_extendedprice * l_quantity) / sum(l_quantity)"),
    "flag_mean": flag_sql("avg(l_extendedprice)"),
    "flag_constant": flag_sql("sum(80000 * l_quantity) / sum(l_quantity)"),
    "weighted_mean": f"""WITH {GAPPY_LINEITEM} SELECT
      round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean,
      round(avg(l_extendedprice), 4) AS mean FROM gappy""",
    "left_join": """WITH l AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS l_partkey,
        l_orderkey, l_linenumber, l_quantity FROM lineitem)
      SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, p_brand, p_size FROM l LEFT JOIN part ON p_partkey = l_partkey""",
    "explode_delimited": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part",
    "train_test_split": f"""SELECT o_orderkey, CASE WHEN {bucket('o_orderkey')} < 'cccc' THEN 'train' ELSE 'test' END AS side
      FROM orders""",
    "one_hot": "SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"o_orderpriority_{p}\"" for p in PRIORITIES)
    + ", "
    + ", ".join(
        f"CASE WHEN o_orderkey % 6 <> 0 AND o_orderstatus = '{s}' THEN 1 ELSE 0 END AS status_{s}" for s in ("O", "P")
    )
    + " FROM orders",
    "one_hot_aligned": f"""WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation,
        CASE WHEN {bucket('s_suppkey')} < 'cccc' THEN 'train' ELSE 'test' END AS side FROM supplier),
      kept AS (SELECT nation FROM (SELECT side, nation, row_number() OVER (PARTITION BY side ORDER BY nation) AS r
                 FROM (SELECT DISTINCT side, nation FROM s) d) x WHERE r > 1 GROUP BY nation HAVING count(*) = 2)
      SELECT s_suppkey, side, 'nation_' || k.nation AS dummy, CASE WHEN s.nation = k.nation THEN 1 ELSE 0 END AS value
      FROM s, kept k""",
    "columns_to_impute": f"""WITH {GAPPY_LINEITEM} SELECT 'l_quantity' AS var_name, count(*) - count(l_quantity) AS missing
      FROM gappy UNION ALL SELECT 'l_tax', count(*) - count(l_tax) FROM gappy""",
    "knn_impute": knn_sql(["p_size", "p_retailprice", "p_weight"]),
    "prepare_features": f"""WITH o AS (SELECT o_custkey, o_orderstatus,
          CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label,
          CASE WHEN {bucket('o_orderkey')} < 'cccc' THEN 'train' ELSE 'test' END AS side FROM orders)
      SELECT o_custkey, round(coalesce(price, (SELECT avg(price) FROM o WHERE side = 'train')), 2) AS o_totalprice, label,
        CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P", side,
        'o_custkey, o_orderstatus, o_totalprice' AS features FROM o""",
    "derived_flags": """WITH items AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name, p_type AS kind
        FROM part WHERE p_type <> 'SMALL' AND p_size BETWEEN 10 AND 40),
      sales AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS l_partkey,
          max(l_extendedprice) AS price, sum(l_quantity) AS sold FROM lineitem GROUP BY 1),
      j AS (SELECT p_partkey, p_name, kind, price, sold FROM items JOIN sales ON l_partkey = p_partkey),
      t AS (SELECT sum(price * sold) / sum(sold) AS a, avg(sold) AS b, sum(80000 * sold) / sum(sold) AS c FROM j)
      SELECT p_partkey, p_name, kind, price, sold, CASE WHEN price >= a THEN 1 ELSE 0 END AS price_high,
        CASE WHEN sold >= b THEN 1 ELSE 0 END AS sold_high, CASE WHEN price >= c THEN 1 ELSE 0 END AS price_above
      FROM j, t""",
    "leaderboard_join": f"""WITH {DETAIL}, {ALGO} SELECT experiment_id, c_name AS experiment_name,
      CAST(c_nationkey AS BIGINT) AS dataset_id, d.algo_id, algo_name, auc
      FROM detail d JOIN customer ON c_custkey = experiment_id JOIN algo a ON a.algo_id = d.algo_id""",
    "best_model_per_experiment": f"""WITH {DETAIL}, {ALGO},
      best AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY auc DESC, algo_id, id) AS rn FROM detail)
      SELECT experiment_id AS id, c_name AS name, c_mktsegment AS target, 'c_acctbal, ' || c_mktsegment AS features,
        algo_name AS best_model, auc AS best_auc, precision, recall, accuracy
      FROM best b JOIN customer ON c_custkey = experiment_id JOIN algo a ON a.algo_id = b.algo_id WHERE rn = 1""",
    "experiment_table": f"""WITH {DETAIL}, {ALGO} SELECT experiment_id, id, algo_name AS model, auc, precision, recall, accuracy
      FROM detail d JOIN algo a ON a.algo_id = d.algo_id""",
    "algorithm_catalogue": f"""WITH {DETAIL}, {ALGO} SELECT a.algo_id, impl_type, algo_type, algo_name, count(*) AS runs
      FROM algo a JOIN detail d ON a.algo_id = d.algo_id GROUP BY 1, 2, 3, 4""",
    "shap_ranking": f"""WITH {DETAIL} SELECT id, 'auc' AS feature, auc AS shap FROM detail
      UNION ALL SELECT id, 'recall', recall FROM detail""",
    "confusion_counts": f"""WITH {COUNTS} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
      CAST(fn AS BIGINT) AS fn FROM c""",
    "binary_metrics": f"""WITH {COUNTS} SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
      round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""",
    "weighted_metrics": f"""WITH {COUNTS} SELECT
      round(((tp + fn) * tp / (tp + fp) + (tn + fp) * tn / (tn + fn)) / (tp + fp + tn + fn), 6) AS weighted_precision,
      round((tp + tn) / (tp + fp + tn + fn), 6) AS weighted_recall,
      round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c""",
    "auc_score": f"""WITH {SCORED}, lines AS (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_extendedprice
        FROM lineitem)
      SELECT round({auc_sql('scored', 'y', 'score')}, 6) AS auc, 'discount' AS score
      UNION ALL SELECT round({auc_sql('lines', 'y', 'l_extendedprice')}, 6), 'price'""",
    "auc_hard_label": f"WITH {COUNTS} SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc FROM c",
    "linear_shap_fixed_weights": f"WITH l AS (SELECT *, {LINE_BUCKET} < 'cccc' AS is_train FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round({abs(w)} * avg(abs({c} - mu)), 6) AS shap FROM l,
        (SELECT avg({c}) AS mu FROM l WHERE is_train) m WHERE NOT is_train"""
        for c, w in SHAP_WEIGHTS.items()
    ),
    "score_fixed_weights": """WITH z AS (SELECT *, -0.3::DOUBLE + 0.02::DOUBLE * l_quantity + 1.5::DOUBLE * l_discount + -2.0::DOUBLE * l_tax AS z FROM lineitem)
      SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN z > 0 THEN 1 ELSE 0 END AS prediction,
        round(1 / (1 + exp(-z)), 6) AS score FROM z""",
    # of two features, each is expected from the other one by a straight line
    "linear_shap_correlated_fixed_weights": f"""WITH l AS (SELECT l_quantity AS a, l_extendedprice AS b, {LINE_BUCKET} < 'cccc' AS is_train FROM lineitem),
      m AS (SELECT avg(a) AS ma, avg(b) AS mb, covar_pop(a, b) / var_pop(a) AS ba, covar_pop(a, b) / var_pop(b) AS ab FROM l WHERE is_train),
      x AS (SELECT a - ma AS a, b - mb AS b, ba, ab FROM l, m WHERE NOT is_train),
      v AS (SELECT ({WA} + ({WB}) * ba) * a AS only_a, (({WB}) + {WA} * ab) * b AS only_b, {WA} * a + ({WB}) * b AS both_ FROM x)
      SELECT 'l_quantity' AS feature, round(avg(abs((only_a + both_ - only_b) / 2)), 6) AS shap FROM v
      UNION ALL SELECT 'l_extendedprice', round(avg(abs((only_b + both_ - only_a) / 2)), 6) FROM v""",
    "linear_values_fixed_weights": f"WITH l AS (SELECT *, {LINE_BUCKET} < 'cccc' AS is_train FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT l_orderkey, l_partkey, l_linenumber, '{c}' AS feature, round({w} * ({c} - mu), 6) AS value FROM l,
        (SELECT avg({c}) AS mu FROM l WHERE is_train) m WHERE NOT is_train"""
        for c, w in SHAP_WEIGHTS.items()
    ),
}
