"""DuckDB oracles for the classification plans (nearest-centroid helper as the model)."""

from __future__ import annotations

from .ml import FOLDS, MODEL_FEATURES, SECOND_ROWS, SECOND_SEED, SEED, TOP_K
from .oracle import feature_sql

F = MODEL_FEATURES


def _base() -> str:
    names = ["syllable_count" if f == "syll_count" else f for f in F]
    feats = feature_sql(names, rounded=False)
    cols = ", ".join(f'"{n}" AS "{f}"' for n, f in zip(names, F))
    notnull = " AND ".join(f'"{f}" IS NOT NULL' for f in F)
    return f"""base AS (
  SELECT doc_id, prof_level, text_type, {cols} FROM ({feats}) WHERE TRUE),
lab AS (SELECT * FROM base WHERE {notnull})"""


def _splits() -> str:
    return _base() + f""",
quota AS (
  SELECT prof_level, CAST(floor(30 / (count(DISTINCT text_type)
         + max(CASE WHEN text_type IS NULL THEN 1 ELSE 0 END))) AS INTEGER) AS per
  FROM lab GROUP BY prof_level),
strat AS (
  SELECT l.* FROM (
    SELECT *, row_number() OVER (PARTITION BY prof_level, text_type
                                 ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
    FROM lab WHERE prof_level IN ('A2', 'B1', 'B2') AND text_type IS NOT NULL) l
  JOIN quota q USING (prof_level) WHERE l.rn <= q.per),
simp AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY prof_level
                                 ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
    FROM lab WHERE prof_level IN ('C1')) WHERE rn <= 30),
test AS (SELECT * EXCLUDE (rn) FROM strat UNION ALL SELECT * EXCLUDE (rn) FROM simp),
train AS (SELECT * FROM lab WHERE doc_id NOT IN (SELECT doc_id FROM test))"""


def _second_splits() -> str:
    """The second validation set as `test`, what is left of the train rows as `train`."""
    return _splits().replace("train AS (", "train1 AS (") + f""",
quota2 AS (
  SELECT prof_level, CAST(floor({SECOND_ROWS} / (count(DISTINCT text_type)
         + max(CASE WHEN text_type IS NULL THEN 1 ELSE 0 END))) AS INTEGER) AS per
  FROM train1 GROUP BY prof_level),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY prof_level, text_type ORDER BY md5('{SECOND_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS of_type,
         row_number() OVER (PARTITION BY prof_level ORDER BY md5('{SECOND_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS of_level
  FROM train1),
second AS (
  SELECT d.* EXCLUDE (of_type, of_level) FROM drawn d JOIN quota2 q USING (prof_level)
  WHERE (prof_level IN ('A2', 'B2') AND text_type IS NOT NULL AND of_type <= q.per)
     OR (prof_level IN ('B1', 'C1') AND of_level <= {SECOND_ROWS})),
rest AS (SELECT * FROM train1 WHERE doc_id NOT IN (SELECT doc_id FROM second))"""


def _scaled(splits: str | None = None, train: str = "train", test: str = "test") -> str:
    params = ", ".join(f'avg("{f}") AS "m_{f}", coalesce(nullif(stddev_pop("{f}"), 0), 1.0) AS "s_{f}"'
                       for f in F)
    sc = ", ".join(f'("{f}" - "m_{f}") / "s_{f}" AS "{f}"' for f in F)
    return (splits or _splits()) + f""",
params AS (SELECT {params} FROM {train}),
train_s AS (SELECT doc_id, prof_level, text_type, {sc} FROM {train}, params),
test_s AS (SELECT doc_id, prof_level, text_type, {sc} FROM {test}, params)"""


def _anova(src: str = "train_s") -> str:
    parts = []
    for f in F:
        parts.append(f"""SELECT '{f}' AS feature,
      ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1))
      / nullif((sum(q) - sum(s * s / n)) / (sum(n) - count(*)), 0) AS f_score
    FROM (SELECT prof_level, count(*) AS n, sum("{f}") AS s, sum("{f}" * "{f}") AS q
          FROM {src} GROUP BY prof_level)""")
    return ",\nanova AS (\n  " + "\n  UNION ALL ".join(parts) + ")," + f"""
ranked AS (SELECT feature, f_score, row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS rank
           FROM anova),
sel AS (SELECT * FROM ranked WHERE rank <= {TOP_K})"""


def _centroid_predict(train: str, rows: str, out: str, part: str | None = None,
                      selected: bool = True, row_key: str = "doc_id") -> str:
    """Nearest centroid: centroids from `train` (per `part` value if given), distances over
    the selected features (or all), arg-min with ties to the smaller label."""
    w = (lambda f: f"(SELECT count(*) FROM sel WHERE feature = '{f}')") if selected else (lambda f: "1")
    mus = ", ".join(f'avg("{f}") AS "mu_{f}"' for f in F)
    dist = " + ".join(f'{w(f)} * (r."{f}" - c."mu_{f}") * (r."{f}" - c."mu_{f}")' for f in F)
    if part is None:
        cents = f"SELECT prof_level AS cls, {mus} FROM {train} GROUP BY prof_level"
        join = f"FROM {rows} r, ({cents}) c"
        pk = f"r.{row_key}"
    else:
        cents = f"SELECT {part} AS cpart, prof_level AS cls, {mus} FROM {train} GROUP BY {part}, prof_level"
        join = f"FROM {rows} r JOIN ({cents}) c ON r.{part} = c.cpart"
        pk = f"r.{row_key}"
    return f""",
{out} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT r.*, c.cls AS prediction,
           row_number() OVER (PARTITION BY {pk} ORDER BY {dist}, c.cls) AS rn
    {join}) WHERE rn = 1)"""


def test_split_sql() -> str:
    return f"WITH {_splits()}\nSELECT doc_id, prof_level, text_type FROM test"


def train_split_sql() -> str:
    return f"WITH {_splits()}\nSELECT doc_id, prof_level, text_type FROM train"


def shuffle_sql() -> str:
    return (f"WITH {_splits()}\nSELECT doc_id, prof_level, text_type, "
            f"md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM train")


def folds_sql() -> str:
    return f"""WITH {_splits()}
SELECT doc_id, prof_level, CAST((row_number() OVER (PARTITION BY prof_level
         ORDER BY md5('{SEED}:fold:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {FOLDS} AS INTEGER) AS fold
FROM train"""


def standardized_sql() -> str:
    cols = ", ".join(f'round("{f}", 6) AS "{f}"' for f in F)
    return f"""WITH {_scaled()}
SELECT doc_id, 'train' AS split, {cols} FROM train_s
UNION ALL SELECT doc_id, 'test' AS split, {cols} FROM test_s"""


def anova_sql() -> str:
    return f"WITH {_scaled()}{_anova()}\nSELECT feature, round(f_score, 6) AS f_score FROM anova"


def kbest_sql() -> str:
    return f"WITH {_scaled()}{_anova()}\nSELECT feature, round(f_score, 6) AS f_score, CAST(rank AS INTEGER) AS rank FROM sel"


def _pred() -> str:
    return (_scaled() + _anova() + _centroid_predict("train_s", "test_s", "ptest")
            + _centroid_predict("train_s", "train_s", "ptrain"))


def predictions_sql() -> str:
    return f"""WITH {_pred()}
SELECT doc_id, prof_level AS label, prediction, text_type FROM ptest"""


def accuracy_sql() -> str:
    return f"""WITH {_pred()}
SELECT 'test' AS split, round(avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n FROM ptest
UNION ALL
SELECT 'train' AS split, round(avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n FROM ptrain"""


def recall_by_type_sql() -> str:
    return f"""WITH {_pred()}
SELECT prof_level, text_type, round(avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END), 6) AS recall,
       count(*) AS n FROM ptest GROUP BY prof_level, text_type"""


def balanced_accuracy_sql() -> str:
    return f"""WITH {_pred()}
SELECT round(avg(r), 6) AS balanced_accuracy FROM (
  SELECT prof_level, avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END) AS r
  FROM ptest GROUP BY prof_level)"""


def confusion_sql() -> str:
    return f"""WITH {_pred()}
SELECT prof_level AS label, prediction, count(*) AS n FROM ptest GROUP BY 1, 2"""


def _prf_cte(src: str, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    return f""",
pc AS (
  SELECT {byc}cls, sum(h) AS tp, sum(t) AS support, sum(p) AS predicted FROM (
    SELECT {byc}prof_level AS cls, 1 AS t, CASE WHEN prof_level = prediction THEN 1 ELSE 0 END AS h, 0 AS p FROM {src}
    UNION ALL SELECT {byc}prediction AS cls, 0, 0, 1 FROM {src}) GROUP BY {byc}cls),
prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (SELECT {byc}cls, support,
          CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc))"""


def report_sql() -> str:
    return f"""WITH {_pred()}{_prf_cte("ptest")}
SELECT cls AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS DOUBLE) AS support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END), 6),
       CAST(count(*) AS DOUBLE) FROM ptest
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS DOUBLE) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS DOUBLE) FROM prf"""


def _oof() -> str:
    return f"""{_grid([TOP_K])},
oof AS (
  SELECT doc_id, prof_level, fold, cls AS prediction FROM far
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cls) = 1)"""


def oof_sql() -> str:
    return f"""WITH {_oof()}
SELECT doc_id, prof_level AS label, prediction, fold FROM oof"""


def cv_scores_sql() -> str:
    return f"""WITH {_oof()}
SELECT round(avg(acc), 6) AS mean_accuracy, round(stddev_pop(acc), 6) AS sd_accuracy, count(*) AS folds
FROM (SELECT fold, avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END) AS acc FROM oof GROUP BY fold)"""


def macro_prf_sql() -> str:
    return f"""WITH {_oof()}{_prf_cte("oof", "fold")}
SELECT round(avg(f), 6) AS f1_mean, round(stddev_pop(f), 6) AS f1_sd,
       round(avg(p), 6) AS precision_mean, round(stddev_pop(p), 6) AS precision_sd,
       round(avg(r), 6) AS recall_mean, round(stddev_pop(r), 6) AS recall_sd
FROM (SELECT fold, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM prf GROUP BY fold)"""


def importance_sql(n_repeats: int = 10, second: bool = False) -> str:
    from ..constants import DISPLAY_NAMES
    feats = ", ".join(f"('{f}')" for f in F)
    value = "CASE feature " + " ".join(f"WHEN '{f}' THEN \"{f}\"" for f in F) + " END"
    swapped = ", ".join(f"CASE WHEN g.feature = '{f}' THEN d.v ELSE g.\"{f}\" END AS \"{f}\"" for f in F)
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY_NAMES.items())
    scaled = _scaled(_second_splits(), "rest", "second") if second else _scaled()
    hit = "CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END"
    by_class = ", prof_level" if second else ""
    return f"""WITH {scaled},
fr AS (SELECT feature, rep FROM (VALUES {feats}) t(feature), range(0, {n_repeats}) r(rep)),
based AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM test_s),
grid AS (SELECT b.*, fr.feature, fr.rep FROM based b, fr),
donors AS (
  SELECT feature, rep, {value} AS v,
         row_number() OVER (PARTITION BY feature, rep
           ORDER BY md5('{SEED}:' || CAST(rep AS VARCHAR) || ':' || feature || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS prn
  FROM grid),
swapped AS (
  SELECT g.doc_id, g.prof_level, g.text_type, g.feature AS pf, g.rep, {swapped}
  FROM grid g JOIN donors d ON g.feature = d.feature AND g.rep = d.rep AND g.rn = d.prn),
perm_rows AS (SELECT doc_id || ':' || pf || ':' || CAST(rep AS VARCHAR) AS doc_key, * FROM swapped)
{_centroid_predict("train_s", "test_s", "pbase", selected=False)}
{_centroid_predict("train_s", "perm_rows", "pperm", selected=False, row_key="doc_key")},
base_score AS (SELECT avg(h) AS b FROM (SELECT avg({hit}) AS h FROM pbase{" GROUP BY prof_level" if second else ""})),
scores AS (SELECT feature, rep, avg(h) AS s FROM (SELECT pf AS feature, rep{by_class}, avg({hit}) AS h FROM pperm GROUP BY pf, rep{by_class}) GROUP BY feature, rep),
imp AS (SELECT feature, avg(b - s) AS m, stddev_pop(b - s) AS sd FROM scores, base_score GROUP BY feature)
SELECT feature, round(m, 6) AS importance_mean, round(sd, 6) AS importance_sd,
       CAST(row_number() OVER (ORDER BY round(m, 12), feature) AS INTEGER) AS rank,
       CASE feature {names} ELSE feature END AS display_name
FROM imp"""


def discriminants_sql(feature: str = "lemma_count") -> str:
    return f"""WITH {_scaled()},
st AS (SELECT prof_level AS cls, count(*) AS n, avg("{feature}") AS mu, var_pop("{feature}") * count(*) AS ss FROM train_s GROUP BY 1),
alln AS (SELECT sum(n) AS total, sum(ss) / (sum(n) - count(*)) AS v FROM st),
scores AS (
  SELECT t.doc_id, t.prof_level, s.cls, t."{feature}" * s.mu / v - s.mu * s.mu / (2 * v) + ln(s.n / total) AS lin,
         -0.5 * (t."{feature}" - s.mu) * (t."{feature}" - s.mu) / (s.ss / (s.n - 1)) - 0.5 * ln(s.ss / (s.n - 1)) + ln(s.n / total) AS quad
  FROM test_s t, st s, alln)
SELECT doc_id, prof_level AS label,
  (SELECT cls FROM scores x WHERE x.doc_id = t.doc_id ORDER BY lin DESC, cls LIMIT 1) AS lda,
  (SELECT cls FROM scores x WHERE x.doc_id = t.doc_id ORDER BY quad DESC, cls LIMIT 1) AS qda
FROM test_s t"""


def _grid(sizes: list[int]) -> str:
    """Scaling, ANOVA ranking and class means of all rows but those of a fold, for each fold."""
    long = " UNION ALL ".join(f"""SELECT doc_id, prof_level, fold, '{f}' AS feature, CAST("{f}" AS DOUBLE) AS x FROM folded""" for f in F)
    return f"""{_splits()},
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY prof_level
           ORDER BY md5('{SEED}:fold:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM train),
long AS MATERIALIZED ({long}),
left_out AS (SELECT unnest(range({FOLDS})) AS k),
cls AS MATERIALIZED (
  SELECT k, feature, prof_level AS cls, count(*) AS n, avg(x) AS mu, var_pop(x) * count(*) AS ss FROM long JOIN left_out ON fold <> k GROUP BY ALL),
whole AS (SELECT k, feature, sum(n) AS total, count(*) AS classes, sum(n * mu) / sum(n) AS m FROM cls GROUP BY ALL),
spread AS (
  SELECT c.k, c.feature, any_value(total) AS total, any_value(classes) AS classes, sum(c.n * (c.mu - m) * (c.mu - m)) AS between_ss, sum(c.ss) AS within_ss
  FROM cls c JOIN whole w ON w.k = c.k AND w.feature = c.feature GROUP BY ALL),
ranked AS (
  SELECT k, feature, coalesce(nullif((between_ss + within_ss) / total, 0), 1.0) AS variance,
         row_number() OVER (PARTITION BY k ORDER BY (between_ss / (classes - 1)) / nullif(within_ss / (total - classes), 0) DESC NULLS LAST, feature) AS r
  FROM spread),
sizes AS (SELECT unnest({sizes}) AS n_features),
far AS (
  SELECT l.doc_id, l.prof_level, l.fold, n_features, c.cls, sum((l.x - c.mu) * (l.x - c.mu) / variance) AS distance
  FROM long l JOIN ranked k ON k.k = l.fold AND k.feature = l.feature JOIN sizes ON r <= n_features
  JOIN cls c ON c.k = l.fold AND c.feature = l.feature GROUP BY ALL)"""


def grid_sql(sizes: list[int]) -> str:
    return f"""WITH {_grid(sizes)},
oof AS (
  SELECT prof_level, fold * 1000 + n_features AS cell, cls AS prediction FROM far
  QUALIFY row_number() OVER (PARTITION BY doc_id, n_features ORDER BY distance, cls) = 1){_prf_cte("oof", "cell")},
acc AS (SELECT cell, avg(CASE WHEN prof_level = prediction THEN 1.0 ELSE 0.0 END) AS a FROM oof GROUP BY 1),
macro AS (SELECT cell, avg(f1) AS f, avg(precision) AS p, avg(recall) AS r FROM prf GROUP BY 1)
SELECT 'nearest_centroid' AS model, CAST(cell % 1000 AS INTEGER) AS n_features, round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS sd_accuracy,
  round(avg(f), 6) AS f1_mean, round(stddev_pop(f), 6) AS f1_sd, round(avg(p), 6) AS precision_mean, round(stddev_pop(p), 6) AS precision_sd,
  round(avg(r), 6) AS recall_mean, round(stddev_pop(r), 6) AS recall_sd
FROM acc JOIN macro USING (cell) GROUP BY cell % 1000"""
