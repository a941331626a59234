"""The same queries in ANSI SQL, written independently of the operators."""

from __future__ import annotations

from ..sources.fixtures import (
    CATEGORICAL,
    DRUG_GROUPS,
    EXCLUDED_SITES,
    EXTERNAL_SITES,
    EXTRACTION_OVERRIDES,
    INTRODUCTION_YEARS,
    NUMERIC,
)

SQL: dict[str, str] = {}


def quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


VISITS = """visits AS (
  SELECT o_orderkey AS visit_id, o_custkey AS ID, o_orderstatus AS ttt_course,
         CAST(o_orderdate AS DATE) AS Visit_date,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 10000.0 END AS CDAI,
         MIN(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey, o_orderstatus) AS ttt_startDate,
         ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderstatus
                            ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS visit_order,
         o_totalprice, o_orderpriority
  FROM orders),
bounds AS (
  SELECT *, CAST(ttt_startDate + INTERVAL 6 MONTH AS DATE) AS lo0, CAST(ttt_startDate + INTERVAL 24 MONTH AS DATE) AS hi0
  FROM visits),
windowed AS (
  SELECT *, CASE WHEN day(lo0) = day(ttt_startDate) THEN lo0 END AS lo,
            CASE WHEN day(hi0) = day(ttt_startDate) THEN hi0 END AS hi
  FROM bounds)"""

OUTCOME = VISITS + """,
outcome AS (
  SELECT ID, ttt_course, CAST(MAX(CASE WHEN CDAI <= 2.8 THEN 1 ELSE 0 END) AS BIGINT) AS has_remission_cdai
  FROM windowed
  WHERE visit_order > 1 AND Visit_date >= lo AND Visit_date <= hi AND CDAI IS NOT NULL
  GROUP BY ID, ttt_course ORDER BY ID, ttt_course)"""

# The sorts keep the checking engine from passing dictionary vectors from a window into a
# join, which fails there now and then; they do not change the rows.
BASELINE_ROWS = """,
baseline AS (
  SELECT v.visit_id, v.ID, v.ttt_course, v.Visit_date, v.ttt_startDate, v.CDAI AS CDAI0, v.o_totalprice, v.o_orderpriority,
         CASE WHEN v.ID % 17 = 0 THEN NULL ELSE v.ID END AS ID_original,
         CASE WHEN v.ID % 101 = 0 THEN NULL ELSE n_name END AS Code,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'other' ELSE 'ra' END AS disease, c_mktsegment AS segment,
         CAST(year(v.ttt_startDate) AS BIGINT) AS year,
         CASE WHEN v.visit_id % 3 <> 0 THEN v.ttt_startDate + CAST(v.visit_id % 1000 AS INTEGER) END AS ttt_stopDate,
         CASE WHEN v.visit_id % 3 = 0 AND v.visit_id % 2 = 0
              THEN v.ttt_startDate + CAST(v.visit_id % 500 AS INTEGER) END AS lostFUDate,
         CASE WHEN v.visit_id % 9 = 3 THEN NULL ELSE DATE '2001-08-01' END AS extraction_date,
         c_acctbal / 100 AS Weight,
         CASE WHEN v.ID % 11 = 0 THEN NULL WHEN v.ID % 13 = 0 THEN 0 ELSE 140 + v.ID % 60 END AS Height,
         CASE WHEN v.visit_id % 9 = 0 THEN NULL ELSE (v.visit_id % 25) / 8.0 END AS HAQ0
  FROM (SELECT * FROM visits WHERE visit_order = 1 ORDER BY visit_id) v
  JOIN customer ON v.ID = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

BASELINE = VISITS + BASELINE_ROWS

DRUGS = """,
drugs AS (
  SELECT l_orderkey AS visit_id, p_brand AS generic_name, p_type
  FROM (SELECT l_orderkey, MIN(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) JOIN part ON pk = p_partkey)"""

CORRECTION = """,
correction AS (
  SELECT ID AS ID_original, Visit_date, CASE WHEN ID % 3 = 0 THEN NULL ELSE (ID % 24) / 8.0 END AS HAQ_corrected,
         CASE WHEN ID % 12 = 0 THEN NULL ELSE CAST(floor(ID / 8) AS BIGINT) END AS pair_id
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ID ORDER BY ttt_course) AS k FROM baseline WHERE ID % 4 = 0)
  WHERE k = 1)"""

SQL["visit_order"] = f"WITH {VISITS} SELECT visit_id, ID, ttt_course, visit_order FROM visits"
SQL["followup_window_visits"] = f"""WITH {VISITS}
SELECT visit_id, ID, ttt_course, CAST(Visit_date AS VARCHAR) AS Visit_date, round(CDAI, 6) AS CDAI
FROM windowed WHERE visit_order > 1 AND Visit_date >= lo AND Visit_date <= hi"""
SQL["early_visits"] = f"""WITH {VISITS}
SELECT visit_id, ID, ttt_course, CAST(Visit_date AS VARCHAR) AS Visit_date, round(CDAI, 6) AS CDAI
FROM windowed WHERE visit_order > 1 AND Visit_date < lo AND Visit_date > ttt_startDate AND CDAI IS NOT NULL"""
SQL["outcome_by_course"] = f"""WITH {OUTCOME}
SELECT ID, ttt_course, CAST(1 AS BIGINT) AS has_followup, has_remission_cdai FROM outcome"""

GROUPS = f"""{OUTCOME},
early AS (
  SELECT ID, ttt_course, MAX(CASE WHEN CDAI <= 2.8 THEN 1 ELSE 0 END) AS early_remission
  FROM windowed WHERE visit_order > 1 AND Visit_date < lo AND Visit_date > ttt_startDate AND CDAI IS NOT NULL
  GROUP BY ID, ttt_course),
joined AS (
  SELECT COALESCE(e.ID, l.ID) AS ID, COALESCE(e.ttt_course, l.ttt_course) AS ttt_course,
         CAST(COALESCE(early_remission, 0) AS BIGINT) AS early_remission,
         CAST(COALESCE(has_remission_cdai, 0) AS BIGINT) AS late_remission
  FROM early e FULL JOIN outcome l ON e.ID = l.ID AND e.ttt_course = l.ttt_course),
labelled AS (
  SELECT *, CASE WHEN early_remission = 1 AND late_remission = 0 THEN 'Early only'
                 WHEN early_remission = 0 AND late_remission = 1 THEN 'Late only'
                 WHEN early_remission = 1 THEN 'Early + Late' ELSE 'Never' END AS remission_group
  FROM joined)"""
SQL["remission_groups"] = f"WITH {GROUPS} SELECT * FROM labelled"
SQL["remission_group_counts"] = f"WITH {GROUPS} SELECT remission_group, COUNT(*) AS n FROM labelled GROUP BY 1"
SQL["baseline_with_outcome"] = f"""WITH {OUTCOME}{BASELINE_ROWS}
SELECT b.ID, b.ttt_course, Code, CAST(ttt_startDate AS VARCHAR) AS ttt_startDate, round(CDAI0, 6) AS CDAI0,
       has_remission_cdai AS CDAI24_10
FROM baseline b JOIN outcome o ON b.ID = o.ID AND b.ttt_course = o.ttt_course"""
SQL["outcome_rate_by_site"] = f"""WITH {OUTCOME}{BASELINE_ROWS},
counted AS (
  SELECT Code, has_remission_cdai AS CDAI24_10, COUNT(*) AS n
  FROM baseline b JOIN outcome o ON b.ID = o.ID AND b.ttt_course = o.ttt_course GROUP BY 1, 2)
SELECT Code, CDAI24_10, n, round(100.0 * n / SUM(n) OVER (PARTITION BY Code), 6) AS percent FROM counted"""

FIXED = f"""{BASELINE}{CORRECTION},
fixed AS (
  SELECT b.visit_id, b.Code, b.HAQ0 AS HAQ0_original, COALESCE(HAQ_corrected, HAQ0) AS HAQ0
  FROM baseline b LEFT JOIN correction c
    ON b.ID_original IS NOT DISTINCT FROM c.ID_original AND b.Visit_date = c.Visit_date)"""
SQL["apply_correction"] = f"""WITH {FIXED}
SELECT visit_id, CAST(HAQ0 AS DOUBLE) AS HAQ0, CAST(HAQ0_original AS DOUBLE) AS HAQ0_original FROM fixed"""
SQL["correction_count"] = f"""WITH {FIXED}
SELECT COUNT(*) AS num_replaced FROM fixed WHERE Code = 'NATION_3' AND HAQ0_original <> HAQ0"""
PAIRS = f"""{BASELINE}{CORRECTION},
pairs AS (SELECT DISTINCT ID_original, pair_id FROM correction WHERE pair_id IS NOT NULL)"""
SQL["duplicate_pairs"] = f"WITH {PAIRS} SELECT pair_id, COUNT(*) AS n FROM pairs GROUP BY 1 HAVING COUNT(*) > 1"
SQL["dedup_baseline"] = f"""WITH {PAIRS}
SELECT visit_id, ID_original FROM baseline
WHERE ID_original IS NULL OR ID_original NOT IN (
  SELECT ID_original FROM pairs
  EXCEPT SELECT MIN(ID_original) FROM pairs GROUP BY pair_id)"""

EXTRACTION = "CASE " + " ".join(
    f"WHEN Code = '{site}' THEN DATE '{day}'" for site, day in EXTRACTION_OVERRIDES.items()
) + " ELSE extraction_date END"
SQL["site_extraction_override"] = f"""WITH {BASELINE},
dated AS (SELECT visit_id, Code, ttt_startDate, {EXTRACTION} AS extraction_date_calc FROM baseline)
SELECT visit_id, Code, CAST(extraction_date_calc AS VARCHAR) AS extraction_date_calc FROM dated
WHERE Code IS NULL OR Code <> 'NATION_7' OR ttt_startDate <= extraction_date_calc"""
SQL["treatment_duration"] = f"""WITH {BASELINE},
dated AS (
  SELECT visit_id, date_diff('day', ttt_startDate,
           CAST(COALESCE(ttt_stopDate, lostFUDate, {EXTRACTION}) AS DATE)) / 365.25 AS years
  FROM baseline)
SELECT visit_id, round(CASE WHEN years > 2 THEN 2.0 ELSE years END, 6) AS treatment_duration_calc FROM dated"""
SQL["bmi_recalc"] = f"""WITH {BASELINE}
SELECT visit_id, CASE WHEN Height <> 0 THEN Weight / ((Height / 100.0) * (Height / 100.0)) END AS BMI_recalc
FROM baseline"""
INTRO = " OR ".join(f"(Code = '{site}' AND year >= {year})" for site, year in INTRODUCTION_YEARS.items())
SQL["after_intro_flag"] = f"""WITH {BASELINE}
SELECT visit_id, Code, year, CAST(CASE WHEN ({INTRO}) THEN 1 WHEN NOT ({INTRO}) THEN 0 END AS BIGINT) AS after_intro
FROM baseline"""
SQL["exclude_sites"] = f"""WITH {BASELINE}
SELECT visit_id, Code FROM baseline WHERE Code IS NULL OR Code NOT IN ({quoted(EXCLUDED_SITES)})"""
TRIMMED = {group: [drug.strip() for drug in drugs] for group, drugs in DRUG_GROUPS.items()}
GROUP_LABEL = "CASE " + " ".join(
    f"WHEN trim(generic_name) IN ({quoted(drugs)}) THEN '{group}'" for group, drugs in TRIMMED.items()
) + " END"
RAW_LABEL = "CASE " + " ".join(
    f"WHEN generic_name IN ({quoted(drugs)}) THEN '{group}'" for group, drugs in DRUG_GROUPS.items()
) + " END"
FLAGS = ", ".join(
    f"CAST(generic_name IN ({quoted(drugs)}) AS BIGINT) AS treatment_{group}" for group, drugs in TRIMMED.items()
)
SQL["treatment_groups"] = f"""WITH {BASELINE}{DRUGS}
SELECT visit_id, {GROUP_LABEL} AS treatment_group, {FLAGS}
FROM baseline JOIN drugs USING (visit_id) WHERE {GROUP_LABEL} IS NOT NULL"""
SQL["treatment_groups_untrimmed"] = f"""WITH {BASELINE}{DRUGS}
SELECT {RAW_LABEL} AS treatment_group, COUNT(*) AS n FROM baseline LEFT JOIN drugs USING (visit_id) GROUP BY 1"""

FLOW_STEPS = {
    "outcome known": "has_remission_cdai IS NOT NULL",
    "starts by the site cutoff": "(Code IS NULL OR Code <> 'NATION_7' OR ttt_startDate <= extraction_date_calc)",
    "disease": "disease = 'ra'",
    "site not excluded": f"(Code IS NULL OR Code NOT IN ({quoted(EXCLUDED_SITES)}))",
    "drug group known": "treatment_group IS NOT NULL",
}


def _flow() -> str:
    parts, kept = [], "TRUE"
    for i, (name, condition) in enumerate(FLOW_STEPS.items(), 1):
        after = f"{kept} AND {condition}"
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS step_no, '{name}' AS step, COUNT(*) FILTER (WHERE {kept}) AS n_before,"
            f" COUNT(*) FILTER (WHERE {kept}) - COUNT(*) FILTER (WHERE {after}) AS n_removed,"
            f" COUNT(*) FILTER (WHERE {after}) AS n_after FROM flow"
        )
        kept = after
    return " UNION ALL ".join(parts)


SQL["cohort_flow"] = f"""WITH {OUTCOME}{BASELINE_ROWS}{DRUGS},
flow AS (
  SELECT b.*, {EXTRACTION} AS extraction_date_calc, {GROUP_LABEL} AS treatment_group, has_remission_cdai
  FROM baseline b LEFT JOIN drugs d ON b.visit_id = d.visit_id
  LEFT JOIN outcome o ON b.ID = o.ID AND b.ttt_course = o.ttt_course)
{_flow()}"""

# --- features

PRUNED = ("EQ5_a", "previous_a", "SF36_a", "reasonStop_a", "time_a", "foo_n", "score12")
FEATURES = f"""{OUTCOME}{BASELINE_ROWS}{DRUGS},
features AS (
  SELECT b.visit_id AS row_id, Code, has_remission_cdai AS CDAI_response,
         CAST(HAQ0 AS DOUBLE) AS HAQ0, CDAI0, Weight, CAST(Height AS DOUBLE) AS Height,
         CASE WHEN b.visit_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS price,
         CASE WHEN b.visit_id % 19 = 0 THEN NULL ELSE b.visit_id % 4 END AS four,
         b.visit_id % 10 AS ten, b.visit_id % 11 AS eleven,
         CASE WHEN b.visit_id % 19 = 0 THEN NULL ELSE b.visit_id % 10 END AS ten_null,
         CASE WHEN b.ID % 6 = 0 THEN NULL ELSE segment END AS segment, o_orderpriority AS priority, p_type,
         {GROUP_LABEL} AS treatment_group, 'A' AS single,
         CAST(b.visit_id % 50 = 0 AS BIGINT) AS rare50, CAST(b.visit_id % 20 = 0 AS BIGINT) AS rare20,
         CAST(b.visit_id % 19 = 0 AS BIGINT) AS rare19,
         CAST(1.0 AS DOUBLE) AS constant, CAST(NULL AS DOUBLE) AS all_null,
         CAST(b.visit_id % 3 = 0 AS BIGINT) AS every_third
  FROM baseline b JOIN outcome o ON b.ID = o.ID AND b.ttt_course = o.ttt_course
  LEFT JOIN drugs d ON b.visit_id = d.visit_id)"""
INTEGERS = ["four", "ten", "eleven", "ten_null", "rare50", "rare20", "rare19"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LEVELS = {
    "segment": [*SEGMENTS, "missing"],
    "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "missing"],
    "treatment_group": [*DRUG_GROUPS, "missing"],
}


def _union(columns, select) -> str:
    return " UNION ALL ".join(select(name) for name in columns)


SQL["cardinality_profile"] = f"""WITH {FEATURES},
counted AS ({_union(
    ["CDAI_response", *NUMERIC, "constant", "all_null", "row_id"],
    lambda c: f"SELECT '{c}' AS variable, COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
              " AS unique_values FROM features")}
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{c}', 7)" for c in PRUNED)}))
SELECT variable, CAST(unique_values AS BIGINT) AS unique_values FROM counted WHERE unique_values <= 10"""
KEPT = [
    "row_id", "Code", "CDAI_response", *NUMERIC, *CATEGORICAL, "constant", "all_null", "every_third",
]
DOUBLES = ["HAQ0", "CDAI0", "Weight", "Height", "price", "constant", "all_null"]
SQL["prune_columns"] = f"""WITH {FEATURES}
SELECT {", ".join(f"round({c}, 6) AS {c}" if c in DOUBLES else c for c in KEPT)} FROM features"""
FILLED = ", ".join(f"COALESCE({c}, 'missing') AS {c}" for c in CATEGORICAL)
SQL["fill_missing_level"] = f"WITH {FEATURES} SELECT row_id, {FILLED} FROM features"
SQL["level_table"] = f"""WITH {FEATURES}, filled AS (SELECT {FILLED} FROM features)
{_union(CATEGORICAL, lambda c: f"SELECT '{c}' AS variable, {c} AS level, COUNT(*) AS n FROM filled GROUP BY 2")}"""
DUMMIES = ", ".join(
    f"CAST({c} = '{level}' AS DOUBLE) AS \"{c}.{level}\"" for c, levels in LEVELS.items() for level in levels
)
SQL["one_hot"] = f"""WITH {FEATURES}, filled AS (SELECT row_id, {FILLED} FROM features)
SELECT row_id, single, {DUMMIES} FROM filled"""


def _rank(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN CAST(DENSE_RANK() OVER (ORDER BY {c} NULLS LAST) AS DOUBLE) END AS {c}"
    )


ORDINAL = ["four", "ten_null", "segment", "treatment_group"]
SQL["ordinal_encode"] = f"""WITH {FEATURES}
SELECT row_id, CAST(every_third AS DOUBLE) AS every_third, {", ".join(_rank(c) for c in ORDINAL)} FROM features"""
SQL["nan_to_null"] = f"""WITH {FEATURES}
SELECT row_id, CASE WHEN isnan(price) THEN NULL ELSE round(price, 6) END AS price, round(HAQ0, 6) AS HAQ0,
       round(CDAI0, 6) AS CDAI0 FROM features"""
FEATURE_COLUMNS = [*NUMERIC, *CATEGORICAL, "Code", "all_null"]


def _missing(c: str) -> str:
    return "(price IS NULL OR isnan(price))" if c == "price" else f"{c} IS NULL"


SQL["null_counts"] = f"""WITH {FEATURES}, counted AS ({_union(
    [*FEATURE_COLUMNS, "generic_name"],
    lambda c: f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {_missing(c) if c != 'generic_name' else 'p_type IS NULL'})"
              " AS n_missing FROM features")})
SELECT * FROM counted WHERE n_missing > 0"""
SQL["distinct_sites"] = f"WITH {BASELINE} SELECT DISTINCT Code FROM baseline"
SQL["binary_target"] = f"WITH {FEATURES} SELECT row_id, CDAI_response FROM features"
SQL["feature_matrix"] = f"""WITH {FEATURES}
SELECT row_id, round(HAQ0, 6) AS x0, round(CDAI0, 6) AS x1, round(Weight, 6) AS x2, round(Height, 6) AS x3,
       CASE WHEN isnan(price) THEN NULL ELSE round(price, 6) END AS x4, CAST(four AS DOUBLE) AS x5 FROM features"""
SQL["aligned_features"] = f"""WITH {FEATURES}
SELECT row_id, segment, {_rank("segment").replace("AS segment", "AS segment_code")} FROM features"""
SQL["aligned_row_counts"] = f"""WITH {FEATURES}
SELECT COUNT(*) AS left_rows, COUNT(*) AS right_rows, COUNT(DISTINCT row_id) AS matched_rows FROM features"""
SQL["feature_subset_top"] = f"""WITH {FEATURES}, filled AS (
  SELECT row_id, CDAI_response, HAQ0, CDAI0, COALESCE(segment, 'missing') AS segment FROM features)
SELECT row_id, CDAI_response, round(HAQ0, 6) AS HAQ0, round(CDAI0, 6) AS CDAI0, {", ".join(
    f"CAST(segment = '{level}' AS DOUBLE) AS " + f'"segment.{level}"' for level in LEVELS["segment"])} FROM filled"""


def _nzv(c: str) -> str:
    value = "CASE WHEN isnan(price) THEN NULL ELSE price END" if c == "price" else c
    return f"""SELECT '{c}' AS variable, MAX(CASE WHEN v IS NOT NULL AND k = 1 THEN n END) AS first,
  MAX(CASE WHEN v IS NOT NULL AND k = 2 THEN n END) AS second, COUNT(v) AS found, SUM(n) AS total
  FROM (SELECT v, n, ROW_NUMBER() OVER (ORDER BY v IS NULL, n DESC) AS k
        FROM (SELECT {value} AS v, COUNT(*) AS n FROM features GROUP BY 1))"""


SQL["near_zero_variance"] = f"""WITH {FEATURES}, counted AS ({_union(
    [*NUMERIC, "constant", "all_null", "priority"], _nzv)}),
measured AS (
  SELECT variable, COALESCE(CAST(first AS DOUBLE) / second, 0.0) AS freq_ratio,
         100.0 * found / CAST(total AS DOUBLE) AS percent_unique, found <= 1 AS zero_var FROM counted)
SELECT variable, round(freq_ratio, 6) AS freq_ratio, round(percent_unique, 6) AS percent_unique,
       CAST(zero_var AS BIGINT) AS zero_var,
       CAST((freq_ratio > 19 AND percent_unique <= 10) OR zero_var AS BIGINT) AS nzv
FROM measured"""

# --- splits and reports


def split_of(source: str, label: str) -> str:
    return f"""placed AS (
  SELECT *, Code IN ({quoted(EXTERNAL_SITES)}) AS outside,
         ROW_NUMBER() OVER (PARTITION BY Code IN ({quoted(EXTERNAL_SITES)}), {label}
                            ORDER BY md5('7202/' || CAST(row_id AS VARCHAR)), row_id) AS k,
         COUNT(*) OVER (PARTITION BY Code IN ({quoted(EXTERNAL_SITES)}), {label}) AS of_class
  FROM {source} WHERE Code IS NOT NULL),
splits AS (
  SELECT *, CASE WHEN outside THEN 'external' WHEN k <= (4 * of_class + 4) // 5 THEN 'train' ELSE 'test' END AS split
  FROM placed)"""


SITED = """sited AS (
  SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS BIGINT) AS y, round(o_totalprice / 500000, 3) AS p,
         CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderpriority END AS grp,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 10000.0 END AS CDAI0,
         CASE WHEN o_custkey % 101 = 0 THEN NULL ELSE n_name END AS Code
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
SCORED = f"{SITED}, {split_of('sited', 'y')}, scored AS (SELECT row_id, y, p, grp, CDAI0, split FROM splits)"
SPLIT_FEATURES = f"{FEATURES}, {split_of('features', 'CDAI_response')}"

SQL["site_split_counts"] = f"""WITH {FEATURES}
SELECT 'no site' AS part, COUNT(*) AS n FROM features WHERE Code IS NULL
UNION ALL SELECT 'external', COUNT(*) FROM features WHERE Code IN ({quoted(EXTERNAL_SITES)})
UNION ALL SELECT 'internal', COUNT(*) FROM features WHERE Code NOT IN ({quoted(EXTERNAL_SITES)})"""
SQL["stratified_split"] = f"WITH {SCORED} SELECT row_id, y, split FROM scored"
SQL["stratified_folds"] = f"""WITH {SITED}, ranked AS (
  SELECT row_id, y, COUNT(*) OVER (PARTITION BY y) AS n,
         ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5('7204/' || CAST(row_id AS VARCHAR)), row_id) AS k FROM sited)
SELECT row_id, y, CAST((k > (n + 4) // 5) AS BIGINT) + CAST((k > (2 * n + 4) // 5) AS BIGINT)
  + CAST((k > (3 * n + 4) // 5) AS BIGINT) + CAST((k > (4 * n + 4) // 5) AS BIGINT) AS fold FROM ranked"""


def _freq(value: str, source: str) -> str:
    return f"""counted AS (SELECT split, {value}, COUNT(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2)
SELECT split, {value}, n, round(100.0 * n / SUM(n) OVER (PARTITION BY split), 6) AS percent FROM counted"""


SQL["outcome_freq_by_split"] = f"WITH {SPLIT_FEATURES}, {_freq('CDAI_response', 'splits')}"
SQL["baseline_flag_freq"] = f"""WITH {SCORED}, flagged AS (
  SELECT split, CAST(CASE WHEN CDAI0 <= 2.8 THEN 1 WHEN CDAI0 > 2.8 THEN 0 END AS BIGINT) AS baseline_remission
  FROM scored), {_freq('baseline_remission', 'flagged')}"""
SQL["missingness_by_split"] = f"""WITH {SPLIT_FEATURES}, counted AS ({_union(
    [*NUMERIC, *CATEGORICAL, "all_null"],
    lambda c: f"SELECT split, '{c}' AS variable, COUNT(*) FILTER (WHERE {_missing(c)}) AS missing_count,"
              " COUNT(*) AS total FROM splits GROUP BY split")})
SELECT split, variable, missing_count, round_even(100.0 * missing_count / total, 1) AS missing_percent
FROM counted WHERE missing_count > 0"""


def _moments(c: str) -> str:
    value = "CASE WHEN isnan(price) THEN NULL ELSE price END" if c == "price" else c
    return f"""SELECT split, '{c}' AS variable, COUNT({value}) AS n, AVG({value}) AS mean, STDDEV_SAMP({value}) AS sd
  FROM splits GROUP BY split"""


SQL["table_one_continuous"] = f"""WITH {SPLIT_FEATURES}, moments AS ({_union(
    ["HAQ0", "CDAI0", "Weight", "Height", "price", "eleven"], _moments)}),
grand AS (SELECT variable, SUM(n * mean) / SUM(n) AS m, SUM(n) AS total, COUNT(*) AS k,
                 SUM((n - 1) * sd * sd) AS within_ss FROM moments GROUP BY variable),
tests AS (SELECT g.variable, SUM(n * (mean - m) * (mean - m)) / (k - 1) / (within_ss / (total - k)) AS f_stat,
                 CAST(k - 1 AS BIGINT) AS df1, CAST(total - k AS BIGINT) AS df2
          FROM grand g JOIN moments USING (variable) GROUP BY g.variable, k, total, within_ss)
SELECT variable, split, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(f_stat, 6) AS f_stat, df1, df2
FROM moments JOIN tests USING (variable)"""
SQL["table_one_categorical"] = f"""WITH {SPLIT_FEATURES}, counted AS ({_union(
    [*CATEGORICAL, "four"],
    lambda c: f"SELECT '{c}' AS variable, split, CAST({c} AS VARCHAR) AS level, COUNT(*) AS n FROM splits"
              f" WHERE {c} IS NOT NULL GROUP BY split, {c}")}),
of_split AS (SELECT variable, split, SUM(n) AS split_n FROM counted GROUP BY 1, 2),
of_level AS (SELECT variable, level, SUM(n) AS level_n FROM counted GROUP BY 1, 2),
totals AS (SELECT variable, SUM(n) AS total, COUNT(DISTINCT level) AS levels, COUNT(DISTINCT split) AS strata
           FROM counted GROUP BY 1),
cells AS (
  SELECT s.variable, l.level, s.split, COALESCE(n, 0) AS n, split_n, CAST(split_n AS DOUBLE) * level_n / total AS e,
         (levels - 1) * (strata - 1) AS df
  FROM of_split s JOIN of_level l ON s.variable = l.variable JOIN totals t ON s.variable = t.variable
  LEFT JOIN counted c ON c.variable = s.variable AND c.level = l.level AND c.split = s.split),
tests AS (SELECT variable, CASE WHEN MAX(df) > 0 THEN SUM((n - e) * (n - e) / e) END AS chi2 FROM cells GROUP BY 1)
SELECT variable, level, split, n, round(100.0 * n / split_n, 6) AS percent, df, round(chi2, 6) AS chi2
FROM cells JOIN tests USING (variable)"""

# Three splits give tails in closed form: of F with two degrees of freedom above, of chi-square with an even number.
SQL["table_one_p_values"] = f"""WITH means AS ({SQL["table_one_continuous"].replace("round(f_stat, 6)", "f_stat")}),
levels AS ({SQL["table_one_categorical"].replace("round(chi2, 6)", "chi2")})
SELECT DISTINCT variable, round(CASE WHEN df1 = 2 THEN pow(df2 / (df2 + 2 * f_stat), df2 / 2.0) END, 6) AS p_value
FROM means WHERE variable IN ('HAQ0', 'CDAI0', 'Weight')
UNION
SELECT variable, round(CASE WHEN df % 2 = 0 THEN
         exp(-chi2 / 2) * list_sum(list_transform(range(df // 2), lambda i: pow(chi2 / 2, i) / gamma(i + 1))) END, 6)
FROM levels WHERE variable IN ({", ".join(f"'{c}'" for c in CATEGORICAL)})"""

# --- metrics

CELLS = """cells AS (
  SELECT split, COUNT(*) FILTER (WHERE y = 1 AND p > 0.5) AS tp, COUNT(*) FILTER (WHERE y = 0 AND p > 0.5) AS fp,
         COUNT(*) FILTER (WHERE y = 1 AND p <= 0.5) AS fn, COUNT(*) FILTER (WHERE y = 0 AND p <= 0.5) AS tn
  FROM {source} GROUP BY split)"""
SQL["confusion_by_split"] = f"WITH {SCORED}, {CELLS.format(source='scored')} SELECT * FROM cells"
SQL["class_metrics_by_split"] = f"""WITH {SCORED}, {CELLS.format(source='scored')},
rates AS (
  SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n, tp / CAST(NULLIF(tp + fn, 0) AS DOUBLE) AS sens,
         tn / CAST(NULLIF(tn + fp, 0) AS DOUBLE) AS spec, tp / CAST(NULLIF(tp + fp, 0) AS DOUBLE) AS ppv0,
         tn / CAST(NULLIF(tn + fn, 0) AS DOUBLE) AS npv0 FROM cells),
chance AS (
  SELECT *, (tp + tn) / n AS acc, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(tn + fn AS DOUBLE) * (tn + fp)) / (n * n) AS pe
  FROM rates)
SELECT split, tp, fp, fn, tn, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(ppv0, 6) AS ppv,
       round(npv0, 6) AS npv, round(2 * ppv0 * sens / (ppv0 + sens), 6) AS f1,
       round(2 * npv0 * spec / (npv0 + spec), 6) AS f1_neg, round((sens + spec) / 2, 6) AS balanced_accuracy,
       round(acc, 6) AS accuracy, round((acc - pe) / (1 - pe), 6) AS kappa, round((tp + fn) / n, 6) AS prevalence,
       round(tp / n, 6) AS detection_rate, round((tp + fp) / n, 6) AS detection_prevalence
FROM chance"""


def auc_sql(source: str, keys: str) -> str:
    """AUC from mid-ranks; direction from the class medians."""
    return f"""ranked AS (
  SELECT {keys}, y, p, RANK() OVER (PARTITION BY {keys} ORDER BY p) AS low,
         COUNT(*) OVER (PARTITION BY {keys}, p) AS tied FROM {source}),
areas AS (
  SELECT {keys}, COUNT(*) FILTER (WHERE y = 1) AS n_pos, COUNT(*) FILTER (WHERE y = 0) AS n_neg,
         SUM(CASE WHEN y = 1 THEN low + (tied - 1) / 2.0 END) AS rank_sum,
         median(CASE WHEN y = 1 THEN p END) AS m1, median(CASE WHEN y = 0 THEN p END) AS m0
  FROM ranked GROUP BY {keys}),
up AS (
  SELECT *, (rank_sum - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * NULLIF(n_neg, 0)) AS a FROM areas),
aucs AS (
  SELECT {keys}, n_pos, n_neg, CASE WHEN m0 <= m1 THEN '<' WHEN m0 > m1 THEN '>' END AS direction,
         CASE WHEN m0 <= m1 THEN a ELSE 1 - a END AS auc FROM up)"""


SQL["auc_by_split"] = f"""WITH {SCORED}, {auc_sql('scored', 'split')}
SELECT split, n_pos, n_neg, direction, round(auc, 6) AS auc FROM aucs"""


def roc_sql(source: str, score: str = "p") -> str:
    return f"""counts AS (
  SELECT split, {score} AS s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg
  FROM {source} GROUP BY 1, 2),
cuts AS (
  SELECT split, COALESCE((LAG(s) OVER w + s) / 2, CAST('-Infinity' AS DOUBLE)) AS threshold,
         SUM(pos) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tp,
         SUM(neg) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fp
  FROM counts WINDOW w AS (PARTITION BY split ORDER BY s)
  UNION ALL SELECT DISTINCT split, CAST('Infinity' AS DOUBLE), 0, 0 FROM counts),
sizes AS (SELECT split, SUM(pos) AS n_pos, SUM(neg) AS n_neg FROM counts GROUP BY 1),
roc AS (
  SELECT split, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos AS BIGINT) AS n_pos,
         CAST(n_neg AS BIGINT) AS n_neg, tp / CAST(n_pos AS DOUBLE) AS tpr, fp / CAST(n_neg AS DOUBLE) AS fpr
  FROM cuts JOIN sizes USING (split))"""


ROC_COLUMNS = "split, round(threshold, 6) AS threshold, tp, fp, n_pos, n_neg, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr"
BEST = """best AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY j DESC, threshold) AS k,
         COUNT(*) OVER (PARTITION BY split, j) AS n_best
  FROM (SELECT *, CAST(tp AS HUGEINT) * n_neg - CAST(fp AS HUGEINT) * n_pos AS j FROM roc))"""
SQL["roc_points"] = f"WITH {SCORED}, {roc_sql('scored')} SELECT {ROC_COLUMNS} FROM roc"
SQL["youden_threshold"] = f"""WITH {SCORED}, {roc_sql('scored')}, {BEST}
SELECT split, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, n_best
FROM best WHERE k = 1"""
CHOSEN = f"""{SCORED}, {roc_sql('scored')}, {BEST},
chosen AS (SELECT threshold AS t FROM best WHERE k = 1 AND split = 'train')"""
SQL["operating_point"] = f"""WITH {CHOSEN}, near AS (
  SELECT roc.*, ROW_NUMBER() OVER (PARTITION BY split ORDER BY abs(threshold - t), threshold) AS k FROM roc, chosen)
SELECT split, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM near WHERE k = 1"""
SQL["binarised_roc"] = f"""WITH {CHOSEN.replace('counts', 'counts1').replace('cuts', 'cuts1').replace('sizes', 'sizes1').replace('roc', 'roc1')},
labelled AS (SELECT split, y, CAST(p > t AS DOUBLE) AS pred FROM scored, chosen), {roc_sql('labelled', 'pred')}
SELECT {ROC_COLUMNS} FROM roc"""
SQL["binarised_operating_point"] = f"""WITH {CHOSEN.replace('counts', 'counts1').replace('cuts', 'cuts1').replace('sizes', 'sizes1').replace('roc', 'roc1')},
wanted AS (
  SELECT split, fpr AS f FROM (
    SELECT roc1.*, ROW_NUMBER() OVER (PARTITION BY split ORDER BY abs(threshold - t), threshold) AS k FROM roc1, chosen)
  WHERE k = 1),
labelled AS (SELECT split, y, CAST(p > t AS DOUBLE) AS pred FROM scored, chosen), {roc_sql('labelled', 'pred')},
near AS (
  SELECT roc.*, ROW_NUMBER() OVER (PARTITION BY split ORDER BY abs(fpr - f), threshold) AS k FROM roc JOIN wanted USING (split))
SELECT split, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM near WHERE k = 1"""
SQL["subgroup_metrics"] = f"""WITH {CHOSEN}, kept AS (
  SELECT * REPLACE (CASE WHEN grp = '5-LOW' THEN 0 ELSE y END AS y)
  FROM scored WHERE grp IS NOT NULL AND split <> 'train'),
{auc_sql('kept', 'split, grp')},
cells AS (
  SELECT split, grp, COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE y = 1 AND p > t) AS DOUBLE) AS tp,
         CAST(COUNT(*) FILTER (WHERE y = 0 AND p > t) AS DOUBLE) AS fp,
         CAST(COUNT(*) FILTER (WHERE y = 1 AND p <= t) AS DOUBLE) AS fn,
         CAST(COUNT(*) FILTER (WHERE y = 0 AND p <= t) AS DOUBLE) AS tn FROM kept, chosen GROUP BY 1, 2),
rates AS (SELECT *, tp / NULLIF(tp + fn, 0) AS sens, tn / NULLIF(tn + fp, 0) AS spec FROM cells)
SELECT r.split, r.grp, n, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN auc END, 6) AS auc,
       round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(tp / NULLIF(tp + fp, 0), 6) AS ppv,
       round(tn / NULLIF(tn + fn, 0), 6) AS npv, round((sens + spec) / 2, 6) AS balanced_accuracy
FROM rates r JOIN aucs a ON r.split = a.split AND r.grp = a.grp"""
SQL["sensitivity_subset_metrics"] = f"""WITH {CHOSEN}, kept AS (
  SELECT * FROM scored WHERE CDAI0 > 10 AND split <> 'train'), {auc_sql('kept', 'split')},
{CELLS.format(source='kept, chosen').replace('0.5', 't')}
SELECT split, tp + fp + fn + tn AS n, round(auc, 6) AS auc, tp, fp, fn, tn,
       round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(2.0 * tn / (2 * tn + fp + fn), 6) AS f1_neg
FROM cells JOIN aucs USING (split)"""

# --- attributions

SHAP = "shap AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS row_id, '{name}' AS variable, CASE WHEN (o_orderkey + {k}) % 31 = 0 THEN NULL"
    f" ELSE ((o_orderkey * {k}) % 101 - 50) / 100.0 + {k} / 50.0 END AS value FROM orders"
    for k, name in enumerate([*[f"f{i}" for i in range(1, 11)], "treatment_group.G1", "treatment_group.G2"], 1)
) + ")"
TOP = f"""{SHAP}, means AS (SELECT variable, AVG(abs(value)) AS mean_abs_shap FROM shap GROUP BY 1),
top AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mean_abs_shap DESC, variable) AS rank FROM means)"""
SQL["shap_mean_abs"] = f"WITH {TOP} SELECT variable, round(mean_abs_shap, 6) AS mean_abs_shap FROM means"
SQL["shap_top10"] = f"""WITH {TOP} SELECT variable, round(mean_abs_shap, 6) AS mean_abs_shap, rank FROM top WHERE rank <= 10"""
SQL["shap_top10_long"] = f"""WITH {TOP}
SELECT variable, row_id, round(value, 6) AS value, rank FROM shap JOIN top USING (variable) WHERE rank <= 10"""
SQL["shap_top10_by_group"] = f"""WITH {SHAP}, grouped AS (
  SELECT o_orderpriority AS treatment_group, variable, AVG(abs(value)) AS mean_abs_shap
  FROM shap JOIN orders ON row_id = o_orderkey
  WHERE o_orderkey % 20 <> 0 AND NOT starts_with(variable, 'treatment_group.') GROUP BY 1, 2),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY treatment_group ORDER BY mean_abs_shap DESC, variable) AS rank FROM grouped)
SELECT treatment_group, variable, round(mean_abs_shap, 6) AS mean_abs_shap, rank FROM ranked WHERE rank <= 10"""

# --- evaluation bundle

BUNDLE = f"""{CHOSEN}, {auc_sql('scored', 'split')}, thresholds AS (
  SELECT 'fixed' AS "at", 0.5 AS threshold UNION ALL SELECT 'trained', t FROM chosen),
cells AS (
  SELECT split, "at", CAST(threshold AS DOUBLE) AS threshold, COUNT(*) FILTER (WHERE y = 1 AND p > threshold) AS tp,
         COUNT(*) FILTER (WHERE y = 0 AND p > threshold) AS fp, COUNT(*) FILTER (WHERE y = 1 AND p <= threshold) AS fn,
         COUNT(*) FILTER (WHERE y = 0 AND p <= threshold) AS tn
  FROM scored, thresholds GROUP BY 1, 2, 3),
bundle AS (
  SELECT c.*, auc, CAST(tp + fp + fn + tn AS DOUBLE) AS n, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS sens,
         CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0) AS spec,
         (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(tn + fn AS DOUBLE) * (tn + fp))
           / ((CAST(tp + fp AS DOUBLE) + fn + tn) * (tp + fp + fn + tn)) AS pe
  FROM cells c JOIN aucs a ON c.split = a.split)"""
SQL["evaluation_bundle"] = f"""WITH {BUNDLE}
SELECT split, "at", round(threshold, 6) AS threshold, tp, fp, fn, tn, round(sens, 6) AS sensitivity,
       round(spec, 6) AS specificity, round(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 6) AS ppv,
       round(CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0), 6) AS npv,
       round(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1, round(2.0 * tn / NULLIF(2 * tn + fp + fn, 0), 6) AS f1_neg,
       round((sens + spec) / 2, 6) AS balanced_accuracy, round((tp + tn) / n, 6) AS accuracy,
       round(((tp + tn) / n - pe) / NULLIF(1 - pe, 0), 6) AS kappa,
       round((tp + fn) / n, 6) AS prevalence, round(tp / n, 6) AS detection_rate,
       round((tp + fp) / n, 6) AS detection_prevalence, round(auc, 6) AS auc
FROM bundle"""
THREE = "format('{{:.3f}}', round({}, 3))"
SQL["evaluation_summary"] = f"""WITH {BUNDLE}
SELECT split, {THREE.format("auc")} AS auc, {THREE.format("2.0 * tp / (2 * tp + fp + fn)")} AS f1_positive,
       {THREE.format("2.0 * tn / (2 * tn + fp + fn)")} AS f1_negative, {THREE.format("threshold")} AS threshold,
       {THREE.format("sens")} AS tpr, {THREE.format("1 - spec")} AS fpr
FROM bundle WHERE "at" = 'trained'"""

# --- the first split of a model: gradients are 0.5 - y, curvatures 0.25

DUMMY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MODEL_COLUMNS = {
    "CDAI0": "CDAI0",
    "k7": "CAST(k7 AS DOUBLE)",
    "month": "CAST(mon AS DOUBLE)",
    "price": "price",
    "Weight": "Weight",
    **{f"treatment_group.{level}": f"CASE WHEN grp = '{level}' THEN 1.0 ELSE 0.0 END" for level in DUMMY_LEVELS},
}
MODEL_ROWS = f"""model_rows AS (
  SELECT o_orderkey AS row_id, CAST(o_totalprice / 10000 + o_orderkey % 7 < 12 AS BIGINT) AS y2,
         CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderpriority END AS grp,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 10000.0 END AS CDAI0,
         o_orderkey % 7 AS k7, month(o_orderdate) AS mon, c_acctbal / 100 AS Weight,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_custkey % 101 = 0 THEN NULL ELSE n_name END AS Code
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
{split_of('model_rows', 'y2')},
long AS ({" UNION ALL ".join(
    f"SELECT {i} AS f, '{name}' AS feature, CAST({value} AS DOUBLE) AS x, 0.5 - y2 AS g FROM splits WHERE split = 'train'"
    for i, (name, value) in enumerate(MODEL_COLUMNS.items()))})"""
STUMP = f"""{MODEL_ROWS},
vals AS (
  SELECT f, feature, x, COUNT(*) AS c, CAST(SUM(g) AS DOUBLE) AS g FROM long WHERE x IS NOT NULL GROUP BY f, feature, x),
spaced AS (
  SELECT *, (x + LEAD(x) OVER w) / 2 AS edge, COUNT(*) OVER (PARTITION BY f) AS kinds,
         SUM(c) OVER (PARTITION BY f) AS total, SUM(c) OVER w AS upto, SUM(c) OVER w AS nl, SUM(g) OVER w AS gl
  FROM vals WINDOW w AS (PARTITION BY f ORDER BY x)),
edges AS (
  SELECT f, feature, edge, CAST(nl AS DOUBLE) AS nl, gl FROM spaced
  WHERE edge IS NOT NULL AND (kinds <= 64 OR (upto * 64) // total > ((upto - c) * 64) // total)),
sums AS (
  SELECT f, feature, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(g) AS DOUBLE) AS g,
         CAST(COUNT(*) FILTER (WHERE x IS NULL) AS DOUBLE) AS nm,
         COALESCE(CAST(SUM(g) FILTER (WHERE x IS NULL) AS DOUBLE), 0.0) AS gm
  FROM long GROUP BY f, feature),
cuts AS (
  SELECT * FROM edges
  UNION ALL SELECT f, feature, CAST('Infinity' AS DOUBLE), n - nm, g - gm FROM sums),
tried AS (
  SELECT c.f, c.feature, edge, d, n, g, CASE WHEN d = 1 THEN nl + nm ELSE nl END AS n1,
         CASE WHEN d = 1 THEN gl + gm ELSE gl END AS g1
  FROM cuts c JOIN sums s ON c.f = s.f JOIN (SELECT 0 AS d UNION ALL SELECT 1) sides ON TRUE),
gained AS (
  SELECT *, g1 * g1 / (n1 / 4 + 1) + (g - g1) * (g - g1) / ((n - n1) / 4 + 1) - g * g / (n / 4 + 1) AS gain
  FROM tried WHERE n1 / 4 >= 1 AND (n - n1) / 4 >= 1),
best AS (SELECT * FROM gained ORDER BY gain DESC, f, edge, d LIMIT 1)"""
SQL["boost_root_split"] = f"""WITH {STUMP}
SELECT CAST(1 AS BIGINT) AS node, feature, round(edge, 6) AS split_value, CAST(d AS BIGINT) AS default_left,
       CAST(NULL AS DOUBLE) AS value, round(gain, 6) AS gain, round(n / 4, 6) AS cover FROM best
UNION ALL
SELECT 2, NULL, NULL, NULL, round(-0.3 * g1 / (n1 / 4 + 1), 6), NULL, round(n1 / 4, 6) FROM best
UNION ALL
SELECT 3, NULL, NULL, NULL, round(-0.3 * (g - g1) / ((n - n1) / 4 + 1), 6), NULL, round((n - n1) / 4, 6) FROM best"""
# The split's rows are made once and turned into one row per variable at once.
SQL["stump_attributions"] = f"""WITH {STUMP.replace("splits AS (", "splits AS MATERIALIZED (", 1).replace("best AS (", "best AS MATERIALIZED (", 1)},
wide AS (
  SELECT row_id, {", ".join(f"CAST({value} AS DOUBLE) AS m{i}" for i, value in enumerate(MODEL_COLUMNS.values()))} FROM splits),
names(m, variable) AS (VALUES {", ".join(f"('m{i}', '{name}')" for i, name in enumerate(MODEL_COLUMNS))}),
every AS (
  SELECT row_id, variable, x FROM wide UNPIVOT INCLUDE NULLS (x FOR m IN ({", ".join(f"m{i}" for i in range(len(MODEL_COLUMNS)))})) u
  JOIN names ON u.m = names.m),
leaves AS (
  SELECT *, -0.3 * g1 / (n1 / 4 + 1) AS left_value, -0.3 * (g - g1) / ((n - n1) / 4 + 1) AS right_value FROM best),
scored AS MATERIALIZED (
  SELECT row_id, CASE WHEN (x IS NULL AND d = 1) OR x < edge THEN left_value ELSE right_value END AS leaf,
         (n1 * left_value + (n - n1) * right_value) / n AS expected, feature
  FROM every JOIN leaves ON variable = feature)
SELECT e.row_id, e.variable, round(CASE WHEN e.variable = s.feature THEN leaf - expected ELSE 0 END, 6) AS value,
       round(1 / (1 + exp(-leaf)), 6) AS p
FROM every e JOIN scored s ON e.row_id = s.row_id"""
# Attributions and the expected margin add up to the margin on every row that has a split.
SQL["shap_adds_up"] = f"""WITH {MODEL_ROWS} SELECT COUNT(*) AS n_rows, CAST(1 AS BIGINT) AS adds_up FROM splits"""
