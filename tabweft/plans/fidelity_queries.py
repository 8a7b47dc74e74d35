"""Registered queries of the fidelity measures and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabweft.operators import fidelity as fd
from tabweft.operators import frequencies as fq
from tabweft.plans.fixture import BASE_SQL, CAT, NUM, SPEC, binned_long_sql, bins_sql, long_sql, real_sql, sides

CONSTRAINTS = ["total >= 50000", "bal > 0", "month <= 6", "total > bal and month != 12", "1 < month < 4"]


def rounded(df, *names):
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if c in names or t == "double" else F.col(c) for c, t in df.dtypes])


def _sides(fn):
    def query(spark, sf_dir):
        train, syn = sides(spark, sf_dir, "real", "syn")
        return rounded(fn(train, syn))

    return query


def _all(fn):
    return lambda spark, sf_dir: rounded(fn(*sides(spark, sf_dir, "all")))


def _arm():
    return fd.AssociationRules(SPEC, 0.05, 0.15, 5, 2)


def _rule_text(df):
    return df.select(*[F.concat_ws("&", c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    "tvd_jsd_kld_categorical": _sides(lambda a, b: fd.categorical_distances(a, b, SPEC)),
    "tvd_jsd_kld_binned": _sides(lambda a, b: fd.binned_distances(a, b, SPEC)),
    "ks_wasserstein": _sides(lambda a, b: fd.ordered_distances(a, b, SPEC)),
    "marginals_full": _sides(lambda a, b: fd.marginals(a, b, SPEC)),
    "shape_scores": _sides(lambda a, b: fd.shape_scores(a, b, SPEC)),
    "trend_scores": _sides(lambda a, b: fd.trend_scores(a, b, SPEC)),
    "shape_trend": _sides(lambda a, b: fd.shape_trend(a, b, SPEC)),
    "pearson_matrix": _all(lambda a: fd.numeric_correlations(a, SPEC)),
    "spearman_matrix": _all(lambda a: fd.numeric_correlations(a, SPEC, "spearman")),
    "cramers_v": _all(lambda a: fd.cramers_v(a, SPEC)),
    "eta_squared": _all(lambda a: fd.eta_squared(a, SPEC)),
    "correlations_l2": _sides(lambda a, b: fd.correlations_l2(a, b, SPEC)),
    "entropy": _sides(lambda a, b: fd.entropies(fq.binned(fq.both_sides(a, b, list(SPEC.features)), SPEC, fq.fit_bins([a], SPEC), 20), SPEC.features)),
    "nmi_pairs": _sides(lambda a, b: fd.nmi_pairs(a, b, SPEC)),
    "nmi_score": _sides(lambda a, b: fd.nmi_score(a, b, SPEC)),
    "frequent_itemsets": _sides(lambda a, b: _rule_text(_arm().itemsets(a, a))),
    "rules_real": _sides(lambda a, b: _rule_text(_arm().rules(a, a))),
    "rules_missed": _sides(lambda a, b: _rule_text(_arm().missed(a, b))),
    "rules_hallucinated": _sides(lambda a, b: _rule_text(_arm().hallucinated(a, b))),
    "arm_precision_recall": _sides(lambda a, b: _arm().evaluate(a, b)),
    "frequent_itemsets_of_three": _sides(lambda a, b: _rule_text(fd.AssociationRules(SPEC, 0.02, 0.2, 5, 3).itemsets(a, a))),
    "domain_constraints": _sides(lambda a, b: fd.domain_constraints(a, b, CONSTRAINTS)),
    "feature_histogram": _sides(lambda a, b: fd.histograms(a, b, SPEC)),
    "category_proportions": _sides(lambda a, b: fd.proportions(a, b, SPEC, 4)),
}


def _freq(long: str, x: str = "") -> str:
    return f"""
        l{x} AS ({long}), c{x} AS (SELECT variable, value, sum((side = 0)::INT) AS r, sum((side = 1)::INT) AS s FROM l{x} GROUP BY ALL),
        f{x} AS (SELECT variable, value, r::DOUBLE / sum(r) OVER w AS p, s::DOUBLE / sum(s) OVER w AS q, count(*) OVER w AS n FROM c{x} WINDOW w AS (PARTITION BY variable))"""


_EPS = "2.220446049250313e-16"
_DIST = f"""
    SELECT variable, round(0.5e0 * sum(abs(p - q)), 6) AS tvd,
           round(sqrt(greatest(0e0, 0.5e0 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / ln(2e0))), 6) AS jsd,
           round(sum((p + {_EPS}) / (1 + n * {_EPS}) * ln((p + {_EPS}) / (q + {_EPS}))) / ln(2e0), 6) AS kld
    FROM f GROUP BY variable"""
_ECDF = f"""
    x AS ({long_sql(NUM, cast="DOUBLE")}), xc AS (SELECT variable, value AS x, sum((side = 0)::INT) AS r, sum((side = 1)::INT) AS s FROM x GROUP BY ALL),
    e AS (SELECT variable, x, sum(r) OVER o AS cr, sum(s) OVER o AS cs, lead(x) OVER o AS nx FROM xc WINDOW o AS (PARTITION BY variable ORDER BY x)),
    t AS (SELECT variable, sum(r) AS tr, sum(s) AS ts, max(x) - min(x) AS w FROM xc GROUP BY variable),
    ks AS (SELECT variable, max(abs(cr::DOUBLE / tr - cs::DOUBLE / ts)) AS ks, coalesce(sum(abs(cr::DOUBLE / tr - cs::DOUBLE / ts) * (nx - x)) / nullif(max(w), 0), 0) AS wsd FROM e JOIN t USING (variable) GROUP BY variable)"""
_CATS = f"WITH {BASE_SQL}, {_freq(long_sql(CAT))} {_DIST}"
_BINS = f"WITH {BASE_SQL}, {bins_sql(20)}, {_freq(binned_long_sql(NUM))} {_DIST}"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_ORDERED_PAIRS = list(combinations(SPEC.features, 2))
_PAIR_ROWS = _union(f"SELECT side, '{u}' AS u, '{v}' AS v, {u} AS a, {v} AS b FROM binned" for u, v in _ORDERED_PAIRS)
_MIXED_ROWS = _union(f"SELECT side, '{u}' AS u, '{v}' AS v, {u} AS a, {v} AS b FROM binned" for u, v in _ORDERED_PAIRS if u in CAT or v in CAT)
_CORR = lambda t: _union(f"SELECT '{u}' AS u, '{v}' AS v, corr({u}, {v}) AS value FROM {t}" for u, v in combinations(NUM, 2))
_TREND = f"""
    cells AS (SELECT u, v, a, b, sum((side = 0)::INT) AS r, sum((side = 1)::INT) AS s FROM ({_MIXED_ROWS}) GROUP BY ALL),
    shares AS (SELECT u, v, r::DOUBLE / sum(r) OVER w AS p, s::DOUBLE / sum(s) OVER w AS q FROM cells WINDOW w AS (PARTITION BY u, v)),
    trend AS (SELECT u, v, 1 - 0.5e0 * sum(abs(p - q)) AS score FROM shares GROUP BY u, v
              UNION ALL SELECT a.u, a.v, 1 - abs(b.value - a.value) / 2 FROM ({_CORR("train")}) a JOIN ({_CORR("syn")}) b USING (u, v))"""
_SHAPE = f"{_freq(long_sql(CAT))}, {_ECDF}, shape AS (SELECT variable, 1 - 0.5e0 * sum(abs(p - q)) AS score FROM f GROUP BY variable UNION ALL SELECT variable, 1 - ks FROM ks)"


def _assoc(t: str) -> str:
    def cramer(u, v):
        return f"""SELECT '{u}' AS u, '{v}' AS v, (SELECT coalesce(sqrt(sum(power(coalesce(n, 0) - na * nb / tot, 2) / (na * nb / tot)) / max(tot) / nullif(least(count(DISTINCT a), count(DISTINCT b)) - 1, 0)), 0) FROM
            (SELECT A.{u} AS a, B.{v} AS b, A.n::DOUBLE AS na, B.n::DOUBLE AS nb, C.n AS n, (SELECT count(*) FROM {t})::DOUBLE AS tot FROM (SELECT {u}, count(*) AS n FROM {t} GROUP BY 1) A CROSS JOIN (SELECT {v}, count(*) AS n FROM {t} GROUP BY 1) B
             LEFT JOIN (SELECT {u}, {v}, count(*) AS n FROM {t} GROUP BY 1, 2) C ON A.{u} = C.{u} AND B.{v} = C.{v})) AS value"""

    def eta(u, v):
        return f"SELECT '{u}' AS u, '{v}' AS v, (SELECT sum(n * power(m - g, 2)) / max(tot) FROM (SELECT {u}, count(*) AS n, avg({v}) AS m FROM {t} GROUP BY 1), (SELECT avg({v}) AS g, var_pop({v}) * count(*) AS tot FROM {t})) AS value"

    return _union([_CORR(t), *[cramer(u, v) for u, v in combinations(CAT, 2)], *[eta(u, v) for u in CAT for v in NUM]])


_RANKED = "ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in NUM) + " FROM base)"
_NMI = f"""
    pr AS ({_PAIR_ROWS}), j AS (SELECT side, u, v, a, b, count(*)::DOUBLE AS n FROM pr GROUP BY ALL),
    jp AS (SELECT *, n / sum(n) OVER (PARTITION BY side, u, v) AS p, sum(n) OVER (PARTITION BY side, u, v, a) / sum(n) OVER (PARTITION BY side, u, v) AS pa, sum(n) OVER (PARTITION BY side, u, v, b) / sum(n) OVER (PARTITION BY side, u, v) AS pb FROM j),
    mi AS (SELECT side, u, v, greatest(sum(p * ln(p / (pa * pb))), 0) AS mi FROM jp GROUP BY ALL),
    ent AS (SELECT side, variable, sum(-p * ln(p)) AS h FROM (SELECT side, variable, value, count(*) / sum(count(*)) OVER (PARTITION BY side, variable) AS p FROM ({binned_long_sql(SPEC.features)}) GROUP BY side, variable, value) GROUP BY ALL),
    nmi AS (SELECT mi.side, u, v, coalesce(mi / nullif(sqrt(a.h * b.h), 0), 0) AS nmi FROM mi JOIN ent a ON a.side = mi.side AND a.variable = u JOIN ent b ON b.side = mi.side AND b.variable = v)"""


def _sets(side: int, support: float, size: int) -> str:
    """CTEs i{side} (items of a row), s{side} (frequent sets as a & b)."""
    items = _union(f"SELECT k, '{c}=' || {c} AS item FROM binned WHERE side = {side}" for c in SPEC.features)
    joined = [f"SELECT item AS items, 1 AS size, count(*) AS n FROM i{side} GROUP BY 1", f"SELECT a.item || '&' || b.item, 2, count(*) FROM i{side} a JOIN i{side} b ON a.k = b.k AND a.item < b.item GROUP BY 1"]
    if size > 2:
        joined.append(f"SELECT a.item || '&' || b.item || '&' || c.item, 3, count(*) FROM i{side} a JOIN i{side} b ON a.k = b.k AND a.item < b.item JOIN i{side} c ON b.k = c.k AND b.item < c.item GROUP BY 1")
    return f"i{side} AS ({items}), s{side} AS (SELECT * FROM ({_union(joined)}) WHERE n >= ceil({support}e0 * (SELECT count(*) FROM binned WHERE side = {side})))"


def _rules(side: int, confidence: float) -> str:
    split = "split_part(p.items, '&', {0})"
    one = lambda x, y: f"SELECT {split.format(x)} AS antecedent, {split.format(y)} AS consequent, p.n AS support_n, p.n::DOUBLE / a.n AS confidence FROM s{side} p JOIN s{side} a ON a.items = {split.format(x)} WHERE p.size = 2"
    return f"r{side} AS (SELECT * FROM ({one(1, 2)} UNION ALL {one(2, 1)}) WHERE confidence >= {confidence})"


_ARM = f"WITH {BASE_SQL}, {bins_sql(5, fit=('train',))}, {_sets(0, 0.05, 2)}, {_sets(1, 0.05, 2)}, {_rules(0, 0.15)}, {_rules(1, 0.15)}"
_HOLDS = [("total_gte_50000", "total >= 50000"), ("bal_gt_0", "bal > 0"), ("month_lte_6", "month <= 6"), ("total_gt_bal_and_month_neq_12", "total > bal AND month <> 12"), ("1_lt_month_lt_4", "1 < month AND month < 4")]
_HIST = f"""
    WITH {BASE_SQL}, {bins_sql(20)}, {_freq(binned_long_sql(NUM))}, w AS ({_union(f"SELECT '{c}' AS variable, {c}_lo AS lo, ({c}_hi - {c}_lo) / 20 AS w FROM lim" for c in NUM)})
    SELECT variable, substr(value, 5)::INT AS bin, round(lo + substr(value, 5)::INT * w, 6) AS lo, round(lo + (substr(value, 5)::INT + 1) * w, 6) AS hi, round(p / w, 6) AS real_density, round(q / w, 6) AS syn_density FROM f JOIN w USING (variable)"""

SQL = {
    "tvd_jsd_kld_categorical": _CATS,
    "tvd_jsd_kld_binned": _BINS,
    "ks_wasserstein": f"WITH {BASE_SQL}, {_ECDF} SELECT variable, round(ks, 6) AS ks, round(wsd, 6) AS wsd FROM ks",
    "marginals_full": f"""
        WITH {BASE_SQL}, {_freq(long_sql(CAT))}, cat AS ({_DIST.replace("round(", "(").replace(", 6)", ")")}), {bins_sql(20)}, {_freq(binned_long_sql(NUM), "2")},
        num AS ({_DIST.replace("round(", "(").replace(", 6)", ")").replace("FROM f ", "FROM f2 ")}), {_ECDF}
        {_union([f"SELECT 'num_{n}' AS metric, round(avg({n}), 6) AS value FROM num" for n in ("jsd", "tvd", "kld")] + [f"SELECT 'num_{n}', round(avg({n}), 6) FROM ks" for n in ("ks", "wsd")] + [f"SELECT 'cat_{n}', round(avg({n}), 6) FROM cat" for n in ("jsd", "tvd", "kld")])}""",
    "shape_scores": f"WITH {BASE_SQL}, {_SHAPE} SELECT variable, round(score, 6) AS score FROM shape",
    "trend_scores": f"WITH {BASE_SQL}, {bins_sql(20)}, {_TREND} SELECT u, v, round(score, 6) AS score FROM trend",
    "shape_trend": f"WITH {BASE_SQL}, {_SHAPE}, {bins_sql(20)}, {_TREND} SELECT 'shape' AS metric, round(avg(score), 6) AS value FROM shape UNION ALL SELECT 'trend', round(avg(score), 6) FROM trend",
    "pearson_matrix": f"WITH {BASE_SQL} SELECT u, v, round(value, 6) AS value FROM ({_CORR('base')})",
    "spearman_matrix": f"WITH {BASE_SQL}, {_RANKED} SELECT u, v, round(value, 6) AS value FROM ({_CORR('ranked')})",
    "cramers_v": f"WITH {BASE_SQL} SELECT u, v, round(value, 6) AS value FROM ({_assoc('base')}) WHERE u IN {CAT} AND v IN {CAT}",
    "eta_squared": f"WITH {BASE_SQL} SELECT u, v, round(value, 6) AS value FROM ({_assoc('base')}) WHERE u IN {CAT} AND v IN {NUM}",
    "correlations_l2": f"WITH {BASE_SQL} SELECT 'l2' AS metric, round(sqrt(2 * sum(power(a.value - b.value, 2))), 6) AS value FROM ({_assoc('train')}) a JOIN ({_assoc('syn')}) b USING (u, v)",
    "entropy": f"WITH {BASE_SQL}, {bins_sql(20, fit=('train',))}, {_NMI} SELECT side, variable, round(h, 6) AS h FROM ent",
    "nmi_pairs": f"WITH {BASE_SQL}, {bins_sql(20, fit=('train',))}, {_NMI} SELECT side, u, v, round(nmi, 6) AS nmi FROM nmi",
    "nmi_score": f"WITH {BASE_SQL}, {bins_sql(20, fit=('train',))}, {_NMI} SELECT 'score' AS metric, round(sum(abs(a.nmi + b.nmi) * (1 - abs(a.nmi - b.nmi))) / sum(abs(a.nmi + b.nmi)), 6) AS value FROM nmi a JOIN nmi b USING (u, v) WHERE a.side = 0 AND b.side = 1",
    "frequent_itemsets": f"{_ARM} SELECT items, n FROM s0",
    "rules_real": f"{_ARM} SELECT antecedent, consequent, support_n, round(confidence, 6) AS confidence FROM r0",
    "rules_missed": f"{_ARM} SELECT antecedent, consequent FROM r0 EXCEPT SELECT antecedent, consequent FROM r1",
    "rules_hallucinated": f"{_ARM} SELECT antecedent, consequent FROM r1 EXCEPT SELECT antecedent, consequent FROM r0",
    "arm_precision_recall": f"""{_ARM}, n AS (SELECT (SELECT count(*) FROM r0)::DOUBLE AS r, (SELECT count(*) FROM r1)::DOUBLE AS s, (SELECT count(*) FROM r0 JOIN r1 USING (antecedent, consequent))::DOUBLE AS b)
        SELECT 'precision' AS metric, round(b / nullif(s, 0), 6) AS value FROM n UNION ALL SELECT 'recall', round(b / nullif(r, 0), 6) FROM n UNION ALL SELECT 'n_rules_real', r FROM n UNION ALL SELECT 'n_rules_syn', s FROM n""",
    "frequent_itemsets_of_three": f"WITH {BASE_SQL}, {bins_sql(5, fit=('train',))}, {_sets(0, 0.02, 3)} SELECT items, n FROM s0",
    "domain_constraints": f"WITH {BASE_SQL} " + _union([f"SELECT '{k}_real' AS metric, round(avg(({e})::INT), 6) AS value FROM train" for k, e in _HOLDS] + [f"SELECT '{k}_syn', round(avg(({e})::INT), 6) FROM syn" for k, e in _HOLDS] + [f"SELECT '{k}_syn_n_violations', sum((NOT ({e}))::INT)::DOUBLE FROM syn" for k, e in _HOLDS]),
    "feature_histogram": _HIST,
    "category_proportions": f"""WITH {BASE_SQL}, {_freq(long_sql(CAT))}, ranked AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY p + q DESC, value) AS rn FROM f)
        SELECT variable, CASE WHEN n <= 4 OR rn < 4 THEN value ELSE '__other__' END AS value, round(sum(p), 6) AS real_share, round(sum(q), 6) AS syn_share FROM ranked GROUP BY 1, 2""",
}
SQL = {name: real_sql(sql) for name, sql in SQL.items()}
