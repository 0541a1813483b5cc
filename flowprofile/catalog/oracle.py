"""Independent SQL for every query whose result does not depend on iteration or random starts.

Each text is one statement over the driver's table views. Features are called f0..f23 inside, in model order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from flowprofile.catalog.fixtures import BASE_COLUMNS, CLUSTER_SQL, COPIES_SQL, EMBEDDING_RANK_SQL, FEATURE_SQL, ID_SQL, LABEL_SQL, RANK_SQL, rounding
from flowprofile.config import DEFAULT_FEATURES, EVALUATION_ROWS, LABEL_COLUMN

D = range(len(DEFAULT_FEATURES))
F = [f"f{i}" for i in D]
KS = range(2, 9)
DIMENSIONS = 64
QUOTED_LABEL = f'"{LABEL_COLUMN}"'


r = rounding
INTEGERS = {n for n, sql in FEATURE_SQL.items() if sql.startswith("CAST(") and sql.endswith("AS BIGINT)")}
# Rows with equal ranks are ordered by their content, as the sampling operator does.
ORDER = f"{RANK_SQL}, flow_id, " + ", ".join(f"{f} NULLS FIRST" for f in F)


def rounded(**columns: str) -> str:
    return ", ".join(f"{r(f'({sql})')} AS {name}" for name, sql in columns.items())


def pct(part: str, whole: str) -> str:
    return f"coalesce(round_even({part} * 1e0 / nullif({whole}, 0) * 1e2, 2), 0e0)"


def finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


def named(table: str, extra: Sequence[str] = (), label: bool = True, integers: bool = False) -> str:
    """Feature rows under their own names."""
    columns = [*extra]
    for f, n in zip(F, DEFAULT_FEATURES, strict=True):
        columns.append(f'CAST({f} AS BIGINT) AS "{n}"' if integers and n in INTEGERS else f'{r(f)} AS "{n}"')
    return f"SELECT {', '.join([*columns, *([f'label AS {QUOTED_LABEL}'] if label else [])])} FROM {table}"


def each(select: Callable[[int, str], str]) -> str:
    """UNION ALL of one SELECT per feature; `select` gets the ordinal and the internal name."""
    return " UNION ALL ".join(select(i, F[i]) for i in D)


def name(i: int) -> str:
    return "'" + DEFAULT_FEATURES[i] + "'"


# ---- common table expressions, in order of use

_cluster = CLUSTER_SQL.format(label="label", fin=F[17], psh=F[18], ack=F[19])
_base = f"SELECT {', '.join(BASE_COLUMNS)} FROM lineitem"
CTES: list[tuple[str, str]] = [
    ("flows", f"SELECT {ID_SQL} AS flow_id, {', '.join(f'{sql} AS {f}' for f, sql in zip(F, FEATURE_SQL.values(), strict=True))}, "
              f"{LABEL_SQL} AS label FROM ({_base} UNION ALL {_base} WHERE {COPIES_SQL}) b"),
    ("raw", f"SELECT flow_id, {', '.join(f'CASE WHEN NOT isnan(CAST({f} AS DOUBLE)) THEN CAST({f} AS DOUBLE) END AS {f}' for f in F)}, label FROM flows"),
    ("fin", f"SELECT flow_id, {', '.join(f'{finite(f)} AS {f}' for f in F)}, label FROM raw"),
    ("comp", f"SELECT * FROM fin WHERE {' AND '.join(f'{f} IS NOT NULL' for f in F)} AND label IS NOT NULL"),
    ("clean", f"SELECT min(flow_id) AS flow_id, {', '.join(F)}, label, {_cluster} AS cluster FROM comp GROUP BY {', '.join(F)}, label"),
    ("sk", "SELECT " + ", ".join(f"skewness({f}) AS s{i}, min({f}) AS m{i}" for i, f in enumerate(F)) + " FROM clean"),
    ("lg", "SELECT flow_id, " + ", ".join(
        f"CASE WHEN abs(s{i}) > 2 THEN ln(1 + {f} + greatest(-m{i}, 0)) ELSE {f} END AS {f}" for i, f in enumerate(F)) + ", label, cluster FROM clean, sk"),
    ("st", "SELECT " + ", ".join(f"avg({f}) AS a{i}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS d{i}" for i, f in enumerate(F)) + " FROM lg"),
    ("scaled", "SELECT flow_id, " + ", ".join(f"({f} - a{i}) / d{i} AS {f}" for i, f in enumerate(F)) + ", label, cluster FROM lg, st"),
]
CTES += [
    ("cent", f"SELECT cluster, {', '.join(f'avg({f}) AS {f}' for f in F)} FROM scaled GROUP BY cluster"),
    ("dist", "SELECT cluster, count(*) AS n, count(*) * 1e0 / sum(count(*)) OVER () AS share, "
             f"{pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM clean GROUP BY cluster"),
    ("summ", each(lambda i, f: f"SELECT cluster, {i} AS ordinal, {name(i)} AS feature, avg({f}) AS mean FROM clean GROUP BY cluster")),
    ("zs", "SELECT cluster, ordinal, feature, mean, avg(mean) OVER w AS overall, CASE WHEN stddev_samp(mean) OVER w <= 1e-12 * max(abs(mean)) OVER w THEN 0e0 "
           "ELSE (mean - avg(mean) OVER w) / stddev_samp(mean) OVER w END AS z FROM summ WINDOW w AS (PARTITION BY feature)"),
    ("dom", "SELECT * FROM (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(z), 9) DESC, ordinal) AS rank, feature, z FROM zs) x WHERE rank <= 5"),
    ("dev", "SELECT cluster, count(*) AS n_deviating, string_agg(feature, ', ' ORDER BY ordinal) AS names FROM zs WHERE abs(z) > 2 GROUP BY cluster"),
    ("flags", "SELECT dist.cluster, CASE WHEN n_deviating IS NOT NULL AND share < 0.05 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, share, "
              "coalesce(n_deviating, 0) AS n_deviating, coalesce(names, '') AS names, "
              "CASE WHEN n_deviating IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN share < 0.05 THEN 1 ELSE 0 END AS n_reasons "
              "FROM dist LEFT JOIN dev USING (cluster) WHERE n_deviating IS NOT NULL OR share < 0.05"),
]


def _ratio(names: Sequence[str]) -> str:
    return f"avg(CASE WHEN feature IN ({', '.join(repr(n) for n in names)}) THEN mean / greatest(overall, 1e-9) END)"


def _above(feature: str) -> str:
    return f"max(CASE WHEN feature = '{feature}' AND mean > 1.5 * overall THEN 1 ELSE 0 END)"


_TAGS = (
    ("CASE WHEN du < 0.3 THEN {a} WHEN du < 0.7 THEN {b} WHEN du > 2 THEN {c} ELSE {d} END", (
        ("duration_very_short", "very short connections"), ("duration_short_medium", "short to medium duration"),
        ("duration_very_long", "very long duration"), ("duration_moderate", "moderate duration"))),
    ("CASE WHEN vo < 0.3 THEN {a} WHEN vo > 2 THEN {b} WHEN vo > 1.3 THEN {c} END", (
        ("volume_low", "low packet volume"), ("volume_very_high", "very high packet volume"), ("volume_fairly_high", "fairly high packet volume"))),
    ("CASE WHEN ra > 2 THEN {a} WHEN ra < 0.3 THEN {b} END", (("rate_burst", "very high packet rate (burst-like)"), ("rate_low", "low packet rate"))),
    ("CASE WHEN fi = 1 THEN {a} END", (("fin_many", "many FIN connections (connection teardown)"),)),
    ("CASE WHEN ps = 1 THEN {a} END", (("psh_frequent", "frequent PUSH"),)),
)


def _tags(which: int) -> str:
    return ", ".join(t.format(**{k: "'" + p[which] + "'" for k, p in zip("abcd", pairs, strict=False)}) for t, pairs in _TAGS)


CTES += [
    ("told", "SELECT cluster, n, concat_ws(', ', " + _tags(0) + ") AS tags, concat_ws(' — ', 'Cluster ' || cluster || ' (' || format('{:,}', n) || ' flows)', "
             + _tags(1) + ") || '.' AS text FROM (SELECT cluster, " + f"{_ratio(['Flow Duration'])} AS du, "
             f"{_ratio(['Total Length of Fwd Packets', 'Average Packet Size'])} AS vo, {_ratio(['Flow Packets/s', 'Fwd Packets/s'])} AS ra, "
             f"{_above('FIN Flag Count')} AS fi, {_above('PSH Flag Count')} AS ps FROM zs GROUP BY cluster) m JOIN dist USING (cluster)"),
    # New flows: every raw row through the fitted parameters; rows with a gap have no scaled values.
    ("newsc", "SELECT flow_id, concat_ws('; ', " + ", ".join(
        f"CASE WHEN {f} IS NULL THEN 'missing or infinite: {n}' END" for f, n in zip(F, DEFAULT_FEATURES, strict=True)) + ") AS reasons, " + ", ".join(
        f"(CASE WHEN abs(s{i}) > 2 THEN CASE WHEN {f} + greatest(-m{i}, 0) > -1 THEN ln(1 + {f} + greatest(-m{i}, 0)) END ELSE {f} END - a{i}) / d{i} AS {f}"
        for i, f in enumerate(F)) + " FROM fin, sk, st"),
]
_square = " + ".join(f"(n.{f} - c.{f}) * (n.{f} - c.{f})" for f in F)
_CENTER_D = ", ".join(f"sqrt({' + '.join(f'(n.{f} - c{k}.{f}) * (n.{f} - c{k}.{f})' for f in F)}) AS d{k}" for k in range(7))
_CENTER_J = " ".join(f"CROSS JOIN (SELECT * FROM cent WHERE cluster = {k}) c{k}" for k in range(7))
_LEAST = "least(" + ", ".join(f"d{k}" for k in range(7)) + ")"
_NEAREST = "CASE " + " ".join(f"WHEN d{k} = {_LEAST} THEN {k}" for k in range(7)) + " END"
CTES += [
    ("newd", f"SELECT flow_id, {', '.join(f'd{k}' for k in range(7))}, {_LEAST} AS nearest, CAST({_NEAREST} AS INT) AS cluster "
             f"FROM (SELECT n.flow_id, {_CENTER_D} FROM newsc n {_CENTER_J}) x"),
    ("samp", f"SELECT row_number() OVER () AS line, * FROM (SELECT * FROM scaled ORDER BY {ORDER} LIMIT {EVALUATION_ROWS}) o"),
    ("scent", f"SELECT cluster, count(*) AS n, {', '.join(f'avg({f}) AS {f}' for f in F)} FROM samp GROUP BY cluster"),
    ("swith", f"SELECT c.cluster, c.n, avg(sqrt({_square})) AS s, sum({_square}) AS w FROM samp n JOIN scent c USING (cluster) GROUP BY c.cluster, c.n"),
]


def _with(statement: str) -> str:
    """The statement with the expressions it needs in front."""
    order = [n for n, _ in CTES]
    body = dict(CTES)
    needed: set[str] = set()
    pending = [statement]
    while pending:
        sql = pending.pop()
        for n in order:
            if n not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", sql):
                needed.add(n)
                pending.append(body[n])
    # A chain of references only goes backwards, so the listed order is a valid one.
    parts = ", ".join(f"{n} AS MATERIALIZED ({body[n]})" for n in order if n in needed)
    return f"WITH {parts} {statement}" if parts else statement


def _verdict(a: str) -> str:
    return f"CASE WHEN {a} < 0.5 THEN 'Approx. Symmetric' WHEN {a} < 1 THEN 'Moderate Skew' WHEN {a} < 2 THEN 'High Skew' ELSE 'Very High Skew' END"


def _defined(f: str, sql: str) -> str:
    """Aggregate over the column @; undefined when it holds infinite values of both signs."""
    return f"CASE WHEN count_if(isinf({f})) = 0 THEN {sql.replace('@', finite(f))} END"


def _skew(table: str) -> str:
    return each(lambda i, f: f"SELECT {name(i)} AS feature, {_defined(f, 'skewness(@)')} AS s FROM {table}")


def _quantile(f: str, p: float) -> str:
    return f"quantile_cont({f}, {p})"


_FENCES = "q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi"


def _quartiles(i: int, f: str, table: str) -> str:
    return f"(SELECT quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.5) AS q2, quantile_cont({f}, 0.75) AS q3 FROM {table}) x"


def _outliers() -> str:
    one = each(lambda i, f: (
        f"SELECT {name(i)} AS feature, any_value(q1) AS q1, any_value(q3) AS q3, any_value(lo) AS lo, any_value(hi) AS hi, count_if({f} < lo OR {f} > hi) AS c, count(*) AS n "
        f"FROM raw, (SELECT *, {_FENCES} FROM {_quartiles(i, f, 'raw')}) y"))
    two = {"q1": "q1", "q3": "q3", "iqr": "q3 - q1", "lower_bound": "lo", "upper_bound": "hi"}
    columns = ", ".join(f"round_even({sql}, 2) + 0e0 AS {n}" for n, sql in two.items())
    return f"SELECT feature, {columns}, CAST(c AS BIGINT) AS outlier_count, {pct('c', 'n')} AS outlier_pct FROM ({one}) t"


def _boxes() -> str:
    return " UNION ALL ".join(
        f"SELECT {name(i)} AS feature, " + rounded(q1="any_value(q1)", median="any_value(q2)", q3="any_value(q3)",
        whisker_lo=f"least(min(CASE WHEN {F[i]} >= lo AND {F[i]} <= hi THEN {F[i]} END), any_value(q1))",
        whisker_hi=f"greatest(max(CASE WHEN {F[i]} >= lo AND {F[i]} <= hi THEN {F[i]} END), any_value(q3))")
        + f", CAST(count_if({F[i]} < lo OR {F[i]} > hi) AS BIGINT) AS outlier_count FROM raw, (SELECT *, {_FENCES} FROM {_quartiles(i, F[i], 'raw')}) y"
        for i in D)


def _histogram(table: str, features: Sequence[int], bins: int, stage: str = "") -> str:
    edge = f"({{}} * ((hi - lo) / {bins}e0) + lo)"
    b = f"CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT)"
    settle = f"CASE WHEN v < {edge.format('b')} THEN b - 1 WHEN b < {bins - 1} AND v >= {edge.format('(b + 1)')} THEN b + 1 ELSE b END"

    def one(i: int) -> str:
        ends = f"(SELECT CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM (SELECT min({finite(F[i])}) AS a, max({finite(F[i])}) AS z FROM {table}) e)"
        counted = f"(SELECT {settle} AS bin, count(*) AS c FROM (SELECT v, lo, hi, {b} AS b FROM (SELECT {finite(F[i])} AS v FROM {table}) t, {ends} u WHERE v IS NOT NULL) w GROUP BY 1)"
        return (
            f"SELECT {stage}{name(i)} AS feature, CAST(g.bin AS INT) AS bin, " + rounded(bin_lo=edge.format("g.bin"), bin_hi=f"CASE WHEN g.bin = {bins - 1} THEN hi ELSE {edge.format('(g.bin + 1)')} END")
            + f", CAST(coalesce(c, 0) AS BIGINT) AS count FROM {ends} u, (SELECT unnest(range({bins})) AS bin) g LEFT JOIN {counted} k ON k.bin = g.bin")
    return " UNION ALL ".join(one(i) for i in features)


def _pairs(table: str) -> str:
    """Pairwise correlations, i < j, over rows with both present; undefined with infinite values."""
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, CASE WHEN count_if(isinf({F[i]}) OR isinf({F[j]})) = 0 THEN corr({finite(F[i])}, {finite(F[j])}) END AS c FROM {table}"
        for i in D for j in D if i <= j)


def _element(i: str) -> str:
    return "[" + ", ".join(name(k) for k in D) + f"][{i} + 1]"


def _moved() -> tuple[str, str]:
    """One Lloyd step: nearest given centroid, then the means of the scaled rows per nearest centroid."""
    near = _NEAREST
    assigned = f"(SELECT *, {near} AS k FROM (SELECT n.*, {_CENTER_D} FROM scaled n {_CENTER_J}) x)"
    means = f"(SELECT k, count(*) AS size, {', '.join(f'avg({f}) AS {f}' for f in F)} FROM {assigned} y GROUP BY k)"
    return " UNION ALL ".join(
        f"SELECT CAST(k AS INT) AS cluster, CAST(size AS BIGINT) AS size, CAST({i} AS INT) AS ordinal, {r(F[i])} AS value FROM moved" for i in D), means


def _sampled(columns: str, tail: str = "") -> str:
    """Rows of the stratified sample."""
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER}) AS place FROM raw WHERE label IS NOT NULL) s "
        f"JOIN alloc USING (label) WHERE place <= allocated{tail}")


CTES += [
    ("shares", "SELECT label, total, total * 1e0 / sum(total) OVER () * (SELECT count(*) // 3 FROM flows WHERE label IS NOT NULL) AS exact "
               "FROM (SELECT label, count(*) AS total FROM flows WHERE label IS NOT NULL GROUP BY label) c"),
    ("alloc", "SELECT label, total, exact, floor(exact) AS base, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label) <= "
              "(SELECT count(*) // 3 FROM flows WHERE label IS NOT NULL) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS allocated FROM shares"),
    ("moved", _moved()[1]),
]

# ---- trainings from given starts: the first k given centroids (the mean of all rows as the eighth), three Lloyd steps over all scaled rows
GIVEN_KS, GIVEN_ITERATIONS, PLOTTED_ROWS = KS, 3, 20_000


def _nearest_of(k: int, table: str, rows: str) -> str:
    """Rows with `c`, the nearest of k centroids, and `e`, the squared distance to it."""
    squares = ", ".join(f"{' + '.join(f'(n.{f} - m{j}.{f}) * (n.{f} - m{j}.{f})' for f in F)} AS e{j}" for j in range(k))
    joins = " ".join(f"CROSS JOIN (SELECT * FROM {table} WHERE c = {j}) m{j}" for j in range(k))
    least = "least(" + ", ".join(f"e{j}" for j in range(k)) + ")"
    nearest = "CASE " + " ".join(f"WHEN e{j} = {least} THEN {j}" for j in range(k)) + " END"
    return f"SELECT *, {nearest} AS c, {least} AS e FROM (SELECT n.*, {squares} FROM {rows} n {joins}) x"


_MEANS = ", ".join(f"avg({f}) AS {f}" for f in F)
CTES.append(("starts", f"SELECT cluster AS c, {', '.join(F)} FROM cent UNION ALL SELECT 7 AS c, {_MEANS} FROM scaled"))
for _k in GIVEN_KS:
    CTES.append((f"tr{_k}s0", f"SELECT c, {', '.join(F)} FROM starts WHERE c < {_k}"))
    for _step in range(1, GIVEN_ITERATIONS + 1):
        CTES.append((f"tr{_k}s{_step}", f"SELECT c, {_MEANS} FROM ({_nearest_of(_k, f'tr{_k}s{_step - 1}', 'scaled')}) y GROUP BY c"))
    # Sizes and errors belong to the last centroids; clusters are numbered by size, then by centroid.
    _last = f"tr{_k}s{GIVEN_ITERATIONS}"
    CTES.append((f"tr{_k}n", f"SELECT c, count(*) AS size, sum(e) AS error FROM ({_nearest_of(_k, _last, 'scaled')}) y GROUP BY c"))
    CTES.append((f"tr{_k}", f"SELECT {_k} AS k, row_number() OVER (ORDER BY size DESC, {', '.join(F)}) - 1 AS cluster, size, error, {', '.join(F)} FROM {_last} JOIN tr{_k}n USING (c)"))
    CTES.append((f"tr{_k}c", f"SELECT cluster AS c, {', '.join(F)} FROM tr{_k}"))
CTES += [
    ("small", f"SELECT row_number() OVER () AS line, {', '.join(F)} FROM (SELECT * FROM scaled ORDER BY {ORDER} LIMIT {EVALUATION_ROWS}) o"),
    ("labs", " UNION ALL ".join(f"SELECT {k} AS k, line, c, {', '.join(F)} FROM ({_nearest_of(k, f'tr{k}c', 'small')}) y" for k in GIVEN_KS)),
    ("lpair", f"SELECT a.k, a.line, a.c AS ca, b.c AS cb, count(*) AS n, sum(sqrt({' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in F)})) AS d "
              "FROM labs a JOIN labs b ON a.k = b.k AND a.line <> b.line GROUP BY a.k, a.line, a.c, b.c"),
    ("lsil", "SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM "
             "(SELECT k, line, max(CASE WHEN ca = cb THEN d / n END) AS a, min(CASE WHEN ca <> cb THEN d / n END) AS b FROM lpair GROUP BY k, line) p GROUP BY k"),
    ("lcen", f"SELECT k, c, count(*) AS n, {_MEANS} FROM labs GROUP BY k, c"),
    ("lwith", f"SELECT c.k, c.c, c.n, avg(sqrt({_square})) AS s, sum({_square}) AS w FROM labs n JOIN lcen c ON c.k = n.k AND c.c = n.c GROUP BY c.k, c.c, c.n"),
    ("ldb", f"SELECT k, avg(worst) AS davies_bouldin FROM (SELECT a.k, a.c, max((x.s + y.s) / sqrt({' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in F)})) AS worst "
            "FROM lcen a JOIN lcen b ON a.k = b.k AND a.c <> b.c JOIN lwith x ON x.k = a.k AND x.c = a.c JOIN lwith y ON y.k = b.k AND y.c = b.c GROUP BY a.k, a.c) t GROUP BY k"),
    ("lch", f"SELECT a.k, sum(a.n * ({' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in F)})) * (sum(a.n) - count(*)) / (sum(x.w) * (count(*) - 1)) AS calinski_harabasz "
            f"FROM lcen a JOIN lwith x ON x.k = a.k AND x.c = a.c, (SELECT {_MEANS} FROM small) b GROUP BY a.k"),
    ("stop", f"SELECT 1e-9 * ({' + '.join(f'var_pop({f})' for f in F)}) / {len(F)} AS stop FROM scaled"),
    ("shifts", " UNION ALL ".join(
        f"SELECT {k} AS k, {j} AS step, sum({' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in F)}) AS shift FROM tr{k}s{j} a JOIN tr{k}s{j - 1} b USING (c)"
        for k in GIVEN_KS for j in range(1, GIVEN_ITERATIONS + 1))),
    ("iterations", f"SELECT k, coalesce(min(CASE WHEN shift <= stop THEN step END), {GIVEN_ITERATIONS}) AS n_iter FROM shifts, stop GROUP BY k"),
    ("errors", " UNION ALL ".join(f"SELECT {k} AS k, sum(error) AS inertia FROM tr{k}" for k in GIVEN_KS)),
]
_WEIGHT = "0.2041241452319315e0"
_SIGNS = ([1] * len(F), [1 if i % 2 == 0 else -1 for i in D])


def _component(which: int, center: bool = True) -> str:
    return "(" + " + ".join(f"({f}{f' - p{i}' if center else ''}) * {_WEIGHT} * {_SIGNS[which][i]}" for i, f in enumerate(F)) + ")"


_PCA_MEANS = f"(SELECT {', '.join(f'avg({f}) AS p{i}' for i, f in enumerate(F))} FROM scaled) means"


def _trained(k: int) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(k AS INT) AS k, CAST(cluster AS INT) AS cluster, CAST(size AS BIGINT) AS size, CAST({i} AS INT) AS ordinal, {r(F[i])} AS value FROM tr{k}" for i in D)


# ---- embeddings: every clustering label % k
_EMB = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(DIMENSIONS))
_SQ = "pow(list_distance({a}, {b}), 2)"
CTES += [
    ("emb", f"SELECT vec_id, label, [{_EMB}] AS v FROM embeddings ORDER BY {EMBEDDING_RANK_SQL} LIMIT {EVALUATION_ROWS}"),
    ("epair", "SELECT a.vec_id AS i, a.label AS la, b.label AS lb, count(*) AS n, sum(list_distance(a.v, b.v)) AS d "
              "FROM emb a JOIN emb b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label"),
    ("ek", f"SELECT unnest([{', '.join(map(str, KS))}]) AS k"),
    ("esum", "SELECT k, i, la % k AS own, lb % k AS other, sum(n) AS n, sum(d) AS d FROM epair, ek GROUP BY ALL"),
    ("epoint", "SELECT k, i, max(CASE WHEN own = other THEN d / n END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM esum GROUP BY k, i"),
    ("esil", "SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM epoint GROUP BY k"),
    ("elong", f"SELECT k, label % k AS c, vec_id, v, unnest(range({DIMENSIONS})) AS j, unnest(v) AS x FROM emb, ek"),
    ("ecen", "SELECT k, c, list(m ORDER BY j) AS center FROM (SELECT k, c, j, avg(x) AS m FROM elong GROUP BY k, c, j) t GROUP BY k, c"),
    ("egap", f"SELECT k, c, center, {_SQ.format(a='v', b='center')} AS gap FROM (SELECT k, label % k AS c, v FROM emb, ek) e JOIN ecen USING (k, c)"),
    ("eper", "SELECT k, c, any_value(center) AS center, count(*) AS n, avg(sqrt(gap)) AS s, sum(gap) AS w FROM egap GROUP BY k, c"),
    ("emean", "SELECT list(m ORDER BY j) AS mean FROM (SELECT j, avg(x) AS m FROM elong WHERE k = 2 GROUP BY j) t"),
    ("edb", f"SELECT k, avg(worst) AS davies_bouldin FROM (SELECT a.k, a.c, max((a.s + b.s) / sqrt({_SQ.format(a='a.center', b='b.center')})) AS worst "
            "FROM eper a JOIN eper b ON a.k = b.k AND a.c <> b.c GROUP BY a.k, a.c) t GROUP BY k"),
    ("ech", f"SELECT k, sum(n * {_SQ.format(a='center', b='mean')}) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)) AS calinski_harabasz FROM eper, emean GROUP BY k"),
    ("emet", "SELECT CAST(k AS INT) AS k, silhouette, davies_bouldin, calinski_harabasz FROM esil JOIN edb USING (k) JOIN ech USING (k)"),
]


def _moments(table: str, what: dict[str, str], prefix: str = "") -> str:
    return each(lambda i, f: f"SELECT {prefix}{name(i)} AS feature, " + rounded(**{k: v.replace("{f}", f) for k, v in what.items()}) + f" FROM {table}")


def _count(sql: str, alias: str) -> str:
    return f"CAST({sql} AS BIGINT) AS {alias}"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["load_flows"] = named("raw", integers=True)
    out["separate_labels"] = out["select_features"] = named("raw", label=False, integers=True)
    out["sample_allocation"] = f"SELECT label, {_count('total', 'total')}, {rounded(exact='exact')}, {_count('base', 'base')}, {_count('allocated', 'allocated')} FROM alloc"
    sample = _sampled("flow_id, " + ", ".join(F) + ", label")
    out["stratified_sample"] = named(f"({sample}) t", ["flow_id"], integers=True)
    out["write_sample"] = named(f"({sample}) t", ["flow_id"], integers=True)
    out["sample_distribution"] = (
        f"SELECT 'full' AS part, label, {_count('total', 'count')}, {r(pct('total', 'sum(total) OVER ()'))} AS percent FROM alloc UNION ALL "
        f"SELECT 'sample', label, CAST(c AS BIGINT), {r(pct('c', 'sum(c) OVER ()'))} FROM (SELECT label, count(*) AS c FROM ({sample}) t GROUP BY label) u")
    out["uniform_sample"] = named(f"(SELECT * FROM raw ORDER BY {ORDER} LIMIT {EVALUATION_ROWS}) t", ["flow_id"], integers=True)
    out["preview"] = named(f"(SELECT * FROM raw ORDER BY flow_id, {', '.join(F)} LIMIT 10) t", ["flow_id"], integers=True)

    # profiling
    columns = [*F, "label"]
    missing = " UNION ALL ".join(
        f"SELECT {name(i) if i < len(F) else repr(LABEL_COLUMN)} AS feature, count_if({c} IS NULL) AS m, {f'count_if(isinf({c}))' if i < len(F) else '0'} AS f, count(*) AS n FROM raw"
        for i, c in enumerate(columns))
    shown = f"feature, {_count('m', 'missing_count')}, {r(pct('m', 'n'))} AS missing_pct, {_count('f', 'inf_count')}"
    out["dataset_overview"] = f"SELECT {_count('max(n)', 'n_rows')}, {_count(str(len(columns)), 'n_columns')}, {_count(str(len(F)), 'n_numeric')}, {_count('sum(m + f)', 'n_missing_or_inf')} FROM ({missing}) t"
    out["missing_report"] = f"SELECT {shown}, {_count('m + f', 'total_issues')} FROM ({missing}) t"
    out["missing_info"] = f"SELECT {shown} FROM ({missing}) t WHERE m + f > 0"

    def four(f: str) -> dict[str, str]:
        return {"mean": _defined(f, "avg(@)"), "std": _defined(f, "stddev_samp(@)"), "min": f"min({f})", "max": f"max({f})"}
    out["describe"] = each(lambda i, f: f"SELECT {name(i)} AS feature, {_count(f'count({f})', 'count')}, " + rounded(
        **four(f), q25=_quantile(f, 0.25), q50=_quantile(f, 0.5), q75=_quantile(f, 0.75)) + " FROM raw")
    out["scale_before_after"] = _moments("lg", four("{f}"), "'before' AS stage, ") + " UNION ALL " + _moments("scaled", four("{f}"), "'after' AS stage, ")
    skew = f"feature, {rounded(skewness='s', abs_skewness='abs(s)')}, {_verdict('abs(s)')} AS verdict"
    out["skewness_info"] = f"SELECT {skew} FROM ({_skew('clean')}) t"
    out["very_skewed"] = f"SELECT {skew} FROM ({_skew('raw')}) t WHERE abs(s) > 2"
    out["outlier_info"] = _outliers()
    pairs = _pairs("raw")
    out["correlation_matrix"] = (
        f"SELECT {_element('i')} AS feature_1, {_element('j')} AS feature_2, {r('c')} AS correlation FROM ({pairs}) t UNION ALL "
        f"SELECT {_element('j')}, {_element('i')}, {r('c')} FROM ({pairs}) t WHERE i < j")
    out["top_correlations"] = (
        f"SELECT feature_1, feature_2, {r('c')} AS correlation FROM (SELECT {_element('i')} AS feature_1, {_element('j')} AS feature_2, c FROM ({pairs}) t "
        "WHERE i < j AND c IS NOT NULL ORDER BY abs(c) DESC, feature_1, feature_2 LIMIT 10) u")
    out["column_profile"] = each(lambda i, f: (
        f"SELECT {name(i)} AS feature, '{'bigint' if DEFAULT_FEATURES[i] in INTEGERS else 'double'}' AS dtype, {_count(f'count({f})', 'non_null')}, "
        f"{_count(f'count_if({f} IS NULL)', 'nulls')}, {_count(f'count(DISTINCT {f})', 'n_unique')}, "
        + rounded(mean=_defined(f, "avg(@)"), median=_quantile(f, 0.5), std=_defined(f, "stddev_samp(@)"), min=f"min({f})", max=f"max({f})",
                  q1=_quantile(f, 0.25), q3=_quantile(f, 0.75), skewness=_defined(f, "skewness(@)"))
        + f", {_verdict('abs(' + _defined(f, 'skewness(@)') + ')')} AS verdict FROM raw")) + (
        f" UNION ALL SELECT '{LABEL_COLUMN}', 'string', count(label), count_if(label IS NULL), count(DISTINCT label), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM raw")
    out["value_counts"] = (
        f"SELECT label AS value, {_count('c', 'count')}, {r(pct('c', '(SELECT count(*) FROM raw)'))} AS percentage FROM (SELECT label, count(*) AS c FROM raw WHERE label IS NOT NULL GROUP BY label) t")
    out["histogram"] = _histogram("raw", D, 50)
    out["histogram_before_after"] = _histogram("lg", D, 40, "'before' AS stage, ") + " UNION ALL " + _histogram("scaled", D, 40, "'after' AS stage, ")
    out["box_stats"] = _boxes()
    out["feature_ranges"] = _moments("clean", {"median": "quantile_cont({f}, 0.5)", "min": "min({f})", "max": "max({f})"})

    # cleaning and scaling
    out["inf_to_null"] = named("fin")
    out["clean_drop"] = named("comp")
    for how, fill in (("mean", "avg({f})"), ("median", "quantile_cont({f}, 0.5)")):
        fills = ", ".join(f"{fill.replace('{f}', f)} AS v{i}" for i, f in enumerate(F))
        filled = f"SELECT DISTINCT {', '.join(f'coalesce({f}, v{i}) AS {f}' for i, f in enumerate(F))}, label FROM fin, (SELECT {fills} FROM fin) m"
        out[f"clean_fill_{how}"] = named(f"({filled}) t")
    out["deduplicate"] = named("clean")
    out["clean_report"] = (
        f"SELECT {_count('b', 'rows_before')}, {_count('a', 'rows_after')}, {_count('b - a', 'rows_removed')}, {rounded(removed_pct='coalesce((b - a) * 1e2 / nullif(b, 0), 0)')} "
        "FROM (SELECT (SELECT count(*) FROM flows) AS b, (SELECT count(*) FROM clean) AS a) t")
    out["skewed_features"] = f"SELECT feature FROM ({_skew('clean')}) t WHERE abs(s) > 2"
    out["log_shifts"] = _moments("clean", {"shift": "greatest(-min({f}), 0)"})
    out["log_transform"] = named("lg")

    def scaled(center: str, spread: str) -> str:
        params = ", ".join(f"{center.replace('{f}', f)} AS a{i}, {spread.replace('{f}', f)} AS d{i}" for i, f in enumerate(F))
        body = ", ".join(f"({f} - a{i}) / CASE WHEN d{i} = 0 THEN 1 ELSE d{i} END AS {f}" for i, f in enumerate(F))
        return named(f"(SELECT {body}, label FROM clean, (SELECT {params} FROM clean) p) t")
    out["scale_standard"] = scaled("avg({f})", "stddev_pop({f})")
    out["scale_minmax"] = scaled("min({f})", "max({f}) - min({f})")
    out["scale_robust"] = scaled("quantile_cont({f}, 0.5)", "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)")
    out["scale_none"] = named("clean")
    out["preprocess"] = named("scaled")
    out["preprocess_parameters"] = " UNION ALL ".join(
        f"SELECT {name(i)} AS feature, CAST({i} AS INT) AS ordinal, CAST(CASE WHEN abs(s{i}) > 2 THEN 1 ELSE 0 END AS INT) AS log, "
        + rounded(shift=f"CASE WHEN abs(s{i}) > 2 THEN greatest(-m{i}, 0) ELSE 0 END", center=f"a{i}", scale=f"d{i}") + " FROM sk, st" for i in D)
    out["transform_new"] = named("newsc", ["flow_id", "reasons"], label=False)

    log = "CASE WHEN abs(s{i}) > 2 THEN {a} ELSE 0e0 END"
    bundle = [f"SELECT 'centroids' AS part, CAST(cluster AS VARCHAR) AS name, CAST({i} AS INT) AS ordinal, {r(f)} AS value FROM cent" for i, f in enumerate(F)]
    for i in D:
        for at, sql in enumerate((log.format(i=i, a="1e0"), log.format(i=i, a=f"greatest(-m{i}, 0)"), f"a{i}", f"d{i}")):
            bundle.append(f"SELECT 'parameters', {name(i)}, CAST({at} AS INT), {r(f'({sql})')} FROM sk, st")
    features = ",".join(DEFAULT_FEATURES)
    bundle += [f"SELECT 'metadata', '{features}', CAST({at} AS INT), {r(f'({sql})')}" for at, sql in enumerate(("7e0", "0.5e0", "3e0"))]
    out["save_bundle"] = out["load_bundle"] = " UNION ALL ".join(bundle)

    # trainings from given starts
    out["train_multiple_k"] = " UNION ALL ".join(_trained(k) for k in GIVEN_KS)
    out["training_summary"] = f"SELECT CAST(k AS INT) AS k, {rounded(inertia='inertia')}, CAST(n_iter AS INT) AS n_iter FROM errors JOIN iterations USING (k)"
    out["elbow_series"] = f"SELECT CAST(k AS INT) AS k, {rounded(inertia='inertia')} FROM errors"
    out["evaluate_k"] = (
        f"SELECT CAST(k AS INT) AS k, {rounded(silhouette='silhouette', davies_bouldin='davies_bouldin', calinski_harabasz='calinski_harabasz', inertia='inertia')} "
        "FROM lsil JOIN ldb USING (k) JOIN lch USING (k) JOIN errors USING (k)")

    # given components
    out["pca_project"] = f"SELECT flow_id, {r(_component(0))} AS PC1, {r(_component(1))} AS PC2 FROM scaled, {_PCA_MEANS}"
    variances = " + ".join(f"var_samp({f})" for f in F)
    ratio = [f"var_samp({_component(k, False)}) / ({variances})" for k in (0, 1)]
    out["pca_explained_variance"] = (
        f"SELECT 'PC1' AS component, {rounded(ratio=ratio[0], cumulative=ratio[0])} FROM scaled UNION ALL "
        f"SELECT 'PC2', {rounded(ratio=ratio[1], cumulative=f'{ratio[0]} + {ratio[1]}')} FROM scaled")
    out["pca_scatter"] = (
        f"SELECT {r(_component(0))} AS PC1, {r(_component(1))} AS PC2, cluster FROM (SELECT * FROM scaled ORDER BY {ORDER} LIMIT {PLOTTED_ROWS}) o, {_PCA_MEANS}")

    # given assignment and centroids
    out["assign_clusters"] = f"SELECT flow_id, CAST({_NEAREST} AS INT) AS cluster FROM (SELECT n.flow_id, {_CENTER_D} FROM scaled n {_CENTER_J}) x"
    out["lloyd_step"] = _moved()[0]
    out["silhouette"] = (
        f"SELECT {rounded(silhouette='avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)')} FROM (SELECT i, max(CASE WHEN ca = cb THEN d / n END) AS a, "
        "min(CASE WHEN ca <> cb THEN d / n END) AS b FROM (SELECT a.line AS i, a.cluster AS ca, b.cluster AS cb, count(*) AS n, sum(array_distance(a.v, b.v)) AS d "
        f"FROM (SELECT line, cluster, [{', '.join(F)}]::DOUBLE[{len(F)}] AS v FROM samp) a JOIN (SELECT line, cluster, [{', '.join(F)}]::DOUBLE[{len(F)}] AS v FROM samp) b "
        "ON a.line <> b.line GROUP BY a.line, a.cluster, b.cluster) p GROUP BY i) q")
    pair = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in F)
    out["davies_bouldin"] = (
        f"SELECT {rounded(davies_bouldin='avg(worst)')} FROM (SELECT a.cluster, max((x.s + y.s) / sqrt({pair})) AS worst FROM scent a JOIN scent b ON a.cluster <> b.cluster "
        "JOIN swith x ON x.cluster = a.cluster JOIN swith y ON y.cluster = b.cluster GROUP BY a.cluster) t")
    overall = ", ".join(f"avg({f}) AS {f}" for f in F)
    out["calinski_harabasz"] = (
        f"SELECT {rounded(calinski_harabasz='sum(a.n * (' + pair + ')) * (sum(a.n) - count(*)) / (sum(x.w) * (count(*) - 1))')} FROM scent a JOIN swith x USING (cluster), (SELECT {overall} FROM samp) b")
    out["inertia"] = f"SELECT {rounded(inertia=f'sum({_square})')} FROM scaled n JOIN cent c USING (cluster)"
    out["compare_clusterings"] = f"SELECT k, {rounded(silhouette='silhouette', davies_bouldin='davies_bouldin', calinski_harabasz='calinski_harabasz')} FROM emet"
    out["best_k"] = "SELECT k FROM emet WHERE silhouette IS NOT NULL ORDER BY silhouette DESC, k LIMIT 1"
    out["metric_winners"] = " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS metric, k, {r(m)} AS value FROM emet ORDER BY {m} {way}, k LIMIT 1) {m}_"
        for m, way in (("silhouette", "DESC"), ("calinski_harabasz", "DESC"), ("davies_bouldin", "ASC")))

    # interpretation
    out["cluster_distribution"] = f"SELECT cluster, {_count('n', 'count')}, {r('percentage')} AS percentage FROM dist"
    out["cluster_summary"] = f"SELECT cluster, feature, {r('mean')} AS mean FROM summ"
    profiles = each(lambda i, f: f"SELECT cluster, {name(i)} AS feature, count(*) AS n, avg({f}) AS a, quantile_cont({f}, 0.5) AS m FROM clean GROUP BY cluster")
    out["cluster_profiles"] = " UNION ALL ".join(
        f"SELECT cluster, '{stat}' AS stat, feature, {r(f'CAST({c} AS DOUBLE)')} AS value FROM ({profiles}) t" for stat, c in (("count", "n"), ("mean", "a"), ("median", "m")))
    out["profile_zscores"] = f"SELECT cluster, feature, {r('z')} AS z FROM zs"
    out["dominant_features"] = f"SELECT cluster, CAST(rank AS INT) AS rank, feature, {r('z')} AS z FROM dom"
    out["cluster_narrative"] = f"SELECT cluster, {_count('n', 'count')}, tags, text FROM told"
    out["anomaly_flags"] = f"SELECT cluster, severity, {rounded(share='share')}, {_count('n_deviating', 'n_deviating')}, names AS deviating_features FROM flags"
    out["label_by_cluster"] = f"SELECT cluster, label, {_count('count(*)', 'count')} FROM clean WHERE label IS NOT NULL GROUP BY cluster, label"
    out["label_crosstab"] = "SELECT cluster, " + ", ".join(f"CAST(count_if(label = '{v}') AS BIGINT) AS \"{v}\"" for v in ("BENIGN", "Brute Force", "DoS")) + " FROM clean GROUP BY cluster"

    # other tables
    orders = "SELECT o_orderpriority, count(*) AS total, count(*) * 1e0 / sum(count(*)) OVER () * (SELECT count(*) // 4 FROM orders) AS exact FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"
    quotas = (
        "SELECT o_orderpriority, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, o_orderpriority) <= "
        f"(SELECT count(*) // 4 FROM orders) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM ({orders}) s")
    out["stratified_orders"] = (
        f"SELECT o_orderkey, o_orderpriority, {r('o_totalprice')} AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY "
        f"o_orderkey % 2147483647 * 48271 % 2147483647, o_orderkey) AS place FROM orders) o JOIN ({quotas}) q USING (o_orderpriority) WHERE place <= quota")

    def skewness(table: str, columns: Sequence[str]) -> str:
        found = " UNION ALL ".join(f"SELECT '{c}' AS feature, skewness({c}) AS s FROM {table}" for c in columns)
        return f"SELECT feature, {rounded(skewness='s', abs_skewness='abs(s)')}, {_verdict('abs(s)')} AS verdict FROM ({found}) t"
    out["event_skewness"] = skewness("events", ["value"])
    out["symmetric_columns"] = skewness("lineitem", ["l_quantity", "l_discount", "l_tax"])
    out["event_values"] = (
        f"SELECT event_type AS value, {_count('c', 'count')}, {r(pct('c', '(SELECT count(*) FROM events)'))} AS percentage "
        "FROM (SELECT event_type, count(*) AS c FROM events WHERE event_type IS NOT NULL GROUP BY event_type) t")
    out["customer_balances"] = f"SELECT c_custkey, {r('ln(1 + c_acctbal + low)')} AS c_acctbal FROM customer, (SELECT greatest(-min(c_acctbal), 0) AS low FROM customer) m"

    # scoring
    out["score_flows"] = out["score_stream"] = out["score_stream_bundle"] = (
        f"SELECT flow_id, cluster, {r('nearest')} AS nearest_distance, " + ", ".join(f"{r(f'd{k}')} AS distance_{k}" for k in range(7)) + " FROM newd")
    ranking = " UNION ALL ".join(f"SELECT line, flow_id, {k} AS cluster, d{k} AS d FROM (SELECT row_number() OVER () AS line, * FROM newd) n" for k in range(7))
    out["distance_ranking"] = (
        f"SELECT flow_id, CAST(cluster AS INT) AS cluster, {r('d')} AS distance, row_number() OVER (PARTITION BY line ORDER BY d, cluster) AS rank FROM ({ranking}) t WHERE d IS NOT NULL")
    out["score_context"] = (
        f"SELECT flow_id, newd.cluster, {r('nearest')} AS nearest_distance, {_count('dist.n', 'cluster_size')}, {r('dist.percentage')} AS cluster_pct, severity, "
        "CAST(n_reasons AS INT) AS reasons, told.text, dominant FROM newd JOIN dist USING (cluster) LEFT JOIN flags USING (cluster) LEFT JOIN told USING (cluster) "
        "LEFT JOIN (SELECT cluster, string_agg(feature, ', ' ORDER BY rank) AS dominant FROM dom GROUP BY cluster) t USING (cluster)")
    medians = ", ".join(f"quantile_cont({f}, 0.5) AS {f}" for f in F)
    means = ", ".join(f"avg({f}) AS {f}" for f in F)
    preset = (
        f"SELECT 'median' AS preset, {medians} FROM clean UNION ALL SELECT 'cluster_1', {means} FROM clean WHERE cluster = 1 UNION ALL SELECT 'cluster_6', {means} FROM clean WHERE cluster = 6")
    pscaled = ", ".join(f"(CASE WHEN abs(s{i}) > 2 THEN ln(1 + {f} + greatest(-m{i}, 0)) ELSE {f} END - a{i}) / d{i} AS {f}" for i, f in enumerate(F))
    original = ", ".join(f"{f} AS o{i}" for i, f in enumerate(F))
    out["preset_flows"] = (
        "SELECT preset, " + ", ".join(f'{r(f"o{i}")} AS "{n}"' for i, n in enumerate(DEFAULT_FEATURES)) + f", CAST({_NEAREST} AS INT) AS cluster, {r(_LEAST)} AS nearest_distance "
        f"FROM (SELECT n.*, {_CENTER_D} FROM (SELECT preset, {original}, {pscaled} FROM ({preset}) p, sk, st) n {_CENTER_J}) x")
    return {key: _with(sql) for key, sql in out.items()}
