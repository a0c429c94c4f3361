"""SQL of the statistical tests, histograms and box-plot numbers."""

from __future__ import annotations

def upper_tail(z: str) -> str:
    """Normal tail; ``z`` is a column name.

    A power series below 2 and a continued fraction above: another way than the engine's, with
    no constants in common.
    """
    size = f"(abs({z}) / sqrt(CAST(2 AS DOUBLE)))"
    term = f"exp(n * (2 * ln({size}) + 2 * ln(2)) + lgamma(n + 1) - lgamma(2 * n + 2))"
    series = f"(1 - 2 / sqrt(pi()) * exp(-{size} * {size}) * {size} * list_sum(list_transform(range(0, 80), lambda n: {term})))"
    steps = f"list_reduce(list_transform(range(400, 0, -1), lambda k: CAST(k AS DOUBLE) / 2), lambda acc, k: k / ({size} + acc))"
    fraction = f"(exp(-{size} * {size}) / sqrt(pi()) / ({size} + {steps}))"
    tail = f"CASE WHEN {size} = 0 THEN CAST(1 AS DOUBLE) WHEN {size} < 2 THEN {series} ELSE {fraction} END"
    return f"((CASE WHEN {z} < 0 THEN 2 - ({tail}) ELSE ({tail}) END) / 2)"


VERDICT = "p <= CAST(0.05 AS DOUBLE) AS reject_h0"
LOGGED = "round(z, 6) AS z, round(p, 12) AS p_value, round(log10(p), 6) AS log10_p"


def rank_steps(source: str, value: str, group: str, a: str, b: str, alternative: str) -> list[tuple[str, str]]:
    side = {"greater": "u", "less": "n_a * n_b - u", "two-sided": "greatest(u, n_a * n_b - u)"}[alternative]
    times = "2 *" if alternative == "two-sided" else ""
    return [
        (
            "rank_rows",
            f"""SELECT {group} = '{a}' AS is_a,
                       rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2 AS r,
                       count(*) OVER (PARTITION BY {value}) AS t
                FROM {source} WHERE {group} IN ('{a}', '{b}') AND {value} IS NOT NULL""",
        ),
        (
            "rank_sums",
            """SELECT CAST(count(*) FILTER (WHERE is_a) AS BIGINT) AS n_a,
                      CAST(count(*) FILTER (WHERE NOT is_a) AS BIGINT) AS n_b,
                      sum(CASE WHEN is_a THEN r ELSE 0 END) AS ranks,
                      sum(CAST(t AS DOUBLE) * t - 1) AS ties
               FROM rank_rows""",
        ),
        (
            "rank_u",
            """SELECT *, CAST(n_a AS DOUBLE) + n_b AS n,
                      ranks - CAST(n_a AS DOUBLE) * (n_a + 1) / 2 AS u FROM rank_sums""",
        ),
        (
            "rank_z",
            f"""SELECT *, ({side} - CAST(n_a AS DOUBLE) * n_b / 2 - CAST(0.5 AS DOUBLE))
                          / sqrt(CAST(n_a AS DOUBLE) * n_b / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM rank_u""",
        ),
        ("rank_p", f"SELECT *, least({times} {upper_tail('z')}, 1) AS p FROM rank_z"),
    ]


RANK_RESULT = f"SELECT n_a, n_b, u, {LOGGED}, {VERDICT}, least(n_a, n_b) <= 8 AS small_sample FROM rank_p"


def share_steps(counts: str) -> list[tuple[str, str]]:
    """Steps of the two-proportion test over a one-row relation n_a, m_a, n_b, m_b."""
    return [
        (
            "share_z",
            f"""SELECT *, m_a / n_a AS p_a, m_b / n_b AS p_b,
                      (m_a / n_a - m_b / n_b)
                      / nullif(sqrt((m_a + m_b) / (n_a + n_b) * (1 - (m_a + m_b) / (n_a + n_b)) * (1 / n_a + 1 / n_b)), 0) AS z
               FROM {counts}""",
        ),
        ("share_side", "SELECT *, -z AS minus_z FROM share_z"),
        ("share_p", f"SELECT *, {upper_tail('minus_z')} AS p FROM share_side"),
    ]


SHARE_RESULT = f"""
    SELECT n_a, m_a, n_b, m_b, round(p_a, 10) AS p_a, round(p_b, 10) AS p_b, {LOGGED},
           p_a * n_a > 10 AND (1 - p_a) * n_a > 10 AND p_b * n_b > 10 AND (1 - p_b) * n_b > 10 AS enough_data,
           {VERDICT}
    FROM share_p"""


def histogram_steps(source: str, value: str, bins: int, by: str | None = None) -> list[tuple[str, str]]:
    """Bin edges written out, and every value counted by range comparison with them."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    same = f"v.{by} = e.{by} AND" if by else ""
    return [
        (
            "hist_span",
            f"""SELECT {key}min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi
                FROM {source} WHERE {value} IS NOT NULL {group}""",
        ),
        (
            "hist_edges",
            f"""SELECT {key}CAST(b AS INT) AS bin, b * ((hi - lo) / {bins}) + lo AS bin_low,
                       CASE WHEN b = {bins - 1} THEN hi ELSE (b + 1) * ((hi - lo) / {bins}) + lo END AS bin_high
                FROM hist_span, range({bins}) r(b)""",
        ),
        (
            "hist",
            f"""SELECT {'e.' + by + ', ' if by else ''}e.bin, round(e.bin_low, 6) AS bin_low,
                       round(e.bin_high, 6) AS bin_high, count(v.{value}) AS count
                FROM hist_edges e LEFT JOIN {source} v
                  ON {same} v.{value} >= e.bin_low
                 AND (v.{value} < e.bin_high OR (e.bin = {bins - 1} AND v.{value} = e.bin_high))
                GROUP BY ALL""",
        ),
    ]


def box_steps(source: str, value: str, quartiles: str) -> list[tuple[str, str]]:
    """Box-plot numbers without groups; ``quartiles`` is the text of the percentile step."""
    return [
        ("box_q", quartiles),
        ("box_f", "SELECT *, q1 - 1.5 * (q3 - q1) AS f_lo, q3 + 1.5 * (q3 - q1) AS f_hi FROM box_q"),
        (
            "box",
            f"""SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
                       least(min(CAST({value} AS DOUBLE)) FILTER (WHERE {value} BETWEEN f_lo AND f_hi), any_value(b.q1)) AS whisker_low,
                       greatest(max(CAST({value} AS DOUBLE)) FILTER (WHERE {value} BETWEEN f_lo AND f_hi), any_value(b.q3)) AS whisker_high,
                       count(*) FILTER (WHERE {value} NOT BETWEEN f_lo AND f_hi) AS outliers
                FROM {source}, box_f b GROUP BY b.q1, b.median, b.q3""",
        ),
    ]
