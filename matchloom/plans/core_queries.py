"""Queries of the general operators and the SQL they are checked against."""

from __future__ import annotations

from matchloom.operators import orphans, reconcile

_KEY = r"""CASE WHEN upper(regexp_replace({c}, '[\s\p{{Z}}\p{{Pd}}]+', '', 'g')) NOT IN ('', 'NULL')
 THEN regexp_replace(upper(regexp_replace({c}, '[\s\p{{Z}}\p{{Pd}}]+', '', 'g')), '^([^0-9]*)0+([0-9])', '\1\2') END"""


def _judged() -> str:
    parts = []
    for child, column, parent, key in orphans.SALES_LINKS:
        parts.append(
            f"SELECT '{child}' AS child_table, '{column}' AS ref_column, c.row_id, c.loaded_at, "
            "CASE WHEN p.k IS NULL THEN 'missing' WHEN p.alive_from IS NULL THEN 'deleted' WHEN p.alive_from > c.loaded_at THEN 'late' END AS reason "
            f"FROM (SELECT row_id, loaded_at, {_KEY.format(c=column)} AS k FROM {child}) c LEFT JOIN "
            f"(SELECT {_KEY.format(c=key)} AS k, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS alive_from FROM {parent} GROUP BY 1) p ON c.k = p.k "
            "WHERE c.k IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


def _snapshots() -> str:
    """Listed references as they stood at the end of each calendar year with loads or deletions, the last end open (null)."""
    tables = sorted({t for child, _, parent, _ in orphans.SALES_LINKS for t in (child, parent)})
    parents = sorted({parent for _, _, parent, _ in orphans.SALES_LINKS})
    times = " UNION ALL ".join([f"SELECT loaded_at AS t FROM {t}" for t in tables] + [f"SELECT deleted_at FROM {t}" for t in parents])
    refs, rows = [], []
    for child, column, parent, _ in orphans.SALES_LINKS:
        refs.append(f"SELECT '{child}' AS child_table, '{column}' AS ref_column, '{parent}' AS parent, {_KEY.format(c=column)} AS k, loaded_at FROM {child}")
    for parent, key in {parent: key for _, _, parent, key in orphans.SALES_LINKS}.items():
        rows.append(f"SELECT '{parent}' AS parent, {_KEY.format(c=key)} AS k, loaded_at, deleted_at FROM {parent}")
    return (
        f"WITH y AS (SELECT DISTINCT year(t) AS y FROM ({times}) WHERE t IS NOT NULL), "
        "e AS (SELECT y, CASE WHEN y < (SELECT max(y) FROM y) THEN make_timestamp(y + 1, 1, 1, 0, 0, 0) END AS before FROM y), "
        f"r AS ({' UNION ALL '.join(refs)}), p AS ({' UNION ALL '.join(rows)}), "
        "i AS (SELECT y, parent, k, min(loaded_at) FILTER (WHERE deleted_at IS NULL OR deleted_at >= before) AS alive_from FROM p, e WHERE k IS NOT NULL AND (before IS NULL OR loaded_at < before) GROUP BY ALL), "
        "j AS (SELECT e.before, child_table, ref_column, CASE WHEN i.k IS NULL THEN 'missing' WHEN alive_from IS NULL THEN 'deleted' WHEN alive_from > r.loaded_at THEN 'late' END AS reason "
        "FROM r JOIN e ON r.k IS NOT NULL AND (e.before IS NULL OR r.loaded_at IS NULL OR r.loaded_at < e.before) LEFT JOIN i ON i.y = e.y AND i.parent = r.parent AND i.k = r.k) "
        "SELECT before, child_table, ref_column, reason, count(*) AS orphans FROM j WHERE reason IS NOT NULL GROUP BY ALL"
    )


_TEXT = r"regexp_replace(lower(regexp_replace(nfc_normalize({c}), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
_DATE = (
    r"regexp_replace(regexp_replace(regexp_replace(trim({c}), '^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})[ T]00:00(:00(\.0+)?)?$', '\1'), "
    r"'^([0-9]{{4}})-([0-9])-', '\1-0\2-'), '^([0-9]{{4}}-[0-9]{{2}})-([0-9])($|[ T])', '\1-0\2\3')"
)


def _canonical_rows(side: str, sign: int) -> str:
    return (
        f"SELECT submission_id, answer_view, upper(trim(makh)) AS makh, {_TEXT.format(c='tenkh')} AS tenkh, "
        "CASE WHEN NOT isnan(tongtien) THEN round_even(tongtien, 2) + 0.0 END AS tongtien, "
        f"{_DATE.format(c='ngayhd')} AS ngayhd, {sign} AS one FROM view_output_{side}"
    )


_NET = (
    f"WITH r AS ({_canonical_rows('answer', 1)} UNION ALL {_canonical_rows('student', -1)}), "
    "d AS (SELECT submission_id, answer_view, makh, tenkh, tongtien, ngayhd, sum(one)::BIGINT AS net FROM r GROUP BY ALL HAVING sum(one) <> 0)"
)
_UNEQUAL = "submission_id, answer_view, makh FROM (SELECT submission_id, answer_view, makh, {f}, sum(net) AS net FROM d GROUP BY ALL) GROUP BY ALL HAVING sum(net) = 0 AND bool_or(net <> 0)"
_FIELD_DIFFERENCES = (
    _NET
    + " SELECT submission_id, answer_view, makh, CASE WHEN sum(net) > 0 THEN 'answer_only' ELSE 'student_only' END AS diff FROM d GROUP BY 1, 2, 3 HAVING sum(net) <> 0"
    + "".join(f" UNION ALL SELECT {_UNEQUAL.format(f=f)}".replace(" FROM (", f", '{f}' AS diff FROM (", 1) for f in ("tenkh", "tongtien", "ngayhd"))
)
_VIEW_COUNTS = (
    _NET
    + ", c AS (SELECT submission_id, answer_view, sum(greatest(net, 0)) AS a, sum(greatest(-net, 0)) AS s FROM d GROUP BY 1, 2)"
    ", t AS (SELECT DISTINCT submission_id, answer_view FROM r) "
    "SELECT test_id, v.submission_id, v.answer_view, coalesce(a, 0)::BIGINT AS answer_minus_student, coalesce(s, 0)::BIGINT AS student_minus_answer, "
    "least(coalesce(a, 0), coalesce(s, 0))::BIGINT AS value_mismatch, "
    "answer_minus_student_count IS NOT DISTINCT FROM coalesce(a, 0) AND student_minus_answer_count IS NOT DISTINCT FROM coalesce(s, 0) "
    "AND value_mismatch_count IS NOT DISTINCT FROM least(coalesce(a, 0), coalesce(s, 0)) AS report_agrees "
    "FROM view_test_report v JOIN t ON v.submission_id = t.submission_id AND v.answer_view = t.answer_view "
    "LEFT JOIN c ON v.submission_id = c.submission_id AND v.answer_view = c.answer_view"
)


def queries() -> dict:
    return {
        "p3_found": reconcile.view_field_differences,
        "p3_view_counts": reconcile.view_counts,
        "p5_found": orphans.orphan_rows,
        "p5_orphan_counts": orphans.orphan_counts,
        "p5_snapshots": orphans.orphan_snapshots,
    }


def oracle_sql() -> dict[str, str]:
    judged = _judged()
    return {
        "p5_snapshots": _snapshots(),
        "p3_found": _FIELD_DIFFERENCES,
        "p3_view_counts": _VIEW_COUNTS,
        "p5_found": f"SELECT child_table, ref_column, row_id FROM ({judged}) WHERE reason IS NOT NULL",
        "p5_orphan_counts": (
            "SELECT child_table, ref_column, strftime(loaded_at, '%Y-%m') AS period, count(*) AS refs, count(reason) AS orphans, "
            "count(*) FILTER (WHERE reason = 'missing') AS missing, count(*) FILTER (WHERE reason = 'deleted') AS deleted, "
            f"count(*) FILTER (WHERE reason = 'late') AS late FROM ({judged}) GROUP BY 1, 2, 3"
        ),
    }
