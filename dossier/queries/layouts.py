"""Layout checks: suppliers as documents, their order lines as paragraphs and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import layout as L
from dossier.plans.layout import check_layout
from dossier.queries.tables import spread, table
from dossier.session import scratch_path


def _rules(spark):
    """The rules, written to a file and read back as a site would keep them."""
    path = scratch_path(spark, "rules")
    L.default_rules(spark).write.json(path)
    return L.read_rules(spark, path)


def _sections(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("doc_id"), F.lit(0).alias("section"),
        ((190 + k % 80) / 100).alias("top_cm"), ((195 + k % 65) / 100).alias("bottom_cm"),
        ((290 + k % 70) / 100).alias("left_cm"), ((140 + k % 70) / 100).alias("right_cm"),
    )


def _order_sections(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("doc_id"), F.lit(0).alias("section"),
        ((190 + k % 80) / 100).alias("top_cm"), ((195 + k % 65) / 100).alias("bottom_cm"),
        ((290 + k % 70) / 100).alias("left_cm"), ((140 + k % 70) / 100).alias("right_cm"),
    )


def _margins_sql(table_name: str, key: str) -> str:
    return f"""
SELECT doc_id, 'margin' AS kind, 'lề ' || side AS position, printf('%.2fcm', cm) AS found,
  low || '–' || high || 'cm' AS required FROM (
  SELECT {key} AS doc_id, 'top' AS side, (190 + {key} % 80) / 100 AS cm, 2.0::DOUBLE AS low, 2.5::DOUBLE AS high FROM {table_name}
  UNION ALL SELECT {key}, 'bottom', (195 + {key} % 65) / 100, 2.0, 2.5 FROM {table_name}
  UNION ALL SELECT {key}, 'left', (290 + {key} % 70) / 100, 3.0, 3.5 FROM {table_name}
  UNION ALL SELECT {key}, 'right', (140 + {key} % 70) / 100, 1.5, 2.0 FROM {table_name})
WHERE NOT (cm BETWEEN low - 0.05::DOUBLE AND high + 0.05::DOUBLE)"""


def _lines(spark, sf_dir):
    return spread(spark, sf_dir, "lineitem", "l_suppkey").select(
        F.col("l_suppkey").alias("doc_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("para"),
        "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_linenumber",
    ).distinct()


def _paragraphs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.groupBy("doc_id", "para").agg(
        F.when(F.max("l_returnflag") == "N", " \t").otherwise(F.max("l_returnflag")).alias("text"),
        F.when(F.max("l_linestatus") == "O", "body").otherwise("title").alias("style_id"),
        (F.max("l_quantity") / 20).alias("line_spacing"),
    )


def _runs(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "doc_id", "para", F.col("l_partkey").alias("run"), F.lit("x").alias("text"),
        F.when(F.col("l_linenumber") % 3 == 0, "Times New Roman")
        .when(F.col("l_linenumber") % 3 == 1, "Arial").alias("font"),
        F.when(F.col("l_tax") > 0.04, F.col("l_quantity") / 2).alias("size_pt"),
    )


def _styles(spark, sf_dir):
    """Four styles per supplier: title -> body -> nation -> region, and the default style."""
    s = table(spark, sf_dir, "supplier")
    n = F.broadcast(table(spark, sf_dir, "nation"))
    r = F.broadcast(table(spark, sf_dir, "region"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))

    def style(name, base, font, size):
        return F.struct(
            F.lit(name).alias("style_id"), F.lit(base).cast("string").alias("base_style_id"),
            font.cast("string").alias("font"), size.cast("double").alias("size_pt"),
        )

    null = F.lit(None)
    odd = F.col("n_nationkey") % 2 == 1
    rows = F.array(
        style("title", "body", null, F.when(F.col("s_suppkey") % 3 == 0, 14.0)),
        style("body", "nation", null, null),
        style("nation", "region", F.when(odd, F.col("n_name")), F.when(odd, 13.0)),
        style("region", None, F.when(F.col("r_regionkey") > 1, F.col("r_name")), null),
        style("Normal", None, F.lit("Times New Roman"), F.lit(11.0)),
    )
    return where.select(F.col("s_suppkey").alias("doc_id"), F.explode(rows).alias("s")).select("doc_id", "s.*")


STYLES = """
WITH RECURSIVE sup AS (
  SELECT s_suppkey AS doc_id, n_nationkey AS nk, n_name, r_regionkey AS rk, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
styles(doc_id, style_id, base, font, size_pt) AS (
  SELECT doc_id, 'title', 'body', NULL::VARCHAR, CASE WHEN doc_id % 3 = 0 THEN 14.0::DOUBLE END FROM sup
  UNION ALL SELECT doc_id, 'body', 'nation', NULL, NULL FROM sup
  UNION ALL SELECT doc_id, 'nation', 'region', CASE WHEN nk % 2 = 1 THEN n_name END,
                   CASE WHEN nk % 2 = 1 THEN 13.0::DOUBLE END FROM sup
  UNION ALL SELECT doc_id, 'region', NULL, CASE WHEN rk > 1 THEN r_name END, NULL FROM sup
  UNION ALL SELECT doc_id, 'Normal', NULL, 'Times New Roman', 11.0::DOUBLE FROM sup),
walk(doc_id, style_id, depth, cur) AS (
  SELECT doc_id, style_id, 0, style_id FROM styles
  UNION ALL
  SELECT w.doc_id, w.style_id, depth + 1, s.base FROM walk w JOIN styles s
    ON s.doc_id = w.doc_id AND s.style_id = w.cur WHERE s.base IS NOT NULL),
closure AS (
  SELECT w.doc_id, w.style_id,
    arg_min(s.font, depth) FILTER (WHERE s.font IS NOT NULL) AS font,
    arg_min(s.size_pt, depth) FILTER (WHERE s.size_pt IS NOT NULL) AS size_pt
  FROM walk w JOIN styles s ON s.doc_id = w.doc_id AND s.style_id = w.cur GROUP BY ALL)"""
RUNS = STYLES + """,
lines AS (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS para, l_partkey, l_returnflag,
            l_linestatus, l_quantity, l_tax, l_linenumber FROM lineitem),
paragraphs AS (SELECT doc_id, para, max(l_returnflag) = 'N' AS blank,
    CASE WHEN max(l_linestatus) = 'O' THEN 'body' ELSE 'title' END AS style_id,
    max(l_quantity) / 20 AS line_spacing FROM lines GROUP BY doc_id, para),
runs AS (SELECT doc_id, para, l_partkey AS run,
    CASE l_linenumber % 3 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' END AS font,
    CASE WHEN l_tax > 0.04::DOUBLE THEN l_quantity / 2 END AS size_pt FROM lines),
effective AS (SELECT r.doc_id, r.para, r.run, coalesce(r.font, c.font, 'Times New Roman') AS font,
    coalesce(r.size_pt, c.size_pt, 11.0::DOUBLE) AS size_pt
  FROM runs r JOIN paragraphs p USING (doc_id, para) JOIN closure c ON c.doc_id = r.doc_id AND c.style_id = p.style_id
  WHERE NOT p.blank),
bad AS (
  SELECT doc_id, 'font' AS kind, font AS found, para, run FROM effective WHERE font <> 'Times New Roman'
  UNION ALL
  SELECT doc_id, 'size', CAST(CAST(round_even(size_pt, 0) AS INTEGER) AS VARCHAR), para, run FROM effective
  WHERE CAST(round_even(size_pt, 0) AS INTEGER) NOT IN (13, 14)),
repeated AS (
  SELECT doc_id, kind, count(*) || ' đoạn (vd đoạn [' ||
      array_to_string((list(para ORDER BY para, run))[1:5], ', ') || '])' AS position,
    CASE kind WHEN 'font' THEN found ELSE found || 'pt' END AS found,
    CASE kind WHEN 'font' THEN 'Times New Roman' ELSE '13/14pt' END AS required
  FROM bad GROUP BY doc_id, kind, bad.found),
spacing AS (SELECT doc_id, 'spacing' AS kind, 'đoạn ' || para AS position, CAST(line_spacing AS VARCHAR) AS found,
    '≤ 1.5' AS required FROM paragraphs WHERE NOT blank AND line_spacing > 1.5::DOUBLE + 0.01::DOUBLE)"""


def q_margins(spark, sf_dir):
    return L.margin_issues(_order_sections(spark, sf_dir), _rules(spark))


def q_styles(spark, sf_dir):
    return L.style_closure(_styles(spark, sf_dir))


def q_runs(spark, sf_dir):
    effective = L.effective_runs(_runs(spark, sf_dir), _paragraphs(spark, sf_dir), _styles(spark, sf_dir))
    return L.bad_runs(effective, _rules(spark))


def q_spacing(spark, sf_dir):
    return L.spacing_issues(_paragraphs(spark, sf_dir), _rules(spark))


def _checked(spark, sf_dir):
    return check_layout(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id")),
        _sections(spark, sf_dir), _paragraphs(spark, sf_dir), _runs(spark, sf_dir), _styles(spark, sf_dir),
    )


def q_issues(spark, sf_dir):
    return _checked(spark, sf_dir)[0]


def q_verdict(spark, sf_dir):
    return _checked(spark, sf_dir)[1]


def q_margin_verdict(spark, sf_dir):
    """Verdict by margins alone, over every order."""
    sections = _order_sections(spark, sf_dir)
    return L.verdicts(sections.select("doc_id"), L.margin_issues(sections, _rules(spark)))


ALL_ISSUES = RUNS + ",\nissues AS (SELECT * FROM repeated UNION ALL SELECT * FROM spacing UNION ALL " \
    + _margins_sql("supplier", "s_suppkey") + ")"

QUERIES = {
    "margins": q_margins,
    "styles": q_styles,
    "runs": q_runs,
    "spacing": q_spacing,
    "layout_issues": q_issues,
    "verdict": q_verdict,
    "margin_verdict": q_margin_verdict,
}

ORACLE = {
    "margins": _margins_sql("orders", "o_orderkey"),
    "styles": STYLES + " SELECT doc_id, style_id, font, size_pt FROM closure",
    "runs": RUNS + " SELECT doc_id, kind, found, para, run FROM bad",
    "spacing": RUNS + " SELECT * FROM spacing",
    "layout_issues": ALL_ISSUES + " SELECT * FROM issues",
    "verdict": ALL_ISSUES + """
SELECT s_suppkey AS doc_id, count(i.doc_id) AS n_issues,
  CASE WHEN count(i.doc_id) = 0 THEN 'Đạt định dạng' ELSE 'Có lỗi định dạng cần sửa' END AS verdict
FROM supplier LEFT JOIN issues i ON i.doc_id = s_suppkey GROUP BY s_suppkey""",
    "margin_verdict": "WITH issues AS (" + _margins_sql("orders", "o_orderkey") + """)
SELECT o_orderkey AS doc_id, count(i.doc_id) AS n_issues,
  CASE WHEN count(i.doc_id) = 0 THEN 'Đạt định dạng' ELSE 'Có lỗi định dạng cần sửa' END AS verdict
FROM orders LEFT JOIN issues i ON i.doc_id = o_orderkey GROUP BY o_orderkey""",
}
