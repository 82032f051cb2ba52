"""Layout measurements tested against a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import is_blank
from dossier.session import cut_lineage

RULE_SCHEMA = "rule string, side string, min double, max double, allowed array<string>"
ISSUE_COLUMNS = ["doc_id", "kind", "position", "found", "required"]

# Texts of the report.
MARGIN_POSITION = "lề %s"
MARGIN_FOUND = "%.2fcm"
MARGIN_REQUIRED = "%s–%scm"
REPEATED_POSITION = "%d đoạn (vd đoạn [%s])"
PARAGRAPH_POSITION = "đoạn %d"
SPACING_REQUIRED = "≤ %s"
PASS_TEXT = "Đạt định dạng"
FAIL_TEXT = "Có lỗi định dạng cần sửa"
NORMAL_STYLE = "Normal"


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [("margin", side, low, high, None) for side, low, high in K.LAYOUT_MARGINS_CM]
    rows += [
        ("font", None, None, None, list(K.LAYOUT_FONTS)),
        ("size", None, None, None, [str(s) for s in K.LAYOUT_SIZES]),
        ("spacing", None, None, K.LAYOUT_SPACING_MAX, None),
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the columns of RULE_SCHEMA, so that a site can change them as data."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def _rule(rules: DataFrame, rule: str, column: str) -> Column:
    return rules.where(F.col("rule") == rule).agg(F.first(column).alias("v")).scalar()


def margin_issues(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """First section's margins outside the range of their side, with a tolerance of 0.05 cm."""
    sides = [side for side, _, _ in K.LAYOUT_MARGINS_CM]
    pairs = ", ".join(f"'{s}', {s}_cm" for s in sides)
    measured = sections.where(F.col("section") == 0).select(
        "doc_id", F.expr(f"stack({len(sides)}, {pairs}) AS (side, cm)")
    )
    # A handful of rules, one per side.
    ranges = F.broadcast(rules.where(F.col("rule") == "margin").select("side", "min", "max"))
    slack = F.lit(K.MARGIN_TOLERANCE_CM)
    inside = F.col("cm").between(F.col("min") - slack, F.col("max") + slack)
    return measured.join(ranges, "side").where(~inside).select(
        "doc_id",
        F.lit("margin").alias("kind"),
        F.format_string(MARGIN_POSITION, "side").alias("position"),
        F.format_string(MARGIN_FOUND, "cm").alias("found"),
        F.format_string(MARGIN_REQUIRED, F.col("min").cast("string"), F.col("max").cast("string")).alias("required"),
    )


def style_closure(styles: DataFrame) -> DataFrame:
    """``(doc_id, style_id, font, size_pt)`` with values inherited from the nearest ancestor.

    Every round doubles the number of ancestors looked at, so a chain of length d takes log2(d)
    joins. Rounds end when no open value has an ancestor left; a cycle ends after as many rounds
    as its document's styles can need.
    """
    font, size = F.nullif("font", F.lit("")), F.nullif("size_pt", F.lit(0.0))

    def settled(font: Column, size: Column, base: Column) -> Column:
        return F.when(font.isNull() | size.isNull(), base)

    state = styles.select(
        "doc_id", "style_id", font.alias("font"), size.alias("size_pt"),
        settled(font, size, F.col("base_style_id")).alias("base"),
    )
    largest = styles.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= largest and not state.where(F.col("base").isNotNull()).isEmpty():
        up = styles_up(state)
        state = cut_lineage(up)
        reach *= 2
    return state.select("doc_id", "style_id", "font", "size_pt")


def styles_up(state: DataFrame) -> DataFrame:
    """One doubling round: open values taken from the base, the base moved to the base's base."""
    parent = state.select(
        "doc_id", F.col("style_id").alias("base"), F.col("font").alias("p_font"),
        F.col("size_pt").alias("p_size"), F.col("base").alias("p_base"),
        F.lit(True).alias("p_exists"),
    )
    joined = state.join(parent, ["doc_id", "base"], "left")
    font, size = F.coalesce("font", "p_font"), F.coalesce("size_pt", "p_size")
    # The parent's own base is null once both its values are known, which settles this row too.
    base = F.when(font.isNull() | size.isNull(), F.col("p_base"))
    return joined.select("doc_id", "style_id", font.alias("font"), size.alias("size_pt"), base.alias("base"))


def effective_runs(runs: DataFrame, paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Non-blank runs of non-blank paragraphs with effective ``font`` and ``size_pt``."""
    closure = style_closure(styles).select(
        "doc_id", "style_id", F.col("font").alias("s_font"), F.col("size_pt").alias("s_size")
    )
    normal = styles.where(F.col("style_id") == NORMAL_STYLE).select(
        "doc_id", F.nullif("font", F.lit("")).alias("n_font"),
        F.nullif("size_pt", F.lit(0.0)).alias("n_size"),
    )
    # Styles are resolved on paragraphs; runs, the largest table, are shuffled once.
    styled = (
        paragraphs.where(~is_blank("text")).select("doc_id", "para", "style_id")
        .join(closure, ["doc_id", "style_id"], "left")
        .join(normal, "doc_id", "left")
        .select("doc_id", "para", F.coalesce("s_font", "n_font").alias("p_font"), F.coalesce("s_size", "n_size").alias("p_size"))
    )
    return (
        runs.where(~is_blank("text"))
        .select("doc_id", "para", "run", "font", "size_pt")
        .join(styled, ["doc_id", "para"])
        .select(
            "doc_id", "para", "run",
            F.coalesce(F.nullif("font", F.lit("")), "p_font").alias("font"),
            F.coalesce(F.nullif("size_pt", F.lit(0.0)), "p_size").alias("size_pt"),
        )
    )


def bad_runs(effective: DataFrame, rules: DataFrame) -> DataFrame:
    """``(doc_id, kind, found, para, run)``: fonts and rounded sizes outside the allowed sets.

    Sizes are rounded half to even. Unknown values pass.
    """
    rounded = F.bround("size_pt", 0).cast("int").cast("string")
    font_bad = ~F.array_contains(_rule(rules, "font", "allowed"), F.col("font"))
    size_bad = ~F.array_contains(_rule(rules, "size", "allowed"), rounded)
    faults = F.array(
        F.struct(F.lit("font").alias("kind"), F.when(F.col("_bad_font"), F.col("font")).alias("found")),
        F.struct(F.lit("size").alias("kind"), F.when(F.col("_bad_size"), rounded).alias("found")),
    )
    return (
        effective.withColumns({"_bad_font": font_bad, "_bad_size": size_bad})
        .where("_bad_font OR _bad_size")
        .select("doc_id", "para", "run", F.explode(faults).alias("f"))
        .select("doc_id", "f.kind", "f.found", "para", "run")
        .where(F.col("found").isNotNull())
    )


def repeated_issues(bad: DataFrame, rules: DataFrame) -> DataFrame:
    """One issue per document and wrong value: how often, and its first five paragraphs.

    The examples are cut per task before they are shuffled, so a document of any length is safe.
    """
    keys = ["doc_id", "kind", "found"]
    counts = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy(*keys).orderBy("para", "run")
    examples = (
        bad.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= K.ISSUE_EXAMPLES)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "para"))).alias("_paras"))
    )
    shown = F.array_join(F.transform("_paras", lambda p: p["para"].cast("string")), ", ")
    fonts = F.array_join(F.sort_array(_rule(rules, "font", "allowed")), ", ")
    sizes = F.concat(F.array_join(F.sort_array(_rule(rules, "size", "allowed")), "/"), F.lit("pt"))
    is_font = F.col("kind") == "font"
    return counts.join(examples, keys).select(
        "doc_id",
        "kind",
        F.format_string(REPEATED_POSITION, F.col("n"), shown).alias("position"),
        F.when(is_font, F.col("found")).otherwise(F.concat("found", F.lit("pt"))).alias("found"),
        F.when(is_font, fonts).otherwise(sizes).alias("required"),
    )


def spacing_issues(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Non-blank paragraphs whose own line spacing exceeds the limit by more than 0.01."""
    limit = _rule(rules, "spacing", "max")
    return paragraphs.where(
        ~is_blank("text") & (F.col("line_spacing") > limit + F.lit(K.SPACING_TOLERANCE))
    ).select(
        "doc_id",
        F.lit("spacing").alias("kind"),
        F.format_string(PARAGRAPH_POSITION, "para").alias("position"),
        F.col("line_spacing").cast("string").alias("found"),
        F.format_string(SPACING_REQUIRED, limit.cast("string")).alias("required"),
    )


def all_issues(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*ISSUE_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ISSUE_COLUMNS))
    return out


def verdicts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """``(doc_id, n_issues, verdict)`` for every document, also those without an issue."""
    counts = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_issues"))
    n = F.coalesce("n_issues", F.lit(0)).cast("long")
    return docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", n.alias("n_issues"),
        F.when(n == 0, PASS_TEXT).otherwise(FAIL_TEXT).alias("verdict"),
    )
