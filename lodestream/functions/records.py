"""Records to markdown by column functions: query results, trials, notices, labels, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def row_lines(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))


def table_markdown(rows: DataFrame, columns: list[str], *, by: list[str], order: list[str]) -> DataFrame:
    """One markdown table for each group, rows in `order`. A group is one document and must fit one."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    lines = rows.select(*by, F.struct(*order).alias("_o"), row_lines(rows, columns).alias("line"))
    packed = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_o", "line"))).alias("ls"))
    return packed.select(*by, F.concat(F.lit(head + "\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def section(title: str, body: Column) -> Column:
    """A heading and its text, or nothing."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"## {title}\n\n"), F.trim(body)))


TRIAL = (
    "protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string>, descriptionModule: struct<briefSummary: string, detailedDescription: string>, designModule: struct<phases: array<string>>, "
    "eligibilityModule: struct<eligibilityCriteria: string>, outcomesModule: struct<primaryOutcomes: array<struct<measure: string, description: string, timeFrame: string>>, secondaryOutcomes: array<struct<measure: string, description: string, timeFrame: string>>>, "
    "armsInterventionsModule: struct<interventions: array<struct<name: string, type: string, description: string>>>>"
)


def trial_markdown(document: Column) -> Column:
    """A clinical trial record (JSON) as sections."""
    p = F.from_json(document, TRIAL)["protocolSection"]

    def bullets(items: Column, *fields: str) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.concat_ws(": ", *[x[f] for f in fields]))), "\n")

    outcomes = p["outcomesModule"]
    parts = [
        F.concat_ws(" ", F.lit("#"), p["identificationModule"]["nctId"], p["identificationModule"]["briefTitle"]),
        section("Summary", p["descriptionModule"]["briefSummary"]),
        section("Description", p["descriptionModule"]["detailedDescription"]),
        section("Eligibility", p["eligibilityModule"]["eligibilityCriteria"]),
        section("Primary Outcomes", bullets(outcomes["primaryOutcomes"], "measure", "description", "timeFrame")),
        section("Secondary Outcomes", bullets(outcomes["secondaryOutcomes"], "measure", "description", "timeFrame")),
        section("Interventions", bullets(p["armsInterventionsModule"]["interventions"], "type", "name", "description")),
    ]
    return F.concat_ws("\n\n", *parts)


def late_phase(document: Column) -> Column:
    return F.arrays_overlap(F.coalesce(F.from_json(document, TRIAL)["protocolSection"]["designModule"]["phases"], F.array().cast("array<string>")), F.array(F.lit("PHASE2"), F.lit("PHASE3")))


def notice_markdown(title: Column, agency: Column, date: Column, abstract: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat_ws("\n", F.concat(F.lit("Agency: "), agency), F.concat(F.lit("Date: "), date)), section("Abstract", abstract), section("Text", body))


def article_markdown(xml: Column) -> Column:
    """A citation record (XML): its title and abstract; a part of the abstract with a label has it as its heading."""
    plain = lambda x: F.trim(F.xpath_string(F.concat(F.lit("<t>"), F.regexp_replace(x, r"</?[A-Za-z][^>]*>", ""), F.lit("</t>")), F.lit("/t")))
    part = lambda x: F.concat_ws("\n\n", F.concat(F.lit("## "), F.nullif(F.regexp_extract(x, r"""^<AbstractText\b[^>]*?\bLabel\s*=\s*["']([^"']*)""", 1), F.lit(""))), plain(x))
    body = F.array_join(F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<AbstractText\b[^>]*(?<!/)>.*?</AbstractText>"), F.lit(0)), part), "\n\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.xpath_string(xml, F.lit("//ArticleTitle"))), F.nullif(body, F.lit("")))


def first_of_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of records whose names are equal but for case and blanks at the ends, the first by `order`; records without a name go."""
    key = F.lower(F.trim(F.col(name)))
    first = rows.where(key.isNotNull() & (key != "")).groupBy(key.alias("_name")).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return first.select("_row.*")


def drug_markdown(name: Column, fields: dict[str, Column]) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), name), *[section(t, F.array_join(c, "\n\n")) for t, c in fields.items()])


def latest(forms: Column, dates: Column, urls: Column, form: str) -> Column:
    """Of parallel arrays the url of the newest filing of a form."""
    rows = F.filter(F.arrays_zip(dates.alias("d"), forms.alias("f"), urls.alias("u")), lambda x: x["f"] == form)
    return F.try_element_at(F.sort_array(rows, asc=False), F.lit(1))["u"]


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): the turns of each conversation in order. A conversation is one document and must fit one."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("ts"))
    return packed.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda x: x["line"]), "\n").alias("text"))
