"""Flattening and reports of nested advisory and weakness records.

Payloads come as a column of JSON text. Numbers are read as text where a report prints them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtrace import constants as K
from fixtrace.functions.text import render_prompt

_CVSS = """array<struct<source: string, type: string, baseSeverity: string, exploitabilityScore: string,
  impactScore: string, cvssData: struct<version: string, vectorString: string, baseScore: string,
  baseSeverity: string>>>"""
_LANG = "array<struct<lang: string, value: string>>"
ADVISORY_SCHEMA = f"""struct<vulnerabilities: array<struct<cve: struct<
  id: string, sourceIdentifier: string, published: string, lastModified: string, vulnStatus: string,
  descriptions: {_LANG},
  metrics: struct<cvssMetricV31: {_CVSS}, cvssMetricV30: {_CVSS}, cvssMetricV2: {_CVSS}>,
  weaknesses: array<struct<source: string, type: string, description: {_LANG}>>,
  references: array<struct<url: string, source: string, tags: array<string>>>,
  configurations: array<struct<nodes: array<struct<operator: string, negate: boolean,
    cpeMatch: array<struct<criteria: string, versionStartIncluding: string, versionStartExcluding: string,
      versionEndIncluding: string, versionEndExcluding: string>>>>>>,
  vendorComments: array<struct<organization: string, comment: string, lastModified: string>>,
  evaluatorComment: string, evaluatorSolution: string, evaluatorImpact: string,
  cisaVulnerabilityName: string, cisaExploitAdd: string, cisaRequiredAction: string, cisaActionDue: string
>>>>"""
WEAKNESS_SCHEMA = """struct<Weaknesses: array<struct<
  ID: string, Name: string, Abstraction: string, Description: string, ExtendedDescription: string,
  Consequences: array<struct<Scope: array<string>, Impact: array<string>>>,
  Mitigations: array<struct<MitigationID: string, Description: string>>,
  RelatedWeaknesses: array<struct<Nature: string, CweID: string>>,
  ObservedExamples: array<struct<Reference: string, Description: string, Link: string>>,
  DetectionMethods: array<struct<Method: string, Description: string>>,
  References: array<struct<Title: string, URL: string>>,
  ContentHistory: array<struct<Type: string, SubmissionName: string, ModificationName: string,
    ModificationDate: string, Date: string>>,
  MappingNotes: struct<Usage: string, Rationale: string>
>>>"""


def parse_advisories(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Read the payload column into the struct column ``advisory``, null if the advisory is not known yet."""
    record = F.from_json(payload, ADVISORY_SCHEMA)
    return df.withColumn("advisory", F.get(record["vulnerabilities"], F.lit(0))["cve"]).drop(payload)


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array())


def _english(texts: Column) -> Column:
    return F.get(F.filter(texts, lambda d: d["lang"] == "en"), F.lit(0))["value"]


def _scores(advisory: Column) -> Column:
    """One array over the score versions 3.1, 3.0 and 2, newest first."""
    def entry(m, severity, link):
        data = m["cvssData"]
        return F.struct(
            data["version"].alias("version"), m["type"].alias("type"), m["source"].alias("source"),
            severity(m).alias("severity"), data["baseScore"].alias("score"),
            m["exploitabilityScore"].alias("exploitability"), m["impactScore"].alias("impact"),
            data["vectorString"].alias("vector"),
            F.concat(F.lit(link[0]), data["vectorString"], F.lit(link[1])).alias("link"))

    def inner(m):
        return m["cvssData"]["baseSeverity"]

    metrics, links = advisory["metrics"], K.SCORE_LINKS
    parts = [
        F.transform(metrics["cvssMetricV31"], lambda m: entry(m, inner, links["v31"])),
        F.transform(metrics["cvssMetricV30"], lambda m: entry(m, inner, links["v30"])),
        # Version 2 has the severity one level higher.
        F.transform(metrics["cvssMetricV2"], lambda m: entry(m, lambda e: e["baseSeverity"], links["v2"])),
    ]
    return F.flatten(F.array_compact(F.array(*parts)))


def advisory_scores(df: DataFrame) -> DataFrame:
    """One row per score of each advisory."""
    scores = df.select("cve", F.posexplode(_scores(F.col("advisory"))).alias("place", "s"))
    return scores.select(
        "cve", "place", "s.version", "s.type", "s.source", "s.severity",
        *[F.col(f"s.{c}").cast("double").alias(c) for c in ("score", "exploitability", "impact")], "s.vector")


def advisory_weaknesses(df: DataFrame) -> DataFrame:
    """One row per weakness with its English name."""
    rows = df.select("cve", F.explode("advisory.weaknesses").alias("w"))
    return rows.select("cve", _english(F.col("w.description")).alias("weakness"), "w.type", "w.source")


def advisory_references(df: DataFrame) -> DataFrame:
    """One row per reference, its tags in one text."""
    rows = df.select("cve", F.explode("advisory.references").alias("r"))
    return rows.select("cve", "r.url", F.array_join(_list(F.col("r.tags")), ", ").alias("tags"), "r.source")


def affected_versions(df: DataFrame) -> DataFrame:
    """One row per configuration, node and product with its version bounds; all counted from 1."""
    configs = df.select("cve", F.posexplode("advisory.configurations").alias("configuration", "c"))
    nodes = configs.select("cve", "configuration", F.posexplode("c.nodes").alias("node", "n"))
    products = nodes.select("cve", "configuration", "node", "n.operator", "n.negate",
                            F.posexplode("n.cpeMatch").alias("product", "p"))
    return products.select(
        "cve", *[(F.col(c) + 1).alias(c) for c in ("configuration", "node", "product")],
        "operator", "negate", "p.criteria",
        F.coalesce("p.versionStartIncluding", "p.versionStartExcluding").alias("version_start"),
        F.col("p.versionStartIncluding").isNotNull().alias("start_included"),
        F.coalesce("p.versionEndIncluding", "p.versionEndExcluding").alias("version_end"),
        F.col("p.versionEndIncluding").isNotNull().alias("end_included"))


def known_exploited(df: DataFrame) -> DataFrame:
    """Whether each advisory is on the list of exploited ones, with name, dates and action."""
    return df.select(
        "cve", F.col("advisory.cisaVulnerabilityName").isNotNull().alias("exploited"),
        F.col("advisory.cisaVulnerabilityName").alias("name"), F.col("advisory.cisaExploitAdd").alias("added"),
        F.col("advisory.cisaActionDue").alias("due"), F.col("advisory.cisaRequiredAction").alias("action"))


def _table(rows: Column, head: str, line) -> Column:
    """Head and one line per element; null for an empty list."""
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(F.transform(rows, line), "")))


def _configurations(configurations: Column) -> Column:
    def product(p):
        bounds = [
            F.when(p[field].isNotNull(), render_prompt(text, {"v": p[field]}))
            for field, text in K.VERSION_FORMATS.items()]
        criteria = F.replace(p["criteria"], F.lit("*"), F.lit("\\*"))
        return F.concat_ws("", render_prompt(K.PRODUCT_FORMAT, {"criteria": criteria}), *bounds)

    def node(n, i):
        return render_prompt(K.NODE_FORMAT, {
            "number": i + 1, "products": F.array_join(F.transform(n["cpeMatch"], product), "")})

    def configuration(c, i):
        first = F.get(c["nodes"], F.lit(0))
        return render_prompt(K.CONFIGURATION_FORMAT, {
            "number": i + 1, "operator": first["operator"], "negate": F.initcap(first["negate"].cast("string")),
            "nodes": F.array_join(F.transform(c["nodes"], node), "")})

    return _table(configurations, "", configuration)


def advisory_report(df: DataFrame, today: str) -> DataFrame:
    """(cve, report): one markdown text per advisory. ``today`` (month/day/year) makes it repeatable."""
    a, default = F.col("advisory"), K.ADVISORY_DEFAULTS

    def or_default(text, name):
        return F.coalesce(F.rtrim(text, F.lit("\n")) if name in ("scores", "configurations", "evaluator") else text,
                          F.lit(default[name]))

    score_fields = ["version", "type", "source", "severity", "score", "exploitability", "impact", "vector", "link"]
    scores = F.array_join(F.transform(
        _scores(a), lambda s: render_prompt(K.SCORE_FORMAT, {f: s[f] for f in score_fields})), "\n")
    weaknesses = _table(_list(a["weaknesses"]), K.WEAKNESS_HEAD, lambda w: render_prompt(K.WEAKNESS_FORMAT, {
        "value": _english(w["description"]), "type": w["type"], "source": w["source"]}))
    references = _table(_list(a["references"]), K.REFERENCE_HEAD, lambda r: render_prompt(K.REFERENCE_FORMAT, {
        "url": r["url"], "tags": F.coalesce(F.array_join(r["tags"], ", "), F.lit("")), "source": r["source"]}))
    comments = _table(_list(a["vendorComments"]), "", lambda c, i: render_prompt(K.COMMENT_FORMAT, {
        "number": i + 1, "comment": c["comment"], "organization": c["organization"], "modified": c["lastModified"]}))
    evaluator = F.concat_ws("", *[
        F.when(a[field].isNotNull(), render_prompt(text, {"text": a[field]}))
        for field, text in K.EVALUATOR_FORMATS.items()])
    exploited = F.when(a["cisaVulnerabilityName"].isNotNull(), render_prompt(K.EXPLOITED_FORMAT, {
        "name": a["cisaVulnerabilityName"], "added": a["cisaExploitAdd"],
        "action": a["cisaRequiredAction"], "due": a["cisaActionDue"],
    })).otherwise(render_prompt(K.NOT_EXPLOITED_FORMAT, {"today": F.lit(today)}))
    report = render_prompt(K.ADVISORY_FORMAT, {
        "id": F.col("cve"), "exploited": exploited, "source": a["sourceIdentifier"],
        "published": a["published"], "modified": a["lastModified"], "status": a["vulnStatus"],
        "scores": or_default(F.nullif(scores, F.lit("")), "scores"),
        "description": _english(a["descriptions"]),
        "evaluator": or_default(F.nullif(evaluator, F.lit("")), "evaluator"),
        "weaknesses": or_default(weaknesses, "weaknesses"), "comments": or_default(comments, "comments"),
        "references": or_default(references, "references"),
        "configurations": or_default(_configurations(_list(a["configurations"])), "configurations"),
    })
    return df.select("cve", F.when(a.isNull(), F.lit(K.ADVISORY_MISSING)).otherwise(report).alias("report"))


def weakness_report(df: DataFrame, view: str = "complete", payload: str = "payload") -> DataFrame:
    """(cwe, report): one markdown text per weakness with the sections of a view.

    Views: conceptual, operational, mapping friendly, complete. A list entry that lacks a field is left out.
    """
    view = view.lower()
    wanted = list(K.WEAKNESS_SECTIONS) if view == "complete" else K.WEAKNESS_VIEWS[view]
    parsed = df.withColumn("_w", F.get(F.from_json(payload, WEAKNESS_SCHEMA)["Weaknesses"], F.lit(0)))
    w = F.col("_w")

    def items(section, field, slots):
        def line(e):
            return render_prompt(K.WEAKNESS_ITEMS[section], slots(e))

        def whole(e):
            present = F.lit(True)
            for value in slots(e).values():
                present = present & value.isNotNull()
            return present

        return F.when(w[field].isNotNull(), F.array_join(F.transform(F.filter(w[field], whole), line), ""))

    texts = {
        "Description": w["Description"],
        "Extended Description": w["ExtendedDescription"],
        "Common Consequences": items("Common Consequences", "Consequences", lambda e: {
            "scope": F.array_join(e["Scope"], ", "), "impact": F.array_join(e["Impact"], ", ")}),
        "Potential Mitigations": items("Potential Mitigations", "Mitigations", lambda e: {
            "id": e["MitigationID"], "text": e["Description"]}),
        "Relationships": items("Relationships", "RelatedWeaknesses", lambda e: {
            "nature": e["Nature"], "id": e["CweID"]}),
        "Observed Examples": items("Observed Examples", "ObservedExamples", lambda e: {
            "reference": e["Reference"], "text": e["Description"], "link": e["Link"]}),
        "Detection Methods": items("Detection Methods", "DetectionMethods", lambda e: {
            "method": e["Method"], "text": e["Description"]}),
        "References": items("References", "References", lambda e: {"title": e["Title"], "url": e["URL"]}),
        "Content History": items("Content History", "ContentHistory", lambda e: {
            "type": e["Type"], "name": F.coalesce(e["SubmissionName"], e["ModificationName"]),
            "date": F.coalesce(e["ModificationDate"], e["Date"])}),
    }
    sections = F.concat_ws("", *[
        F.when(texts[name].isNotNull(), render_prompt(K.WEAKNESS_SECTIONS[name], {"text": texts[name]}))
        for name in wanted])
    report = render_prompt(K.WEAKNESS_REPORT_FORMAT, {
        "id": w["ID"], "name": w["Name"], "usage": w["MappingNotes"]["Usage"],
        "rationale": w["MappingNotes"]["Rationale"], "abstraction": w["Abstraction"], "sections": sections})
    return parsed.select("cwe", F.when(w.isNull(), F.lit(K.WEAKNESS_MISSING)).otherwise(report).alias("report"))
