"""Protocol documents in JSON: every object as a row, and tables of an entity with checks as flags.

Documents stay in Spark: nested values are taken apart level by level with ``variant_explode``, so
many documents of any size make one plan whose depth is that of the deepest document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.model import ORD, Dataset, RuleError

MOST_LEVELS = 40
# Fixed value: the code of a reason that does not apply.
NOT_APPLICABLE = "C48660"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document, value): each file's JSON as a variant; files that are no JSON have a null value."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document"), "value")
    return files.select("document", F.expr("try_parse_json(value)").alias("value"))


def objects(documents: DataFrame) -> DataFrame:
    """(document, path, parent, key, id, kind, name, value): every object with an id or an instance type.

    ``parent`` is the path of the object around it, ``kind`` its instanceType. Documents nested over
    ``MOST_LEVELS`` levels deep, arrays counted, are refused.
    """
    level = documents.select("document", F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("key"), "value").where("value IS NOT NULL")
    levels: list[DataFrame] = []
    nested = "schema_of_variant(value) LIKE 'OBJECT%' OR schema_of_variant(value) LIKE 'ARRAY%'"
    while True:
        level = level.where(nested)
        if level.isEmpty():
            break
        if len(levels) == MOST_LEVELS:
            raise RuleError(f"documents are nested over {MOST_LEVELS} levels deep", "invalid_document")
        levels.append(level)
        level.createOrReplaceTempView("__level")
        level = documents.sparkSession.sql("""
            SELECT document, CASE WHEN x.key IS NULL THEN concat(l.path, '[', x.pos, ']') ELSE concat(l.path, '.', x.key) END AS path,
              CASE WHEN x.key IS NULL THEN l.parent ELSE l.path END AS parent, coalesce(x.key, l.key) AS key, x.value
            FROM __level l, LATERAL variant_explode(l.value) x
        """)
    every = levels[0] if levels else level
    for more in levels[1:]:
        every = every.unionByName(more)
    got = lambda name: F.expr(f"try_variant_get(value, '$.{name}', 'string')")
    rows = every.where("schema_of_variant(value) LIKE 'OBJECT%'").select("document", "path", "parent", "key", got("id").alias("id"), got("instanceType").alias("kind"), got("name").alias("name"), "value")
    return rows.where("id IS NOT NULL OR kind IS NOT NULL")


def text(name: str) -> Column:
    """A field of the object by its path, as text; objects and lists as JSON."""
    return F.expr(f"try_variant_get(value, '$.{name}', 'string')")


def filled(name: str) -> Column:
    return F.expr(f"try_variant_get(value, '$.{name}', 'variant') IS NOT NULL AND NOT is_variant_null(try_variant_get(value, '$.{name}', 'variant'))") & (F.coalesce(text(name), F.lit("-")) != "")


def size(name: str) -> Column:
    return F.coalesce(F.size(F.expr(f"try_variant_get(value, '$.{name}', 'array<variant>')")), F.lit(0))


@dataclass(frozen=True)
class Flag:
    """A check of one entity: a Boolean or a number for each object of the kind."""

    kind: str
    name: str
    value: Column


def row_flags() -> list[Flag]:
    """Checks that an object answers by itself."""
    amount = lambda name: filled(f"{name}.value")
    unit = lambda name: filled(f"{name}.unit")
    return [
        Flag("Duration", "duration_missing_text_and_quantity", ~filled("text") & ~filled("quantity")),
        Flag("Duration", "duration_vary_quantity_conflict", (text("durationWillVary") == "true") == filled("quantity")),
        Flag("Range", "range_min_not_less_than_max", F.coalesce(text("minValue.value").try_cast("double") >= text("maxValue.value").try_cast("double"), F.lit(False))),
        Flag("Range", "range_unit_xor", unit("minValue") != unit("maxValue")),
        Flag("PersonName", "person_name_missing_text_and_family_name", ~filled("text") & ~filled("familyName")),
        Flag("Address", "address_all_blank", ~(filled("text") | (size("lines") > 0) | filled("city") | filled("district") | filled("state") | filled("postalCode") | filled("country"))),
        Flag("Administration", "administration_dose_route_xor", filled("dose.id") != filled("route.id")),
        Flag("Administration", "administration_dose_without_frequency", filled("dose.id") & ~filled("frequency.id")),
        Flag("Strength", "strength_numerator_range_missing_unit", (amount("numerator.minValue") & ~unit("numerator.minValue")) | (amount("numerator.maxValue") & ~unit("numerator.maxValue"))),
        Flag("StudyAmendmentReason", "primary_reason_not_applicable", (F.col("key") == "primaryReason") & (text("code.code") == NOT_APPLICABLE)),
        Flag("Strength", "strength_numerator_value_missing_unit", amount("numerator") & ~unit("numerator")),
        Flag("Strength", "strength_denominator_missing_unit", filled("denominator.id") & ~unit("denominator")),
        Flag("GeographicScope", "geographic_scope_global_code_mismatch", (text("type.decode") == "Global") == filled("code")),
        Flag("BiospecimenRetention", "biospecimen_retained_missing_includes_dna", (text("isRetained") == "true") & ~filled("includesDNA")),
        Flag("ScheduleTimeline", "plannedDuration.present", filled("plannedDuration")),
        Flag("NarrativeContent", "narrative_content_display_section_number_missing", (text("displaySectionNumber") == "true") & ~filled("sectionNumber")),
        Flag("NarrativeContent", "narrative_content_display_section_title_missing", (text("displaySectionTitle") == "true") & ~filled("sectionTitle")),
        Flag("StudyArm", "study_arm_missing_populations", size("populationIds") == 0),
    ]


#: Fields of ids, and the kinds that they must name: (kind, field, list?, kinds of the target, flag).
REFERENCES = (
    ("Activity", "childIds", True, ("Activity",), "activity_child_id_invalid"),
    ("Procedure", "studyInterventionId", False, ("StudyIntervention",), "procedure_invalid_study_intervention"),
    ("StudyElement", "studyInterventionIds", True, ("StudyIntervention",), "study_element_invalid_study_intervention"),
    ("StudyCohort", "indicationIds", True, ("Indication",), "study_cohort_invalid_indication"),
    ("StudyArm", "populationIds", True, ("StudyDesignPopulation", "StudyCohort"), "study_arm_invalid_population"),
    ("NarrativeContent", "contentItemId", False, ("NarrativeContentItem",), "narrative_content_item_id_invalid"),
    ("NarrativeContent", "previousId", False, ("NarrativeContent",), "narrative_content_peer_ref_invalid"),
    ("Condition", "appliesToIds", True, ("Procedure", "Activity", "BiomedicalConcept", "BiomedicalConceptCategory", "BiomedicalConceptSurrogate"), "condition_applies_to_invalid"),
)
#: Columns that must not repeat within a document: (kind, fields, flag); no kind means every object.
REPEATS = (
    (None, ("id",), "usdm_duplicate_id"),
    (None, ("kind", "name"), "usdm_duplicate_name_for_class"),
    ("Abbreviation", ("abbreviatedText",), "abbreviation_text_duplicate"),
    ("Abbreviation", ("expandedText",), "abbreviation_expanded_text_duplicate"),
    ("StudyCell", ("armId", "epochId"), "study_cell_arm_epoch_duplicate"),
    ("EligibilityCriterion", ("criterionItemId",), "eligibility_criterion_duplicate_item"),
    ("NarrativeContent", ("sectionNumber",), "narrative_content_display_section_number_duplicate"),
)
#: Kinds whose objects must be named by some field elsewhere: (kind, field that names them, flag).
UNUSED = (("EligibilityCriterionItem", "criterionItemId", "eligibility_criterion_item_unused"), ("EligibilityCriterion", "criterionIds", "eligibility_criterion_unused"))


def _named(rows: DataFrame, field: str, listed: bool) -> Column:
    return F.expr(f"try_variant_get(value, '$.{field}', 'array<string>')") if listed else F.array_compact(F.array(text(field)))


def _joined_flags(kind: str, df: DataFrame, rows: DataFrame) -> DataFrame:
    """Checks of one kind that other objects of the document answer."""
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    if kind in ("Administration", "AdministrableProduct"):
        devices = of("MedicalDevice").select(F.col("document").alias("__d"), F.col("id").alias("__device"), text("embeddedProductId").alias("__embedded")).where("__embedded <> ''")
    if kind == "Administration":
        df = df.join(devices, (df["document"] == devices["__d"]) & (text("medicalDeviceId") == devices["__device"]), "left")
        product = filled("administrableProductId") | F.col("__embedded").isNotNull()
        df = df.withColumns({"administration_dose_product_xor": filled("dose.id") != product, "administration_duplicate_embedded_product": F.coalesce(text("administrableProductId") == F.col("__embedded"), F.lit(False))})
        return df.drop("__d", "__device", "__embedded")
    if kind == "AdministrableProduct":
        given = of("Administration").select(F.col("document").alias("__g"), text("administrableProductId").alias("__given")).distinct()
        inside = devices.select("__d", "__embedded").distinct()
        df = df.join(given, (df["document"] == given["__g"]) & (df["id"] == given["__given"]), "left").join(inside, (df["document"] == inside["__d"]) & (df["id"] == inside["__embedded"]), "left")
        only = filled("sourcing") & F.col("__embedded").isNotNull() & F.col("__given").isNull()
        return df.withColumn("administrable_product_embedded_only_sourcing", only).drop("__g", "__given", "__d", "__embedded")
    if kind == "StudyAmendmentReason":
        first = of(kind).where("key = 'primaryReason'").select(F.col("document").alias("__d"), F.col("parent").alias("__p"), text("code.code").alias("__code"))
        df = df.join(first, (df["document"] == first["__d"]) & (df["parent"] == first["__p"]), "left")
        return df.withColumn("secondary_reason_matches_primary", F.coalesce((F.col("key") != "primaryReason") & (text("code.code") == F.col("__code")), F.lit(False))).drop("__d", "__p", "__code")
    if kind == "ProductOrganizationRole":
        valid = of("AdministrableProduct", "MedicalDevice").select(F.col("document").alias("__d"), F.col("id").alias("__id")).distinct()
        named = df.select("document", "path", F.explode(_named(df, "appliesToIds", True)).alias("__ref"))
        met = named.join(valid, (named["document"] == valid["__d"]) & (named["__ref"] == valid["__id"]), "left").groupBy(named["document"], named["path"])
        met = met.agg(F.bool_or(F.col("__id").isNotNull()).alias("__some"), F.bool_or(F.col("__id").isNull()).alias("__odd"))
        df = df.join(met, ["document", "path"], "left")
        return df.withColumns({"product_role_missing_valid_target": ~F.coalesce("__some", F.lit(False)), "product_role_invalid_target": F.coalesce("__odd", F.lit(False))}).drop("__some", "__odd")
    return df


def entities(spark: SparkSession, rows: DataFrame, kinds: Sequence[str] | None = None) -> list[Dataset]:
    """A table for each kind of object: document, path, parent, id, name, value as JSON, and its flags."""
    known = kinds or [r[0] for r in rows.where("kind IS NOT NULL").select("kind").distinct().collect()]  # kinds are few
    base = rows.select("document", "path", "parent", "key", "id", "kind", "name", "value").withColumn("usdm_id_contains_space", F.coalesce(F.col("id").contains(" "), F.lit(False)))
    for kind, fields, flag in REPEATS:
        of_kind = F.lit(True) if kind is None else F.col("kind") == kind
        keys = [F.col(f) if f in ("id", "kind", "name") else text(f) for f in fields]
        whole = of_kind
        for k in keys:
            whole = whole & k.isNotNull()
        names = [f"__k{i}" for i in range(len(keys))]
        keyed = rows.where(whole).select("document", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
        twice = keyed.groupBy("document", *names).agg(F.count("*").alias("__n")).where("__n > 1")
        at = base.withColumns({n: F.when(whole, k) for n, k in zip(names, keys, strict=True)})
        base = at.join(twice, ["document", *names], "left").withColumn(flag, F.col("__n").isNotNull()).drop("__n", *names)
    tables = []
    for kind in sorted(known):
        df = base.where(F.col("kind") == kind)
        for f in row_flags():
            if f.kind == kind:
                df = df.withColumn(f.name, F.coalesce(f.value, F.lit(False)))
        for of, field, listed, targets, flag in REFERENCES:
            if of == kind:
                ids = rows.where(F.col("kind").isin(*targets)).select(F.col("document").alias("__d"), F.col("id").alias("__id")).distinct()
                named = df.select("document", "path", F.explode(_named(df, field, listed)).alias("__ref"))
                bad = named.join(ids, (named["document"] == ids["__d"]) & (named["__ref"] == ids["__id"]), "left_anti").select("document", "path").distinct().withColumn(flag, F.lit(True))
                df = df.join(bad, ["document", "path"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        for of, field, flag in UNUSED:
            if of == kind:
                listed = field.endswith("Ids")
                used = rows.select(F.col("document").alias("__d"), F.explode(_named(rows, field, listed)).alias("__ref")).distinct().withColumn(flag, F.lit(True))
                df = df.join(used, (df["document"] == used["__d"]) & (df["id"] == used["__ref"]), "left").drop("__d", "__ref").withColumn(flag, F.col(flag).isNull())
        df = _joined_flags(kind, df, rows)
        df = df.withColumn("value", F.to_json("value")).withColumn(ORD, F.struct("document", "path"))
        tables.append(Dataset(kind, df, kind, source_format="protocol"))
    return tables
