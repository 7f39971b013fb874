"""Catalogs of rules as tables: reading, mapping one catalog to another, sorting rules by how far they can be converted."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.model import RuleError
from attestra.plans.rules import read_yaml, yaml_errors
from attestra.sources.tables import read_text

#: Columns of a catalog; domain, target and shared_ids (identifiers that other catalogs use too) may be lists, joined by a bar.
CATALOG = ["source", "rule_id", "domain", "message", "description", "condition", "target", "rule_type", "standard", "shared_ids"]
# Weights of the parts of a match, what they add to a match by identifier, and the bounds of a match.
WEIGHTS = {"standard": 0.20, "domain": 0.20, "target": 0.25, "message": 0.25, "description": 0.10}
BONUS = {"standard": 0.03, "domain": 0.03, "target": 0.04}
SAME_ID, LEAST = 0.90, 0.60


def read_catalog(spark: SparkSession, path: str, domains: DataFrame | None = None, source: str = "catalog") -> DataFrame:
    """A catalog CSV in the catalog's columns; ``domains`` (rule_id, domain) gives rules their domains."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {re.sub(r"[\s_-]+", "_", c.strip().lower()): c for c in raw.columns}
    pick = lambda *keys: next((F.trim(F.col(f"`{names[k]}`")) for k in keys if k in names), F.lit(None).cast("string"))
    out = raw.select(
        F.lit(source).alias("source"), pick("rule_id", "id").alias("rule_id"), F.upper(pick("domain", "domains")).alias("domain"), pick("message").alias("message"), pick("description").alias("description"),
        pick("condition", "test", "expression").alias("condition"), F.upper(pick("target", "variable")).alias("target"), F.lower(pick("rule_type", "type")).alias("rule_type"),
        pick("standard", "standard_name").alias("standard"), F.upper(pick("shared_ids", "cdisc_rule_ids", "publisher_id")).alias("shared_ids"),
    ).where("rule_id IS NOT NULL")
    if domains is not None:
        mapped = domains.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), "|").alias("__domains"))
        out = out.join(mapped, "rule_id", "left").withColumn("domain", F.coalesce("domain", "__domains")).drop("__domains")
    return out.select(*CATALOG)


# The elements of a configuration that are rules, and those whose attributes name a standard.
RULE_ELEMENTS, STANDARD_ELEMENTS = {"rule", "validationrule", "validation_rule", "check"}, {"standard", "standardconfig"}
#: Characters of a configuration file that is read whole.
CONFIG_CHARS = 20_000_000


def _said(e: ElementTree.Element) -> dict[str, str]:
    """Attributes and texts of direct children, by name in small letters; what children hold in turn is joined by a bar."""
    plain = lambda name: re.sub(r"[\s-]+", "_", name.rpartition("}")[2].strip()).lower()
    out = {plain(k): v.strip() for k, v in e.attrib.items() if v.strip()}
    for child in e:
        texts = [t.strip() for t in child.itertext() if t.strip()]
        if texts:
            out.setdefault(plain(child.tag), "|".join(texts))
    return out


def read_config(spark: SparkSession, path: str, source: str = "config") -> DataFrame:
    """Rules of an XML configuration in the catalog's columns. Rules without an id are left out; a document type is refused."""
    text = read_text(spark, path)
    if len(text) > CONFIG_CHARS or re.search("(?i)<!(?:doctype|entity)", text):
        raise ValueError(f"{path}: over {CONFIG_CHARS} characters, or with a document type")
    rows: list[tuple] = []

    def walk(e: ElementTree.Element, standard: str | None) -> None:
        kind, said = re.sub(r"[\s-]+", "_", e.tag.rpartition("}")[2]).lower(), _said(e)
        if kind in RULE_ELEMENTS:
            first = lambda *keys: next((said[k] for k in keys if k in said), None)
            listed = lambda value: re.sub(r"\s*[;,|]\s*", "|", value).strip("|").upper() if value else None
            condition = " ".join(f"{k.upper()} {v}" for k, v in (("when", first("when", "if", "where")), ("test", first("test", "condition", "expression", "logic"))) if v)
            name = first("id", "rule_id", "ruleid", "rule")
            if name:
                rows.append((source, name, listed(first("domain", "domains", "domainlist", "domain_list")), first("message", "error_message", "text"), first("description", "desc", "explanation"), condition or None, listed(first("target", "variable", "variables", "var")), (first("type", "rule_type") or "").lower() or None, standard, "|".join(sorted(set(re.findall(r"\bCG\d{3,}\b", " ".join(said.values()))))) or None))
            return
        if kind in STANDARD_ELEMENTS:
            standard = said.get("name") or said.get("standard_name") or standard
        for child in e:
            walk(child, standard)

    root = ElementTree.fromstring(text)
    walk(root, root.attrib.get("name"))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CATALOG))


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rule, error) of every rule in a tree of JSON and YAML files and zip archives of them; rule is its JSON text.

    Files are read and parsed in Spark's tasks; one that can't be read gives its error, and no other suffers.
    """
    kinds = (".json", ".yaml", ".yml")

    def parsed(name: str, content: bytes) -> list[tuple]:
        try:
            text = content.decode("utf-8")
            raw = json.loads(text) if name.lower().endswith(".json") else read_yaml(text)
            return [(name, json.dumps(r, ensure_ascii=False, default=str), None) for r in (raw if isinstance(raw, list) else [raw])]
        except (ValueError, RuleError, *yaml_errors()) as error:
            return [(name, None, str(error))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows += [r for member in archive.namelist() if member.lower().endswith(kinds) for r in parsed(f"{name}!{member}", archive.read(member))]
                elif name.lower().endswith(kinds):
                    rows += parsed(name, content)
            yield pd.DataFrame(rows, columns=["path", "rule", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rule string, error string")


def export_rules(drafts: DataFrame, path: str, passed: DataFrame | None = None) -> DataFrame:
    """Writes drafts (rule_id, rule: JSON text) as one folder for each rule, and returns (rule_id, exported).

    With ``passed`` (rule_id) only those that passed their cases are written. Folders that are there stay.
    """
    wanted = drafts if passed is None else drafts.join(passed.select("rule_id").distinct(), "rule_id", "left_semi")
    wanted.select("rule_id", F.col("rule").alias("value")).write.mode("append").partitionBy("rule_id").text(path)
    out = wanted.select("rule_id").distinct().withColumn("exported", F.lit(True))
    return drafts.select("rule_id").distinct().join(out, "rule_id", "left").withColumn("exported", F.coalesce("exported", F.lit(False)))


def likeness(left: str | None, right: str | None) -> float:
    """How alike two texts are: the share of matching characters or of common words, whichever is larger."""
    if not left or not right:
        return 0.0
    left, right = left.upper(), right.upper()
    a, b = set(re.findall("[A-Z0-9]+", left)), set(re.findall("[A-Z0-9]+", right))
    return max(SequenceMatcher(None, left, right).ratio(), len(a & b) / len(a | b) if a and b else 0.0)


@F.pandas_udf(T.DoubleType())
def alike(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([likeness(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def members(c: str) -> Column:
    """The entries of a bar-joined list, upper-cased."""
    return F.filter(F.transform(F.split(F.upper(F.coalesce(F.col(c), F.lit(""))), r"\|"), F.trim), lambda x: x != "")


def standard_key(c: str) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z0-9]", "")


def map_rules(catalog: DataFrame, other: DataFrame, frequent: float = 0.2) -> DataFrame:
    """(rule_id, other_id, score): the best match of each rule in another catalog, if it is good enough.

    A rule with the same or a shared identifier scores 0.90 at least and comes first. Others can only be good
    enough with a target in common, or with a domain and the standard, so only such pairs are compared, and all
    of them are. Keys that more than ``frequent`` of the other rules hold are joined in blocks.
    """
    named = lambda d, p: d.select(*[(F.col(c) if c in d.columns else F.lit(None).cast("string")).alias(f"{p}_{c}") for c in CATALOG])
    left, right = named(catalog, "a"), named(other, "b")
    ids = lambda p: F.array_distinct(F.concat(members(f"{p}_rule_id"), members(f"{p}_shared_ids")))

    def keys(d: DataFrame, p: str) -> DataFrame:
        key = lambda of, x: F.struct(F.lit(of).alias("of"), x.alias("is"))
        of_domains = F.transform(members(f"{p}_domain"), lambda x: key("domain", F.to_json(F.array(x, standard_key(f"{p}_standard")))))
        return d.select(f"{p}_rule_id", F.explode(F.concat(F.transform(ids(p), lambda x: key("id", x)), F.transform(members(f"{p}_target"), lambda x: key("target", x)), of_domains)).alias("key"))

    theirs = keys(right, "b")
    limit = F.lit(max(1.0, frequent * other.count()))
    blocks = theirs.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    theirs = theirs.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("b_rule_id"), F.col("blocks")).cast("int")).select("key", "block", "b_rule_id")
    ours = keys(left, "a").join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", "a_rule_id")
    pairs = ours.join(theirs, ["key", "block"]).select("a_rule_id", "b_rule_id").distinct()
    both = pairs.join(left, "a_rule_id").join(right, "b_rule_id")
    shares = {"standard": standard_key("a_standard") == standard_key("b_standard")} | {c: F.arrays_overlap(members(f"a_{c}"), members(f"b_{c}")) for c in ("domain", "target")}
    points = lambda of: sum((of[c] * shares[c].cast("double") for c in shares), F.lit(0.0))
    texts = sum((WEIGHTS[c] * alike(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in ("message", "description")), F.lit(0.0))
    same = F.arrays_overlap(ids("a"), ids("b"))
    scored = both.withColumns({"same": same, "score": F.round(F.least(F.lit(1.0), F.when(same, SAME_ID + points(BONUS)).otherwise(points(WEIGHTS) + texts)), 4)})
    best = F.struct(~F.col("same"), -F.col("score"), F.col("b_rule_id"))
    found = scored.where(F.col("score") >= LEAST).groupBy(F.col("a_rule_id").alias("rule_id")).agg(F.min_by(F.struct("b_rule_id", "score"), best).alias("x"))
    return found.select("rule_id", F.col("x.b_rule_id").alias("other_id"), "x.score")


def classify(catalog: DataFrame, mapped: DataFrame) -> DataFrame:
    """``catalog`` with kind: native, automatic, skeleton, manual or unsupported, and the reason."""
    known = mapped.select("rule_id", "other_id", "score")
    rows = catalog.join(known, "rule_id", "left")
    condition = F.coalesce("condition", F.lit(""))
    macro = condition.rlike(r"%[A-Za-z_.]+%|\$\{")
    simple = condition.rlike(r"(?i)^[\w.'\"\s,()|=!<>@%-]+$") & ~macro
    said = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    kind = (
        F.when(F.col("score") >= SAME_ID, said("native", "another catalog has the rule"))
        .when(F.col("rule_type").isin("schema", "xml", "external"), said("unsupported", "needs what no table holds"))
        .when(F.trim(condition) == "", said("manual", "no condition"))
        .when(macro, said("skeleton", "macros in the condition"))
        .when(simple, said("automatic", "the condition can be converted"))
        .otherwise(said("manual", "the condition is free text"))
    )
    return rows.withColumn("__k", kind).select(*CATALOG, "other_id", "score", F.col("__k.kind").alias("kind"), F.col("__k.reason").alias("reason"))


def macros(catalog: DataFrame) -> DataFrame:
    """(macro, rules): macros in conditions and the number of rules that have them."""
    found = catalog.select("rule_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("condition", F.lit("")), F.lit(r"(%[A-Za-z_.]+%|\$\{[^}]*\})"), F.lit(1)))).alias("macro"))
    return found.groupBy("macro").agg(F.count("*").alias("rules"))


def operators(conditions: DataFrame) -> DataFrame:
    """(operator, rules) of a table of rule_id and the condition as JSON text."""
    found = conditions.select("rule_id", F.explode(F.array_distinct(F.regexp_extract_all("condition", F.lit(r'"operator"\s*:\s*"([^"]+)"'), F.lit(1)))).alias("operator"))
    return found.groupBy("operator").agg(F.count("*").alias("rules"))


# Comparison signs of catalog conditions.
SIGNS = {"==": "equal_to", "!=": "not_equal_to", "<>": "not_equal_to", "@eqic": "equal_to_case_insensitive", "@neqic": "not_equal_to_case_insensitive", "@re": "matches_regex", ">=": "greater_than_or_equal_to", "<=": "less_than_or_equal_to", ">": "greater_than", "<": "less_than"}
INVERTED = {
    "equal_to": "not_equal_to", "equal_to_case_insensitive": "not_equal_to_case_insensitive", "matches_regex": "does_not_match_regex", "greater_than": "less_than_or_equal_to", "less_than": "greater_than_or_equal_to",
}
INVERTED |= {v: k for k, v in INVERTED.items()}
PART = re.compile(r"^\s*([\w.]+)\s*(==|!=|<>|@eqic|@neqic|@re|>=|<=|>|<)\s*('[^']*'|\"[^\"]*\"|[\w.\-]+)\s*$")


def convert_condition(source: str) -> dict | None:
    """A check that is true where the catalog's condition, which good rows meet, is false; None if it can't be read."""
    for sign, key in (("@or", "all"), ("@and", "any")):
        parts = re.split(rf"\s+{sign}\s+", source)
        if len(parts) > 1:
            found = [convert_condition(p) for p in parts]
            return None if None in found else {key: found}
    m = PART.match(source)
    if not m:
        return None
    name, sign, value = m.groups()
    literal = value[0] in "'\"" or bool(re.fullmatch(r"-?\d+(\.\d+)?", value))
    said = value[1:-1] if value[0] in "'\"" else (float(value) if "." in value else int(value)) if literal else value
    empty = said == "" and SIGNS[sign] in ("equal_to", "not_equal_to")
    if empty:
        return {"name": name, "operator": "is_not_empty" if SIGNS[sign] == "equal_to" else "is_empty"}
    return {"name": name, "operator": INVERTED[SIGNS[sign]], "value": said, **({"value_is_literal": True} if literal else {})}


def generate(rule_id: str, domain: str, message: str, condition: str, standard: str = "", version: str = "") -> dict | None:
    """A draft rule in the loader's metadata shape, or None."""
    check = convert_condition(condition)
    if check is None:
        return None
    return {
        "Core": {"Id": rule_id, "Status": "Draft"}, "Authorities": [{"Standards": [{"Name": standard, "Version": version}]}] if standard else [], "Scope": {"Domains": {"Include": domain.split("|")}} if domain else {},
        "Sensitivity": "Record", "Rule Type": "Record Data", "Check": {"all": [check]}, "Outcome": {"Message": message},
    }
