"""Define-XML, controlled terminology and external dictionaries; all small, read by the driver."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from attestra.sources.tables import read_text


@dataclass
class Terminology:
    """Codelists by any of their names; terms include synonyms."""

    terms: dict[str, list[str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def add(self, names: list[str], terms: list[str]) -> None:
        names = [n for n in names if n]
        if not names:
            return
        key = names[0]
        known = self.terms.setdefault(key, [])
        known += [t for t in dict.fromkeys(terms) if t not in known]
        for n in names:
            self.aliases.setdefault(n.upper(), key)

    def find(self, name: str) -> list[str] | None:
        key = self.aliases.get(name.upper())
        return None if key is None else self.terms[key]


def _names(entry: dict[str, Any], *keys: str) -> list[str]:
    return [str(entry[k]) for k in keys if entry.get(k)]


def _term_texts(term: Any) -> list[str]:
    if not isinstance(term, dict):
        return [str(term)]
    out = _names(term, "submissionValue", "value", "term", "name")[:1]
    synonyms = term.get("synonyms") or []
    return out + [s for s in (synonyms if isinstance(synonyms, list) else str(synonyms).split(";")) if s]


def read_terminology(spark: SparkSession, path: str) -> Terminology:
    """Terminology JSON: a list of codelists, ``{"codelists": [...]}``, or codelists by name."""
    raw = json.loads(read_text(spark, path))
    entries = raw.get("codelists", raw) if isinstance(raw, dict) else raw
    out = Terminology()
    if isinstance(entries, dict):
        entries = [{"name": k, **(v if isinstance(v, dict) else {"terms": v})} for k, v in entries.items()]
    for entry in entries:
        texts = [t for term in entry.get("terms") or entry.get("values") or [] for t in _term_texts(term)]
        out.add(_names(entry, "submissionValue", "codelistCode", "conceptId", "code", "name", "preferredTerm"), texts)
    return out


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(dictionary, term) of an external dictionary, CSV or JSON; CSV is read by Spark, whatever its size."""
    if path.lower().endswith(".csv"):
        df = spark.read.csv(path, header=True)
        names = {c.lower(): c for c in df.columns}
        return df.select(df[names["dictionary"]].alias("dictionary"), df[names.get("term", names.get("value", df.columns[-1].lower()))].alias("term"))
    raw = json.loads(read_text(spark, path))
    entries = raw.get("dictionaries", raw) if isinstance(raw, dict) else raw
    if isinstance(entries, dict):
        entries = [{"dictionary": k, "terms": v} for k, v in entries.items()]
    rows = [(str(e.get("dictionary") or e.get("name")), t) for e in entries for term in e.get("terms", []) for t in _term_texts(term)]
    return spark.createDataFrame(rows, "dictionary string, term string")


def read_library(spark: SparkSession, path: str) -> dict[str, dict[str, Any]]:
    """What a standard's library says of each domain, from JSON: lists of variables (columns, required, expected, permissible, model, by role) and labels by variable."""
    return {domain.upper(): {kind.lower(): names for kind, names in lists.items()} for domain, lists in json.loads(read_text(spark, path)).items()}


@dataclass
class Define:
    """What a Define-XML document says, as rows of texts."""

    datasets: list[dict[str, str]] = field(default_factory=list)
    variables: list[dict[str, str]] = field(default_factory=list)
    codelists: dict[str, list[str]] = field(default_factory=dict)
    value_lists: list[dict[str, str]] = field(default_factory=list)
    where_clauses: list[dict[str, str]] = field(default_factory=list)
    methods: dict[str, str] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    documents: list[dict[str, str]] = field(default_factory=list)

    def codelist(self, oid: str) -> list[str] | None:
        return self.codelists.get(oid)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(attributes: dict[str, str]) -> dict[str, str]:
    return {_local(k): v for k, v in attributes.items()}


def _label(element: ElementTree.Element) -> str:
    return next((" ".join((t.text or "").split()) for t in element.iter() if _local(t.tag) == "TranslatedText"), "")


def parse_define(source: str) -> Define:
    """Elements are known by their local names, so any version's namespaces will do; a document type is refused."""
    if "<!DOCTYPE" in source[:2000]:
        raise ValueError("a document type is not allowed")
    root, out = ElementTree.fromstring(source), Define()
    items: dict[str, dict[str, str]] = {}
    for e in root.iter():
        kind, said = _local(e.tag), _plain(e.attrib)
        if kind == "ItemDef":
            linked = next((_plain(r.attrib).get("CodeListOID", "") for r in e if _local(r.tag) == "CodeListRef"), "")
            values = next((_plain(r.attrib).get("ValueListOID", "") for r in e if _local(r.tag) == "ValueListRef"), "")
            items[said.get("OID", "")] = {"oid": said.get("OID", ""), "name": said.get("Name", ""), "label": _label(e), "type": said.get("DataType", ""), "length": said.get("Length", ""), "codelist": linked, "value_list": values}
        elif kind == "CodeList":
            out.codelists[said.get("OID", "")] = [_plain(i.attrib).get("CodedValue", "") for i in e if _local(i.tag) in ("CodeListItem", "EnumeratedItem")]
        elif kind == "MethodDef":
            out.methods[said.get("OID", "")] = _label(e)
        elif kind == "CommentDef":
            out.comments[said.get("OID", "")] = _label(e)
        elif kind == "leaf":
            out.documents.append({"id": said.get("ID", ""), "href": said.get("href", "")})
        elif kind == "WhereClauseDef":
            for check in (c for c in e if _local(c.tag) == "RangeCheck"):
                c = _plain(check.attrib)
                out.where_clauses.append({"oid": said.get("OID", ""), "item": c.get("ItemOID", ""), "comparator": c.get("Comparator", ""), "values": "|".join((v.text or "").strip() for v in check if _local(v.tag) == "CheckValue")})
    for e in root.iter():
        kind, said = _local(e.tag), _plain(e.attrib)
        if kind not in ("ItemGroupDef", "ValueListDef"):
            continue
        if kind == "ItemGroupDef":
            out.datasets.append({"oid": said.get("OID", ""), "name": said.get("Name", ""), "domain": said.get("Domain", ""), "label": _label(e), "class": said.get("Class", ""), "structure": said.get("Structure", "")})
        for ref in (r for r in e if _local(r.tag) == "ItemRef"):
            r = _plain(ref.attrib)
            row = items.get(r.get("ItemOID", ""), {}) | {"mandatory": r.get("Mandatory", ""), "order": r.get("OrderNumber", ""), "role": r.get("Role", ""), "method": r.get("MethodOID", "")}
            if kind == "ItemGroupDef":
                out.variables.append({"dataset": said.get("Name", ""), **row})
            else:
                where = next((_plain(w.attrib).get("WhereClauseOID", "") for w in ref if _local(w.tag) == "WhereClauseRef"), "")
                out.value_lists.append({"value_list": said.get("OID", ""), "where": where, **row})
    return out


def read_define(spark: SparkSession, path: str) -> Define:
    return parse_define(read_text(spark, path))


def codelist_table(spark: SparkSession, source: str) -> DataFrame:
    """(code, extensible, term_code, value, pref_term, version) of a CSV text, for the codelist operations."""
    rows = [(r["code"], r.get("extensible", "").strip().lower() in ("1", "true", "y", "yes"), r.get("term_code", ""), r.get("value", ""), r.get("pref_term", ""), r.get("version") or None) for r in csv.DictReader(io.StringIO(source))]
    return spark.createDataFrame(rows, "code string, extensible boolean, term_code string, value string, pref_term string, version string")
