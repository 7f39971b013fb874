"""Readers: inference, packages, study directories, transport files, metadata."""

import json
import struct

import numpy as np
import pytest

from attestra.sources import metadata, tables, transport


def kinds(df):
    return {k: v for k, v in df.dtypes if not k.startswith("__")}


def test_csv_types(spark, tmp_path):
    (tmp_path / "ae.csv").write_text('A,B,C,D,E,F,G\n1,true,1.5,007,,9007199254740993,"x, ""y"""\n2,FALSE,2.0,1,,3,\n-3,,1e3,1.5,,,z\n')
    ds = tables.read_csv(spark, str(tmp_path / "ae.csv"))
    assert ds.name == "AE" and kinds(ds.df) == {"A": "bigint", "B": "boolean", "C": "double", "D": "string", "E": "boolean", "F": "bigint", "G": "string"}
    assert [r["G"] for r in ds.df.orderBy("__ord").collect()] == ['x, "y"', None, "z"]


def test_mixed_numbers_stay_text(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n1,1.0\n1.5,2.5\n")
    assert kinds(tables.read_csv(spark, str(tmp_path / "x.csv")).df)["B"] == "double"


def test_zero_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n")
    assert kinds(tables.read_csv(spark, str(tmp_path / "x.csv")).df) == {"A": "boolean", "B": "boolean"}


def test_package(spark, tmp_path):
    package = {"datasets": [{"filename": "ae.xpt", "label": "Events", "domain": "AE", "variables": [{"name": "AESEQ", "type": "Num", "role": "Id"}], "records": {"AESEQ": [1, 2], "X": [None, None], "Y": [1, 2.5], "Z": ["a", 1], "O": [{"k": 1}, [1]]}}]}
    (tmp_path / "p.json").write_text(json.dumps(package))
    ds = tables.read_package(spark, str(tmp_path / "p.json"))[0]
    assert (ds.name, ds.domain, ds.label, ds.variables[0].extra) == ("AE", "AE", "Events", {"role": "Id"})
    assert kinds(ds.df) == {"AESEQ": "bigint", "X": "boolean", "Y": "double", "Z": "string", "O": "string"}
    assert [r["O"] for r in ds.df.orderBy("__ord").collect()] == ['{"k":1}', "[1]"]


def test_study_directory(spark, tmp_path):
    (tmp_path / "_datasets.csv").write_text("Filename,Label\nae.csv,Events\n")
    (tmp_path / "_variables.csv").write_text("dataset,variable,label,type,length\nae.csv,AESEQ,Seq,Num,8\nae.csv,T,Term,Char,20\n")
    (tmp_path / "ae.csv").write_text("AESEQ,T\n1,\n.,x\nbad,y\n")
    found, warnings = tables.scan_folder(spark, str(tmp_path))
    rows = found[0].df.orderBy("__ord").collect()
    assert [r["AESEQ"] for r in rows] == [1.0, None, None] and [r["T"] for r in rows] == ["", "x", "y"]
    assert warnings == ["ae.csv: 1 values of AESEQ are no numbers"] and found[0].variables[1].length == 20
    (tmp_path / "_datasets.csv").write_text("Filename,Label\n../ae.csv,Events\n")
    with pytest.raises(ValueError):
        tables.read_study(spark, str(tmp_path))


def card(text):
    return text.encode().ljust(80)


def hexadecimal(x):
    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    sign, x, e = (0x80, -x, 64) if x < 0 else (0, x, 64)
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | e]) + int(x * 2**56).to_bytes(7, "big")


def transport_file(rows):
    def namestr(kind, length, name, label, offset):
        return (struct.pack(">hhhh", kind, 0, length, 1) + name.encode().ljust(8) + label.encode().ljust(40) + bytes(28) + struct.pack(">i", offset)).ljust(140, b"\0")

    out = card("HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000") + card("SAS") + card("")
    out += card("HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140  ") + card("HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!") + card("SAS     AE      ") + card(" " * 32 + "Adverse events")
    out += card("HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000000200000000000000000000")
    names = namestr(1, 8, "AESEQ", "Sequence", 0) + namestr(2, 6, "TERM", "Term", 8)
    out += names.ljust(-(-len(names) // 80) * 80) + card("HEADER RECORD*******OBS     HEADER RECORD!!!!!!!")
    data = b"".join(hexadecimal(n) + t.encode("latin-1").ljust(6) for n, t in rows)
    return out + data.ljust(-(-len(data) // 80) * 80)


def test_transport(spark, tmp_path):
    rows = [(1.0, "ab"), (None, "é"), (-12.5, ""), (0.0, "x")]
    (tmp_path / "ae.xpt").write_bytes(transport_file(rows))
    ds = transport.read_transport(spark, str(tmp_path / "ae.xpt"))[0]
    assert (ds.name, ds.label, ds.variables[0].label) == ("AE", "Adverse events", "Sequence")
    assert [(r["AESEQ"], r["TERM"]) for r in ds.df.orderBy("__ord").collect()] == rows
    with pytest.raises(transport.TransportError):
        transport.members(b"x" * 400)
    with pytest.raises((transport.TransportError, ValueError)):
        transport.members(transport_file(rows)[:800])


def test_hexadecimal_floats():
    values = np.array([0.0, 1.0, -1.0, 0.1, 123456.789, 1e-20, 1e20])
    cells = np.frombuffer(b"".join(map(hexadecimal, values)), np.uint8).reshape(-1, 8)
    np.testing.assert_allclose(transport.numbers(cells), values, rtol=1e-15)
    np.testing.assert_allclose(transport.numbers(cells[:2, :3]), values[:2])


DEFINE = """<ODM xmlns="urn:x" xmlns:def="urn:d"><Study><MetaDataVersion>
<ItemGroupDef OID="IG.AE" Name="AE" Domain="AE"><Description><TranslatedText>Events</TranslatedText></Description><ItemRef ItemOID="IT.1" Mandatory="Yes" OrderNumber="1" Role="Id"/></ItemGroupDef>
<ItemDef OID="IT.1" Name="AESEV" DataType="text" Length="8"><CodeListRef CodeListOID="CL.1"/></ItemDef>
<CodeList OID="CL.1"><CodeListItem CodedValue="MILD"/><EnumeratedItem CodedValue="SEVERE"/></CodeList>
<def:ValueListDef OID="VL.1"><ItemRef ItemOID="IT.1"><def:WhereClauseRef WhereClauseOID="WC.1"/></ItemRef></def:ValueListDef>
<def:WhereClauseDef OID="WC.1"><RangeCheck Comparator="IN" def:ItemOID="IT.1"><CheckValue>A</CheckValue><CheckValue>B</CheckValue></RangeCheck></def:WhereClauseDef>
<MethodDef OID="M.1"><Description><TranslatedText>how</TranslatedText></Description></MethodDef><def:CommentDef OID="C.1"/><def:leaf ID="L.1"/>
</MetaDataVersion></Study></ODM>"""


def test_metadata(spark, tmp_path):
    define = metadata.parse_define(DEFINE)
    assert define.codelist("CL.1") == ["MILD", "SEVERE"] and define.variables[0]["codelist"] == "CL.1" and define.variables[0]["role"] == "Id"
    assert define.value_lists[0]["where"] == "WC.1" and define.where_clauses[0]["values"] == "A|B" and define.methods == {"M.1": "how"} and define.datasets[0]["label"] == "Events"
    with pytest.raises(ValueError):
        metadata.parse_define("<!DOCTYPE x><ODM/>")
    (tmp_path / "ct.json").write_text(json.dumps({"codelists": [{"codelistCode": "C1", "submissionValue": "SEV", "name": "Severity", "terms": [{"submissionValue": "MILD", "synonyms": ["light"]}, "SEVERE"]}]}))
    found = metadata.read_terminology(spark, str(tmp_path / "ct.json"))
    assert found.find("c1") == found.find("severity") == ["MILD", "light", "SEVERE"] and found.find("x") is None
    (tmp_path / "d.csv").write_text("dictionary,term\nWHO,aspirin\n")
    assert metadata.read_dictionaries(spark, str(tmp_path / "d.csv")).collect()[0]["term"] == "aspirin"


def test_study_with_labels_and_a_horizontal_dictionary(spark, tmp_path):
    (tmp_path / "_datasets.csv").write_text("Filename,Label\nae.csv,Events\n")
    (tmp_path / "_variables.csv").write_text("USUBJID,AESEQ,AETERM\nSubject,Sequence  Number,Term\nChar,Num,Char\n20,8,\n")
    (tmp_path / "ae.csv").write_text("USUBJID,Sequence Number,Term\ns1,1,headache\ns2,x,\n")
    (ae,), warnings = tables.read_study(spark, str(tmp_path))
    assert ae.columns == ["USUBJID", "AESEQ", "AETERM"] and [tuple(r) for r in ae.df.select(*ae.columns).collect()] == [("s1", 1.0, "headache"), ("s2", None, "")]
    assert [(v.name, v.label, v.type, v.length) for v in ae.variables] == [("USUBJID", "Subject", "Char", 20), ("AESEQ", "Sequence  Number", "Num", 8), ("AETERM", "Term", "Char", None)] and len(warnings) == 1
