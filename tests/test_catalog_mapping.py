"""Mapping of catalogs: every pair that can be good enough, and the best of them."""

import itertools

from attestra.catalog import rules

SCHEMA = ", ".join(f"{c} string" for c in rules.CATALOG)


def row(source, i, domain, target, message, description=None, standard="SDTM-IG", shared=None):
    return (source, i, domain, message, description, None, target, "record", standard, shared)


def best(ours, theirs):
    """Every rule against every other."""
    parts = lambda v: {x.strip().upper() for x in (v or "").split("|") if x.strip()}
    plain = lambda v: "".join(c for c in (v or "").upper() if c.isalnum())
    out = {}
    for a, b in itertools.product(ours, theirs):
        domain, target, standard = bool(parts(a[2]) & parts(b[2])), bool(parts(a[6]) & parts(b[6])), plain(a[8]) == plain(b[8])
        if (parts(a[1]) | parts(a[9])) & (parts(b[1]) | parts(b[9])):
            score, same = 0.90 + 0.03 * standard + 0.03 * domain + 0.04 * target, 0
        else:
            score, same = 0.20 * standard + 0.20 * domain + 0.25 * target + 0.25 * rules.likeness(a[3], b[3]) + 0.10 * rules.likeness(a[4], b[4]), 1
        score = round(min(score, 1.0), 4)
        if score >= 0.60:
            out[a[1]] = min(out.get(a[1], (2, 0, "")), (same, -score, b[1]))
    return {i: (b, -score) for i, (_, score, b) in out.items()}


def test_the_best_of_every_pair(spark):
    ours = [row("a", "A1", "AE", "X", "date is missing"), row("a", "A2", "AE", "AETERM", "other words"), row("a", "A3", "AE|CM", "X", "a date is missing here", "say more", "sdtm ig"), row("a", "A4", "LB", "LBX|LBY", "date is missing", "same text", "ADaM"), row("a", "A5", "ZZ", None, "date is missing", shared="CG1|CG2"), row("a", "A6", None, None, None), row("a", "A7", "AE", "Q", "date is missing", standard=None)]
    theirs = [row("b", f"B{i}", "AE", "AETERM", "date is missing", "say more") for i in range(3)] + [row("b", "B9", "VS", "LBY", "date is missing", "same text", "ADaM"), row("b", "A1", "DM", "Y", "nothing alike"), row("b", "C1", "QQ", "R", "words", shared="CG2")]
    got = {r["rule_id"]: (r["other_id"], r["score"]) for r in rules.map_rules(spark.createDataFrame(ours, SCHEMA), spark.createDataFrame(theirs, SCHEMA)).collect()}
    assert got == best(ours, theirs) and {"A1", "A2", "A3", "A4", "A5"} <= set(got) and got["A5"][0] == "C1"
