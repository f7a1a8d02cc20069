"""Names and parties against a plain second version, and the values that the rules state."""

import difflib
import re

import pytest

from ledgerloom.functions import scalars as S
from ledgerloom.operators import parties as N
from ledgerloom.plans import catalogue, q_parties

SF = "/root/testdata/sf0.001"
BG = str.maketrans(dict(zip(*S.EN_BG_LETTERS)))


def norm(t):
    t = re.sub(r"[\"'`«»„“.,()\-/\\:;!?*#]", " ", (t or "").lower())
    for f in S.LEGAL_FORMS:
        t = re.sub(rf"\b{f}\b", " ", t)
    return " ".join(t.split())


def en(t):
    return "".join(S.BG_EN.get(c, c) for c in t.lower())


def bg(t):
    t = t.lower()
    for a, b in S.EN_BG_GROUPS:
        t = t.replace(a, b)
    return t.replace("x", "кс").translate(BG)


def plain_score(name, cand):
    n, c = norm(name), norm(cand)
    if any(f(n) and f(n) == f(c) for f in (str, en, bg)):
        return True, 1.0
    ns, cs = ({w for w in x.split() if len(w) > 2 and w not in S.GENERIC_WORDS} for x in (n, c))
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    if ns and cs:
        for a, b in ((ns, cs), ({bg(w) for w in ns}, {bg(w) for w in cs})):
            if a & b:
                return False, 0.75 + 0.25 * len(a & b) / len(a)
        n, c = " ".join(sorted(ns)), " ".join(sorted(cs))
    return False, max(ratio(n, c), ratio(bg(n), bg(c)))


def plain_party(eik, name, partners):
    eik = re.sub("[^0-9A-Za-z]", "", eik or "")
    eik = eik[2:] if eik.upper().startswith("BG") else eik
    if not eik:
        return None, "MISSING_EIK", 0.0, None
    p = partners.get(eik)
    if p is None:
        return eik, "NOT_IN_DB", 0.0, None
    if not (name or "").strip():
        return eik, "EMPTY", 0.0, None
    names = [c for c in (p["legal_name"], p["transliteration"], p["trade_name"], *p["aliases"]) if c and c.strip()]
    scored = [(*plain_score(name, c), -i, c) for i, c in enumerate(names)]
    _, score, _, best = max(scored, key=lambda x: x[:3])
    return eik, "EXACT" if score >= 0.95 else "SIMILAR" if score >= 0.6 else "DIVERGENT", round(score, 4), best


def test_parties_against_plain_version(spark):
    partners = {r["eik"]: r for r in q_parties.master(spark, SF).collect()}
    asked = {(r["invoice_id"], r["role"]): r for r in q_parties.parties(spark, SF).collect()}
    got = {(r["invoice_id"], r["role"]): r for r in catalogue.QUERIES["D04_verify_parties"](spark, SF).collect()}
    assert len(asked) > 2000 and set(got) == set(asked)
    seen = {}
    for key, r in asked.items():
        want = plain_party(r["eik"], r["name"], partners)
        seen[key] = want[1]
        g = got[key]
        assert (g["eik"], g["match_status"], g["matched"]) == (want[0], want[1], want[3]) and g["similarity"] == pytest.approx(want[2], abs=1e-4), (r, g, want)
    assert set(seen.values()) == {"MISSING_EIK", "NOT_IN_DB", "EMPTY", "EXACT", "SIMILAR", "DIVERGENT"}
    for r in catalogue.QUERIES["D05_parties_verdict"](spark, SF).collect():
        both = [(role, seen[r["invoice_id"], role]) for role in ("supplier", "recipient")]
        bad = [f"CRITICAL_{role.upper()}_NAME_MISMATCH" for role, s in both if s == "DIVERGENT"]
        codes = bad + [f"{role.upper()}_NOT_IN_ACCOUNTING_PARTNERS" for role, s in both if s == "NOT_IN_DB"]
        assert (r["codes"], r["has_critical"], r["both_in_db"]) == (",".join(codes), bool(bad), not {"NOT_IN_DB", "MISSING_EIK"} & {s for _, s in both})
    names = {(r["invoice_id"], r["role"]): r for r in catalogue.QUERIES["D19_canonical_names"](spark, SF).collect()}
    assert all(r["flagged"] == (seen[k] == "DIVERGENT") for k, r in names.items())
    assert all(r["name"] == asked[k]["name"] for k, r in names.items() if seen[k] in ("DIVERGENT", "NOT_IN_DB", "MISSING_EIK"))
    assert all(norm(r["name"]) == norm(partners[r["eik"]]["legal_name"]) for k, r in names.items() if seen[k] in ("EXACT", "SIMILAR", "EMPTY"))


def test_swapped_parties_against_plain_version(spark):
    partners = {r["eik"]: r["legal_name"] for r in q_parties.master(spark, SF).collect()}
    by = {}
    for r in q_parties.parties(spark, SF).collect():
        by.setdefault(r["invoice_id"], {})[r["role"]] = (re.sub("^BG *", "", r["eik"]) if r["eik"] else None, r["name"])
    sim = lambda a, b: round(plain_score(a, b)[1], 4)
    n_fixed = 0
    for r in catalogue.QUERIES["D17_party_swap"](spark, SF).collect():
        (se, sn), (re_, rn) = by[r["invoice_id"]]["supplier"], by[r["invoice_id"]]["recipient"]
        sl, rl, fixed = partners.get(se), partners.get(re_), []
        if se and re_ and se != re_ and sl and rl and sn and rn and sim(sn, rn) >= 0.7:
            if sim(sn, rl) >= 0.7 and sim(sn, sl) < 0.5:
                sn, fixed = sl, ["supplier"]
            if sim(rn, sl) >= 0.7 and sim(rn, rl) < 0.5:
                rn, fixed = rl, [*fixed, "recipient"]
        n_fixed += len(fixed)
        assert (r["supplier_name"], r["recipient_name"], r["fixed"]) == (sn, rn, ",".join(fixed))
    some = spark.createDataFrame([(1, "supplier", "1", "Бета Строй ЕООД"), (1, "recipient", "2", "Бета Строй"), (2, "supplier", "1", None), (2, "recipient", "1", "x")], "invoice_id long, role string, eik string, name string")
    known = spark.createDataFrame([("1", "АЛФА ООД"), ("2", "БЕТА СТРОЙ ЕООД")], "eik string, legal_name string")
    assert sorted(map(tuple, N.party_swap(some, known).collect())) == [(1, "АЛФА ООД", "Бета Строй", "supplier"), (2, None, "x", "")]


def test_names_of_the_rules(spark):
    names = ["\u201eКАУФЛАНД БЪЛГАРИЯ\" ЕООД ЕНД КО КД", "Джентълмен Груп ООД", "Shell Bulgaria EAD"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(S.normalize_company(df["n"])).collect()] == ["кауфланд българия", "джентълмен груп", "shell bulgaria"]
    cand = ["ДЖЕНТЪЛМЕН ГРУП ООД", "Gentleman Group OOD", "Gentleman"]
    rows = [("1", "supplier", "7", n) for n in ("Джентълмен Груп ООД", "Gentleman Group", "Дженталмен Груп", "ТОПЛИВО АД")] + [("1", "supplier", "8", "Шел България ЕАД")]
    master = spark.createDataFrame([("7", cand[0], cand[1], None, [cand[2]]), ("8", "КАУФЛАНД БЪЛГАРИЯ ЕООД ЕНД КО КД", None, None, None)], "eik string, legal_name string, transliteration string, trade_name string, aliases array<string>")
    out = {r["name"]: r["match_status"] for r in N.verify_parties(spark.createDataFrame(rows, "invoice_id string, role string, eik string, name string"), master).collect()}
    assert out["Джентълмен Груп ООД"] == "EXACT" and {out["Gentleman Group"], out["Дженталмен Груп"]} <= {"EXACT", "SIMILAR"}
    assert out["ТОПЛИВО АД"] == out["Шел България ЕАД"] == "DIVERGENT"


def test_names_are_spelt_once_and_only_stray_ones_are_compared(spark, monkeypatch):
    """Each text's patterns stand once in the plan for names and once for candidates, not once more for each use; a name like its own is compared with no other."""
    pairs = spark.createDataFrame([("Алфа", "АЛФА ООД"), ("Gamma", "АЛФА ООД")], "name string, candidate string")
    plan = N.name_similarity(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace(") <= 4 * (len(S.LEGAL_FORMS) + 2)
    asked, whole = [], N.name_similarity
    monkeypatch.setattr(N, "name_similarity", lambda df: (asked.append({(r["name"], r["candidate"]) for r in df.collect()}), whole(df))[1])
    some = spark.createDataFrame([(1, "supplier", "1", "Алфа"), (1, "recipient", "2", "Бета Строй"), (2, "supplier", "1", "Бета Строй ЕООД"), (2, "recipient", "2", "Бета Строй")], "invoice_id long, role string, eik string, name string")
    known = spark.createDataFrame([("1", "АЛФА ООД"), ("2", "БЕТА СТРОЙ ЕООД")], "eik string, legal_name string")
    got = sorted(map(tuple, N.party_swap(some, known).collect()))
    assert got == [(1, "Алфа", "Бета Строй", ""), (2, "АЛФА ООД", "Бета Строй", "supplier")]
    assert asked[-1] == {("Бета Строй ЕООД", "Бета Строй"), ("Бета Строй ЕООД", "БЕТА СТРОЙ ЕООД")}
