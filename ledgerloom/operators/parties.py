"""Parties of invoices against master data: likeness of names, verdicts per party and per invoice."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import sinks


# B30
def name_ratio(a: Column, b: Column) -> Column:
    """Matching blocks of two texts over their length (Ratcliff and Obershelp): twice the letters in blocks found longest first; 1 for two empty texts.

    The only Python of this module; callers give it distinct pairs that no exact rule decides."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def _spelt(names: DataFrame, as_: str) -> DataFrame:
    """Distinct names with what is compared of them, prefixed by ``as_``: normalized, in Latin and in Cyrillic letters, distinctive words in order and by sound, and the
    text of a ratio with and without words. Each name is spelt once, however many it is compared with."""
    bg = S.translit_en_bg
    d = names.select(F.col(as_).alias("__n")).distinct().withColumn("norm", S.normalize_company(F.col("__n")))
    d = d.withColumns({"en": S.translit_bg_en(F.col("norm")), "bg": bg(F.col("norm")), "words": F.array_sort(S.distinctive_tokens(F.col("norm")))})
    d = d.withColumns({"heard": F.array_distinct(F.transform("words", bg)), "said": F.array_join("words", " ")}).withColumn("said_bg", bg(F.col("said")))
    return d.select(F.col("__n").alias(as_), F.struct("norm", "en", "bg", "words", "heard", "said", "said_bg").alias("n" if as_ == "name" else "c"))


def name_similarity(pairs: DataFrame, name: str = "name", candidate: str = "candidate") -> DataFrame:
    """Distinct (name, candidate) with score and exact: 1 for equal normalized names, also transliterated either way; else 0.75 and a quarter of the share of
    the name's distinctive words that the candidate holds, as they stand or in Cyrillic; else the ratio of these words in order, the better
    of both alphabets; without such words on one side, of the whole names. Null and blank candidates are left out."""
    p = pairs.select(F.col(name).alias("name"), F.col(candidate).alias("candidate")).where("trim(candidate) <> '' AND trim(name) <> ''").distinct()
    p = sinks.stored(p, "name-pairs")
    p = p.join(_spelt(p, "name"), "name").join(_spelt(p, "candidate"), "candidate")
    n, c = F.col("n"), F.col("c")
    same = lambda k: (n[k] != "") & (n[k] == c[k])
    share = lambda k: F.size(F.array_intersect(n[k], c[k])) / F.greatest(F.size(n[k]), F.lit(1))
    p = p.withColumns({"exact": same("norm") | same("en") | same("bg"), "plain": share("words"), "heard": share("heard"), "told": (F.size(n["words"]) > 0) & (F.size(c["words"]) > 0)})
    by_word = F.when(F.col("told") & (F.col("plain") > 0), 0.75 + 0.25 * F.col("plain")).when(F.col("told") & (F.col("heard") > 0), 0.75 + 0.25 * F.col("heard"))
    p = p.withColumn("score", F.when(F.col("exact"), 1.0).otherwise(by_word))
    text = lambda x, words, whole: F.when(F.col("score").isNull(), F.when(F.col("told"), x[words]).otherwise(x[whole]))
    p = p.select("name", "candidate", "exact", "score", *(text(x, *k).alias(a) for a, x, k in (("x1", n, ("said", "norm")), ("y1", c, ("said", "norm")), ("x2", n, ("said_bg", "bg")), ("y2", c, ("said_bg", "bg")))))
    ratio = F.greatest(name_ratio(F.col("x1"), F.col("y1")), name_ratio(F.col("x2"), F.col("y2")))
    return p.select("name", "candidate", "exact", F.coalesce("score", ratio).alias("score"))


# D04
def verify_parties(parties: DataFrame, partners: DataFrame) -> DataFrame:
    """parties' invoice_id, role, eik (digits and letters, without BG) and name, with in_db, canonical_name, match_status, similarity, matched and is_critical.

    MISSING_EIK, NOT_IN_DB or EMPTY (no name) come before names; then the best of the partner's names counts (legal name, transliteration, trade name, aliases; exact
    ones first, then by score, then in this order): EXACT from 0.95, SIMILAR from 0.60, else DIVERGENT, which is critical. Each distinct pair of names is compared once.

    parties: invoice_id, role, eik, name; partners: eik (unique), legal_name, transliteration, trade_name, aliases.
    """
    bare = F.regexp_replace(F.coalesce("eik", F.lit("")), "[^0-9A-Za-z]", "")
    own = sinks.stored(parties, "parties").select("invoice_id", "role", F.when(F.upper(bare).startswith("BG"), F.substring(bare, 3, 99)).otherwise(bare).alias("eik"), "name")
    known = partners.where("trim(legal_name) <> ''").select("eik", F.col("legal_name").alias("canonical_name"), F.concat(F.array("legal_name", "transliteration", "trade_name"), F.coalesce("aliases", F.array())).alias("names"))
    both = own.join(known, "eik", "left")
    asked = both.where("canonical_name IS NOT NULL AND trim(name) <> ''").select("name", "eik", "names").distinct()
    offers = asked.select("name", "eik", F.posexplode("names").alias("at", "candidate"))
    scored = offers.join(name_similarity(offers), ["name", "candidate"])
    best = scored.groupBy("name", "eik").agg(F.max_by(F.struct("score", "candidate"), F.struct("exact", "score", -F.col("at"))).alias("b"))
    score = F.round(F.col("b.score"), 4)
    out = both.join(best, ["name", "eik"], "left")
    status = (
        F.when(F.col("eik") == "", "MISSING_EIK").when(F.col("canonical_name").isNull(), "NOT_IN_DB").when(F.coalesce(F.trim("name"), F.lit("")) == "", "EMPTY")
        .when(F.col("b.score") >= 0.95, "EXACT").when(F.col("b.score") >= 0.60, "SIMILAR").otherwise("DIVERGENT")
    )
    named = status.isin("EXACT", "SIMILAR", "DIVERGENT")
    return out.select(
        "invoice_id", "role", F.nullif("eik", F.lit("")).alias("eik"), "name", F.col("canonical_name").isNotNull().alias("in_db"), "canonical_name", status.alias("match_status"),
        F.when(named, score).otherwise(0.0).alias("similarity"), F.when(named, F.col("b.candidate")).alias("matched"), (status == "DIVERGENT").alias("is_critical"),
    )


# D05
def parties_verdict(checked: DataFrame) -> DataFrame:
    """Per invoice: both_in_db, has_critical, requires_review and codes (by role, supplier first, errors before warnings). checked: ``verify_parties``."""
    bad, unknown = F.col("is_critical"), F.col("eik").isNotNull() & ~F.col("in_db")
    rank = F.when(bad, 0).otherwise(2) + F.when(F.col("role") == "supplier", 0).otherwise(1)
    code = F.when(bad, F.concat(F.lit("CRITICAL_"), F.upper("role"), F.lit("_NAME_MISMATCH"))).when(unknown, F.concat(F.upper("role"), F.lit("_NOT_IN_ACCOUNTING_PARTNERS")))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(code.isNotNull(), F.struct(rank.alias("r"), code.alias("c"))))), lambda x: x["c"]), ",")
    roles = F.count_if(F.col("in_db") & (F.col("role") == "supplier")) * F.count_if(F.col("in_db") & (F.col("role") == "recipient"))
    return checked.groupBy("invoice_id").agg((roles > 0).alias("both_in_db"), F.max(bad).alias("has_critical"), F.max(bad).alias("requires_review"), codes.alias("codes"))


# D17
def party_swap(parties: DataFrame, partners: DataFrame, alike: float = 0.7, unlike: float = 0.5) -> DataFrame:
    """invoice_id, supplier_name, recipient_name and fixed (which roles, comma-joined): a name read from the other party's column is replaced by the partner's.

    Only where both parties have different EIKs of known partners and alike names: a name that is like the other's legal name, and unlike its own.
    parties: invoice_id, role, eik, name (a row for each role); partners: eik (unique), legal_name."""
    wide = sinks.stored(parties, "parties").groupBy("invoice_id").agg(*(F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("supplier", "recipient") for c in ("eik", "name")))
    for r in ("supplier", "recipient"):
        wide = wide.join(partners.select(F.col("eik").alias(f"{r}_eik"), F.col("legal_name").alias(f"{r}_legal")), f"{r}_eik", "left")
    open_ = wide.where("supplier_eik <> recipient_eik AND supplier_legal IS NOT NULL AND recipient_legal IS NOT NULL AND trim(supplier_name) <> '' AND trim(recipient_name) <> ''")
    side = lambda r, o: F.struct(F.lit(r).alias("role"), F.col(f"{r}_name").alias("name"), F.col(f"{r}_legal").alias("candidate"), F.col(f"{o}_legal").alias("other"), F.col("supplier_name").alias("a"), F.col("recipient_name").alias("b"))
    own = open_.select("invoice_id", F.inline(F.array(side("supplier", "recipient"), side("recipient", "supplier"))))
    # a name is turned only if it is unlike its own, so only then are the others compared
    stray = own.join(name_similarity(own), ["name", "candidate"]).where(F.round("score", 4) < unlike)
    asked = stray.select("invoice_id", "role", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(x).alias("name"), F.col(y).alias("candidate")) for k, x, y in (("met", "a", "b"), ("other", "name", "other"))))))
    scored = asked.join(name_similarity(asked), ["name", "candidate"]).where(F.round("score", 4) >= alike)
    turned = scored.groupBy("invoice_id", "role").agg(F.count_distinct("k").alias("n")).where("n = 2").groupBy("invoice_id").agg(F.collect_set("role").alias("roles"))
    out = wide.join(turned, "invoice_id", "left")
    turn = {r: F.coalesce(F.array_contains("roles", r), F.lit(False)) for r in ("supplier", "recipient")}
    fixed = F.concat_ws(",", *(F.when(turn[r], r) for r in turn))
    return out.select("invoice_id", *(F.when(turn[r], F.col(f"{r}_legal")).otherwise(F.col(f"{r}_name")).alias(f"{r}_name") for r in turn), fixed.alias("fixed"))


# D19
def canonical_names(checked: DataFrame, partners: DataFrame) -> DataFrame:
    """checked (``verify_parties``) with name, person and vat_number as in master data, and flagged. A divergent name stays and is flagged; other names of known partners
    become the legal name, unless they differ in case only and hold a legal form. person: of the partner; vat_number: country and EIK if it is registered.

    partners: eik (unique), person, country_code, is_registered."""
    p = partners.select(F.col("eik").alias("__eik"), F.col("person"), F.when(F.col("is_registered"), F.concat("country_code", "eik")).alias("vat_number"))
    form = F.coalesce(F.lower("name").rlike("|".join(rf"(?U)\b{f}\b" for f in S.LEGAL_FORMS)), F.lit(False))
    own = F.coalesce(F.trim("name"), F.lit(""))
    keep = (F.col("match_status") == "DIVERGENT") | ~F.col("in_db") | (F.length(own) >= 3) & form & (F.upper(own) == F.upper(F.trim("canonical_name")))
    out = checked.join(p, F.col("eik") == F.col("__eik"), "left")
    return out.select("invoice_id", "role", "eik", F.when(keep, F.col("name")).otherwise(F.col("canonical_name")).alias("name"), "person", "vat_number", (F.col("match_status") == "DIVERGENT").alias("flagged"))
