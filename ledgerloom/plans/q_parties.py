"""Queries of parties and names. The ratio of two names is no SQL function: where it decides, tests hold the result against a plain version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import parties as N
from ..sources import adapters as A
from .registry import query


def master(spark, d):
    """Partners with all names that invoices may use."""
    k = F.col("partner_id")
    p = A.partners(spark, d)
    return p.select(
        "eik", F.concat_ws(" ", F.replace("legal_name", F.lit("#"), F.lit(" ")), "legal_form").alias("legal_name"), F.when(k % 2 == 0, S.translit_en_bg(F.col("aliases")[0])).alias("transliteration"),
        F.when(k % 5 == 0, F.concat(F.lit("Търговец "), k.cast("string"))).alias("trade_name"), "aliases", "country_code", F.concat(F.lit("Лице "), k.cast("string")).alias("person"), (k % 3 == 0).alias("is_registered"),
    )


def parties(spark, d):
    """Both parties of each invoice with their names as they may be read: whole, by sound, misspelt, of another company, none, of the other party, in part."""
    v, k = A.vat_invoices(spark, d), F.col("invoice_id")
    name = {"supplier": F.col("supplier_name"), "recipient": F.col("recipient_name")}

    def read(role, other):
        n = F.replace(name[role], F.lit("#"), F.lit(" "))
        return (
            F.when(k % 8 == 0, n).when(k % 8 == 1, F.concat(n, F.lit(" ЕООД"))).when(k % 8 == 2, S.translit_en_bg(n)).when(k % 8 == 3, F.regexp_replace(n, "[lt]", "i")).when(k % 8 == 4, "Топливо Трейдинг АД")
            .when(k % 8 == 6, F.replace(name[other], F.lit("#"), F.lit(" "))).when(k % 8 == 7, F.regexp_extract(n, "[1-9][0-9]*$", 0))
        )

    eik = lambda c: F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, F.concat(F.lit("BG9"), F.substring(c, 2, 8))).otherwise(F.concat(F.lit("BG "), c))
    rows = F.array(*(F.struct(F.lit(r).alias("role"), eik(F.col(f"{r}_eik")).alias("eik"), read(r, o).alias("name")) for r, o in (("supplier", "recipient"), ("recipient", "supplier"))))
    return v.select("invoice_id", F.inline(rows))


_NORM = "trim(regexp_replace(replace(lower(s_name), '#', ' '), ' +', ' ', 'g'))"


@query("B19_distinctive_tokens", f"SELECT s_suppkey, array_to_string(list_filter(list_distinct(string_split({_NORM}, ' ')), lambda w: length(w) > 2), ' ') AS a, 'supplier' AS b FROM (SELECT s_suppkey, regexp_extract(s_name, '[0-9]+') AS s_name FROM supplier)")
def distinctive_tokens(spark, d):
    """Of the number beside generic words and a legal form, and of the word beside its own copy."""
    s = A.table(spark, d, "supplier")
    number = F.concat(F.lit("Груп Trading "), F.regexp_extract("s_name", "[0-9]+", 0), F.lit(" България Group ООД"))
    tokens = lambda t: F.array_join(S.distinctive_tokens(S.normalize_company(t)), " ")
    return s.select("s_suppkey", F.replace(tokens(number), F.lit("груп "), F.lit("")).alias("a"), tokens(F.concat(F.regexp_replace("s_name", "#.*", ""), F.lit(" (SUPPLIER) of EU, Sofia"))).alias("b"))


@query("B30_name_similarity")
def name_similarity(spark, d):
    """Every name read on an invoice against its partner's legal name."""
    bare = F.regexp_replace("eik", "^BG *", "")
    return N.name_similarity(parties(spark, d).withColumn("eik", bare).join(master(spark, d).select("eik", F.col("legal_name").alias("candidate")), "eik"))


@query("D04_verify_parties")
def verify_parties(spark, d):
    return N.verify_parties(parties(spark, d), master(spark, d))


@query("D05_parties_verdict")
def parties_verdict(spark, d):
    return N.parties_verdict(verify_parties(spark, d))


@query("D17_party_swap")
def party_swap(spark, d):
    p = parties(spark, d).withColumn("eik", F.regexp_replace("eik", "^BG *", ""))
    return N.party_swap(p, master(spark, d))


@query("D19_canonical_names")
def canonical_names(spark, d):
    m = master(spark, d)
    return N.canonical_names(N.verify_parties(parties(spark, d), m), m)
